"""Output paths, model artefacts and their checks, JSON of small results."""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the files of a trained model.
MODEL, THRESHOLD, SCHEMA, MANIFEST = "selected_model", "selected_threshold.json", "selected_feature_schema.json", "model_manifest.json"


def output_path(source: Column, root: str, out: str, suffix: str = ".npy") -> Column:
    """Below ``out`` as the source is below ``root`` (its name alone where it is not), its own suffix kept, so that no two sources meet."""
    base = root.rstrip("/") + "/"
    below = F.when(F.startswith(source, F.lit(base)), F.substring(source, len(base) + 1, 1 << 30)).otherwise(F.element_at(F.split(source, "/"), -1))
    return F.concat(F.lit(out.rstrip("/") + "/"), below, F.lit(suffix))


def stale_outputs(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """The existing outputs (output_path) whose source is no longer accepted."""
    gone = manifest.filter(~F.coalesce(F.col("status") == "ACCEPTED", F.lit(False))).select("output_path")
    return existing.join(gone, "output_path", "left_semi")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_outputs(spark: SparkSession, stale: DataFrame) -> int:
    """Delete the files named in ``output_path``, a partition of names at a time; how many there were."""
    n = 0
    for r in stale.select("output_path").toLocalIterator():
        p, fs = _fs(spark, r[0])
        n += bool(fs.delete(p, False))
    return n


def write_patches(df: DataFrame, path: str) -> None:
    """Accepted patches as a table by path; partitions of sources that come again are replaced."""
    df.filter(F.col("patch").isNotNull()).select("path", "patch").write.mode("overwrite").parquet(path)


def plain(x: Any) -> Any:
    """What ``json`` can write: keys as text, numpy scalars and arrays as numbers and lists, rows as objects, sets sorted."""
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return [plain(v) for v in sorted(x, key=str)]
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def stringified(m: Column) -> Column:
    """A map's keys as text, for JSON."""
    return F.transform_keys(m, lambda k, _: k.cast("string"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file on any Hadoop path."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())


def write_json(spark: SparkSession, path: str, x: Any) -> None:
    write_text(spark, path, json.dumps(plain(x), indent=2, ensure_ascii=False))


def save_model(model: PipelineModel, folder: str, *, calibrator: tuple[float, float], threshold: float, target_fpr: float, gate: float, candidate: dict, versions: dict, saved_at: str) -> None:
    """A model with its calibrator, threshold, columns and manifest below ``folder``."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{folder}/{MODEL}")
    write_json(spark, f"{folder}/{THRESHOLD}", {"threshold": threshold, "target_fpr": target_fpr, "cfa_threshold": gate, "platt": calibrator})
    write_json(spark, f"{folder}/{SCHEMA}", {k: candidate[k] for k in ("candidate_name", "feature_set", "model_name", "feature_columns")})
    write_json(spark, f"{folder}/{MANIFEST}", {"saved_at_utc": saved_at, **versions, **{k: candidate[k] for k in ("candidate_name", "feature_set", "model_name")}, "threshold": threshold, "target_fpr": target_fpr, "cfa_threshold": gate})


def load_model(spark: SparkSession, folder: str, versions: dict) -> tuple[PipelineModel, dict, dict]:
    """Model, threshold and schema, or an error where a file is missing or two of them disagree."""
    read = {}
    for name in (THRESHOLD, SCHEMA, MANIFEST):
        p, fs = _fs(spark, f"{folder}/{name}")
        if not fs.exists(p):
            raise ValueError(f"missing artefact: {name}")
        read[name] = json.loads(read_text(spark, f"{folder}/{name}"))
    threshold, schema, manifest = (read[k] for k in (THRESHOLD, SCHEMA, MANIFEST))
    wrong = [k for k, v in versions.items() if manifest.get(k) != v]
    wrong += [k for k in ("candidate_name", "feature_set", "model_name") if schema[k] != manifest[k]]
    wrong += [k for k in ("threshold", "target_fpr", "cfa_threshold") if abs(threshold[k] - manifest[k]) > 1e-12]
    if wrong:
        raise ValueError(f"artefacts disagree on {wrong}")
    return PipelineModel.load(f"{folder}/{MODEL}"), threshold, schema


def save_tables(tables: dict[str, DataFrame], summary: Any, folder: str) -> None:
    """Each small table as one CSV file with a header, and the summary as JSON."""
    spark = SparkSession.getActiveSession()
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}.csv")
    write_json(spark, f"{folder}/summary.json", summary)


def save_audit(audit: DataFrame, folder: str, top: int = 20) -> None:
    """The feature audit whole, and the ``top`` riskiest features: those that tell the nuisance best."""
    save_tables({"feature_audit": audit, "feature_audit_top": audit.orderBy(F.desc("auc_abs"), "feature").limit(top)}, {"rows": audit.count(), "top": top}, folder)
