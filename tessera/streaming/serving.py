"""Scores of single images and of tables of patches by a saved model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import at_least, gated
from tessera.operators import contracts, kernels, models
from tessera.sources import artifacts, images

# Columns that the gate multiplies, and their names after it.
GATED = ("cfa_rg_pi_xy", "cfa_bg_pi_xy", "cfa_rgb_pi_xy_mean", "cfa_rgb_pi_xy_gap")


class Scorer:
    """A model folder that was checked, ready to score.

    ``predict`` is the small path for images in memory; ``score`` is a plan over a table of patches.
    """

    def __init__(self, spark: SparkSession, folder: str, versions: dict[str, str]):
        self.spark, self.versions = spark, versions
        self.model, self.threshold, self.schema = artifacts.load_model(spark, folder, versions)

    def health(self) -> dict:
        """What is loaded."""
        return {"status": "ok", "candidate": self.schema["candidate_name"], "n_features": len(self.schema["feature_columns"]), "threshold": self.threshold["threshold"], **self.versions}

    def _scored(self, features: DataFrame, ids: list[str]) -> DataFrame:
        gate = at_least(F.col("cfa_validity_score"), F.lit(float(self.threshold["cfa_threshold"]))).cast("double")
        d = features.withColumns({f"{c}_gated": gated(F.col(c), gate) for c in GATED})
        slope, intercept = self.threshold["platt"]
        return models.scored(self.model, d, ids, slope, intercept, self.threshold["threshold"])

    def score(self, patches: DataFrame, id_col: str = "path", patch_col: str = "patch", n: int = 248) -> DataFrame:
        """Ids with raw score, probability, its logit, prediction and route of a table of patches; patches that fail are left out."""
        return self._scored(kernels.extract(patches, id_col, patch_col, n).filter("status = 'ok'"), [id_col])

    def predict(self, contents: list[bytes]) -> list[dict]:
        """One result per image: its status, and where that is ok the probability, prediction and route."""
        out, rows = [], []
        for k, data in enumerate(contents):
            if not data or len(data) > contracts.MOST_BYTES:
                out.append({"status": "empty" if not data else "too large"})
                continue
            head, pixels = images.header(data), images.decoded(self.spark, data)
            try:
                if pixels is None:
                    raise ValueError("DECODE_ERROR")
                if head["format"] not in ("JPEG", "PNG") or head["mode"] not in ("RGB", "RGBA"):
                    raise ValueError("UNSUPPORTED_INPUT")
                rows.append((k, *map(float, kernels.features(images.canonical(pixels, head["orientation"] or 1)))))
                out.append({"status": "ok"})
            except ValueError as e:
                out.append({"status": str(e)})
        if rows:
            df = self.spark.createDataFrame(rows, "k int, " + ", ".join(f"{f} double" for f in kernels.FEATURES))
            for r in self._scored(df, ["k"]).collect():  # the images that were given
                out[r["k"]] |= {"prob_ai": r["prob"], "logit": r["logit"], "pred_ai": r["pred"], "level": r["route"]["level"], "action": r["route"]["action"]}
        assert all(math.isfinite(x["prob_ai"]) for x in out if x["status"] == "ok")
        return out
