"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of byte 1- to 3-grams that both hold,
over the geometric mean of how many each holds (n-grams of the lower-cased text, hashed to 2**14 places).
A set of landmark texts spans the kernel's feature space (Nyström), in which one-versus-rest ridge
regression is solved; texts are scored by matrix products of their presence rows with the landmarks' and
of those kernel values with the classes' coefficients.

The fit uses a bounded sample of every language: ``PER_CLASS`` rows, or fewer where there are so many
languages that ``ROWS`` would be exceeded, but ``LEAST`` at least. The ``LANDMARKS`` rows shared out evenly
over the languages, or ``LEAST`` of each if that is more, whose keys hash lowest are landmarks. Only bit
maps of 2 KB a row come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import ngrams
from tessera.llm.common import fold

ORDERS, BITS = (1, 2, 3), 14
#: Rows of each language to learn from, rows in all, landmarks in all, and the least of both that a language has.
PER_CLASS, ROWS, LANDMARKS, LEAST = 600, 24_000, 192, 4
#: Ridge penalty, and the steepness that turns regression values into a probability.
RIDGE, STEEP = 1e-2, 4.0


def presence(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Blocks of presence rows (uint8)."""
    for _, block in ngrams.flags([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], ORDERS, BITS):
        yield block


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages, the landmarks' presence rows (scaled) as columns, and the coefficients."""

    names: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def kernel(self, block: np.ndarray) -> np.ndarray:
        x = block.astype(np.float32)
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for block in presence(texts):
            f = self.kernel(block) @ self.coefficients
            e = np.exp(STEEP * (f - f.max(axis=1, keepdims=True)))
            p = e / e.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names += [self.names[k] for k in best.tolist()]
            scores += p[np.arange(len(p)), best].astype(float).tolist()
        for i, t in enumerate(texts):
            if not has_letter(t):
                names[i], scores[i] = "und", 0.0
        return names, scores


def fit_rows(rows: np.ndarray, langs: list[str]) -> Model:
    """Ridge regression on the landmark kernel; rows are presence rows in order of preference."""
    names = sorted(set(langs))
    place = {n: k for k, n in enumerate(names)}
    y = np.array([place[x] for x in langs])
    share = max(LEAST, LANDMARKS // len(names))
    marks = np.concatenate([np.flatnonzero(y == k)[:share] for k in range(len(names))])
    z = rows[marks].astype(np.float32)
    z = np.ascontiguousarray((z / np.sqrt(np.maximum(z.sum(axis=1, keepdims=True), 1))).T)
    m = Model(names, z, np.zeros((len(marks), len(names)), np.float32))
    k_nm = np.concatenate([m.kernel(rows[i : i + 512]) for i in range(0, len(rows), 512)]).astype(np.float64)
    k_mm = k_nm[marks]
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # landmark kernel to orthonormal features
    phi = k_nm @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y][:, None]
    w = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * np.eye(phi.shape[1]), phi.T @ (weight * target))
    m.coefficients = (root @ w).astype(np.float32)
    return m


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, per_class: int = PER_CLASS) -> Model | None:
    """Fit on rows with a language and a letter in the text, outside ``held_out`` (on the key, named ``k``).

    Null keys may be learned from; repeated rows count once; no language is left out. None without such rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    if held_out is not None:
        d = d.filter(~held_out)
    n = d.groupBy("lang").count().collect()  # a row per language, as many as the model has
    if not n:
        return None
    per_class = max(LEAST, min(per_class, ROWS // len(n)))
    share = [(r["lang"], 3.0 * per_class / r["count"]) for r in n]
    share = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, share double"))
    hashed = F.xxhash64("k", "text")
    picked = d.join(share, "lang").filter((F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)) < F.col("share"))
    picked = picked.withColumn("h", hashed).dropDuplicates(["lang", "h"]).select("lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            bits = [np.packbits(r).tobytes() for block in presence(texts) for r in block]
            ok = pa.array([has_letter(t) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary())], names=["lang", "h", "bits"]).filter(ok)

    got = picked.mapInArrow(run, "lang string, h long, bits binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["h"]))
    kept, seen = [], {}
    for r in got:
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= per_class:
            kept.append(r)
    if not kept:
        return None
    rows = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in kept), np.uint8)).reshape(len(kept), -1)
    return fit_rows(rows, [r["lang"] for r in kept])


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row.

    ``und`` with score 0 for null texts, texts without a letter, and where there is no model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            names, scores = shared.value.predict(texts) if shared.value else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(key: Column) -> Column:
    """Whether a key is kept from learning: crc32 of it as text, modulo 5, is 0."""
    return fold(key, 5) == 0
