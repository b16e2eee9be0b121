"""Quality classifier: naive Bayes features with a linear support vector machine.

Features are the presence of the byte 1- to 3-grams of the whole text, hashed to 2**16 places. Indicators
are scaled by the log-count ratio of the two classes; the hinge loss is minimised by dual coordinate
descent, the rarer class weighted up. A logistic curve fitted on labelled rows that the machine has not
seen turns margins into scores.

The fit uses at most ``FIT_ROWS`` labelled rows, those whose keys hash lowest; they come to the driver as
lists of places. Scoring maps over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import ngrams
from tessera.llm.common import fold

#: Most labelled rows to learn from.
FIT_ROWS = 12_000
#: Share of them kept back for the logistic curve: one in this many.
CALIBRATE = 5
ORDERS, BITS = (1, 2, 3), 16
#: Score from which a text counts as good.
THRESHOLD = 0.3


def places(texts: list[str | None]) -> list[np.ndarray]:
    """The features present in each text, as sorted places."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return [np.flatnonzero(row).astype(np.uint16) for _, block in ngrams.flags(raw, ORDERS, BITS) for row in block]


@dataclass
class Model:
    """Weights of the places (ratio times weight), bias, and the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = np.array([self.weights[p].sum(dtype=np.float64) for p in places(texts)]) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def log_ratio(rows: list[np.ndarray], y: np.ndarray, d: int) -> np.ndarray:
    """log((p/|p|)/(q/|q|)), p and q the smoothed counts of the places in rows of class 1 and 0."""
    counts = [np.ones(d), np.ones(d)]
    for x, label in zip(rows, y, strict=True):
        counts[int(label)][x] += 1
    q, p = (c / c.sum() for c in counts)
    return np.log(p / q)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 0.01, epochs: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine on scaled indicators.

    Each step solves one dual variable exactly within [0, c of its class]; the bias is a constant feature.
    """
    rng, sign = np.random.default_rng(seed), np.where(y > 0, 1.0, -1.0)
    bound = c * np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y <= 0).mean(), 1e-9))
    w, b, a = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    own = [scale[x] for x in rows]
    norm = [float(s @ s) + 1 for s in own]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, s = rows[i], own[i]
            g = sign[i] * (float(w[x] @ s) + b) - 1
            new = min(max(a[i] - g / norm[i], 0.0), bound[i])
            step = (new - a[i]) * sign[i]
            if step:
                w[x] += step * s
                b, a[i], moved = b + step, new, max(moved, abs(step) / bound[i])
        if moved < 1e-3:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps, with Platt's smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([(margin * (p - t)).sum(), (p - t).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum() + 1e-9, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """A model of labelled rows; with fewer than two of a class, the share of class 1 for every text."""
    back = np.arange(len(y)) % CALIBRATE == 0
    if len(y) < 10 or any(((y > 0)[s] == k).sum() < 1 for s in (back, ~back) for k in (True, False)):
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    learn = [x for x, k in zip(rows, back, strict=True) if not k]
    r = log_ratio(learn, y[~back], 1 << BITS)
    w, b = dual_descent(learn, y[~back], r)
    weights = w * r
    margin = np.array([weights[x].sum() for x, k in zip(rows, back, strict=True) if k]) + b
    return Model(weights.astype(np.float32), b, *logistic(margin, y[back]))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: Column | None = None, most: int = FIT_ROWS) -> Model:
    """Fit on labelled documents outside ``held_out`` (a condition on the key, named ``k`` in it).

    Several labels of a key are averaged and 0.5 counts as 1; null keys, labels and unlabelled rows take
    no part; repeated documents count each, as far as the bound allows.
    """
    y = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("double").alias("y")).dropna()
    if held_out is not None:
        y = y.filter(~held_out)
    y = y.groupBy("k").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)
    d = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.tobytes() for p in places(b.column(2).to_pylist())], pa.binary())], names=["k", "y", "places"])

    seen = d.join(F.broadcast(y), "k").select("k", "y", "text").mapInArrow(run, "k long, y int, places binary")  # y has at most ``most`` rows
    got = seen.orderBy(F.xxhash64("k"), "k", "places").limit(most).toArrow()
    return fit_rows([np.frombuffer(x, np.uint16) for x in got["places"].to_pylist()], np.array(got["y"].to_pylist(), np.int64))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null counts as empty, further columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below the threshold; columns and all other rows stay as they are.

    Null text counts as empty, and empty texts are scored like any other; rows with null keys and repeated
    rows are judged by their texts alone, which are read whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()) >= threshold)

    return docs.filter(good(F.coalesce(F.col(text_col), F.lit(""))))


def held_out(key: Column) -> Column:
    """Whether a key is kept from learning: crc32 of it as text, modulo 5, is 0."""
    return fold(key, 5) == 0
