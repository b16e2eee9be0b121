import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight, the excess above the cap dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, free, out = sum(sizes.values()), set(order), {}
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 998, "d": 5, None: 7}, {"a": 0, "b": 10, "é": 3}, {"x": 4}, {"a": 0}])
@pytest.mark.parametrize("most", [100_000, 0])
def test_targets(spark, monkeypatch, sizes, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(sizes), rel=1e-9)


def test_mix_repeats_rows(spark):
    rows = [(k, "w " * (k % 50), "abc"[k % 3] if k % 7 else None, k) for k in range(2000)] + [(5000, None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate long")
    c = mixing.copies(docs)
    rate = F.col("target") / F.col("source_size")
    spread = F.sum(F.col("size") * F.col("size") * (rate % 1) * (1 - rate % 1))  # the variance of independent draws
    for r in c.groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("t"), F.first("target").alias("target"), spread.alias("v")).collect():
        assert abs(r["t"] - r["target"]) <= 5 * r["v"] ** 0.5
    assert c.agg(F.max("n_copies")).first()[0] <= 3
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    a = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    b = {r["doc_id"]: r["n_copies"] for r in c.collect() if r["n_copies"]}
    assert a == b


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.copies(docs).count() == 0 and mixing.mix(docs).count() == 0


def odd(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (None, "d e", None), (4, "w " * 200_000, "y"), (5, "z", "x")]
    return spark.createDataFrame([(s, t, i, k) for k, (i, t, s) in enumerate(rows)], "source string, text string, doc_id long, size long")


@pytest.mark.parametrize("most", [100_000, 0])
def test_odd_rows_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    docs = odd(spark)
    c = mixing.copies(docs)
    got = sorted(map(tuple, c.collect()), key=str)
    assert got == sorted(map(tuple, mixing.copies(docs.repartition(3)).collect()), key=str)  # reruns agree
    sizes = {"x": 7, "y": 200_000, None: 2}
    want = filled(sizes)
    assert len(got) == 7 and all(r[3] == sizes[r[1]] and r[4] == pytest.approx(want[r[1]]) for r in got)
    assert len({r[5] for r in got if r[0] == 1}) == 1
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert taken == {i: sum(r[5] for r in got if r[0] == i) for i in {r[0] for r in got} if sum(r[5] for r in got if r[0] == i)}
