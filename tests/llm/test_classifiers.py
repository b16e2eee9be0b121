import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, nbsvm, ngrams

SF = "/root/testdata/sf0.01"


def fold(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_flags_against_sets(monkeypatch):
    monkeypatch.setattr(ngrams, "TEXT_BYTES", 64)
    monkeypatch.setattr(ngrams, "FLAG_BYTES", 4 << 10)
    rng = random.Random(0)
    texts = [bytes(rng.randrange(97, 105) for _ in range(n)) for n in (0, 1, 2, 3, 10, 500, 63, 64, 65, 1, 0)]
    rows = [r for _, block in ngrams.flags(texts, (1, 2, 3), 10) for r in block]
    for t, r in zip(texts, rows, strict=True):
        want = {int(ngrams.codes(np.frombuffer(t[i : i + n], np.uint8), n, 10)[0]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}
        assert set(np.flatnonzero(r)) == want


def test_kernel_is_the_normalised_count_of_shared_ngrams():
    texts, langs = ["abc abd", "xyz xyy", "abd bcd", "zyx yyx"], ["a", "b", "a", "b"]
    rows = np.concatenate(list(langid.presence(texts)))
    m = langid.fit_rows(rows, langs)
    marks = [0, 2, 1, 3]
    for i in range(4):
        for j, k in enumerate(marks):
            want = (rows[i] & rows[k]).sum() / np.sqrt(float(rows[i].sum()) * rows[k].sum())
            assert abs(m.kernel(rows[i : i + 1])[0, j] - want) < 1e-5
    assert m.predict(texts)[0] == langs


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs, held_out=langid.held_out(F.col("k")))).collect()}
    held = [r for r in docs.collect() if fold(r["doc_id"], 5) == 0]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_texts_have_no_language(spark):
    rows = [(1, "the words are here", "en", 9), (2, "les mots sont ici", "fr", 9), (3, None, "en", 9), (4, "123 !?", "fr", 9), (5, "", None, 9), (6, "more words", None, 9), (6, "more words", None, 9), (None, "et les mots", "fr", 9), (8, "word " * 100_000, "en", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.predict(df, langid.fit(df)).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(rows) and {by[k] for k in (3, 4, 5)} == {"und"} and by[1] == by[8] == "en" and by[2] == by[None] == "fr"
    assert langid.fit(df.limit(0)) is None
    assert [r["lang_pred"] for r in langid.predict(df.filter("doc_id = 1"), None).collect()] == ["und"]
    assert langid.predict(df.limit(0), langid.fit(df)).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r["score"] for r in nbsvm.score(docs, nbsvm.fit(docs, labels, held_out=nbsvm.held_out(F.col("k")))).collect()}
    held = [r for r in labels.collect() if fold(r["doc_id"], 5) == 0]
    good, bad = ([got[r["doc_id"]] for r in held if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= nbsvm.THRESHOLD for g in good]) > 0.97


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 120)
    rows = [np.flatnonzero(rng.random(12) < np.where(np.arange(12) < 6, 0.2 + 0.5 * k, 0.7 - 0.5 * k)).astype(np.uint16) for k in y]
    r = nbsvm.log_ratio(rows, y, 12)
    w, b = nbsvm.dual_descent(rows, y, r, c=0.5, epochs=2000)
    x = np.zeros((120, 12))
    for i, p in enumerate(rows):
        x[i, p] = r[p]
    sign, weight = np.where(y > 0, 1, -1), 0.5 * np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean())
    loss = lambda w, b: 0.5 * (w @ w + b * b) + (weight * np.maximum(0, 1 - sign * (x @ w + b))).sum()
    best = loss(w, b)
    assert all(loss(w + 0.05 * rng.standard_normal(12), b + 0.05 * rng.standard_normal()) >= best - 1e-6 for _ in range(300))


def test_quality_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b c", "z"), (2, "", "y"), (4, "no " * 100_000, "q")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (9, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    m = nbsvm.fit(df, labels)
    got = nbsvm.score(df, m).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert nbsvm.keep_good(df, m).columns == df.columns
    assert nbsvm.score(df.limit(0), nbsvm.fit(df.limit(0), labels.limit(0))).count() == 0


def test_many_languages(spark):
    rng, rows = random.Random(5), []
    for k in range(130):
        own = [chr(97 + k % 26) + chr(97 + k // 26) + rng.choice("aeiou") + chr(97 + (7 * k) % 26) + c for c in "xyzkq"]
        rows += [(1000 * k + i, " ".join(rng.choice(own) for _ in range(30)), f"l{k}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    m = langid.fit(df)
    assert m.names == sorted({f"l{k}" for k in range(130)})
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, m).collect()}
    assert {got[i] for i, _, _ in rows} == set(m.names)
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95


def test_scores_against_the_definitions():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcd ") if k % 2 else list("cdef "), 60)) for k in range(80)]
    y = np.arange(80) % 2
    rows = np.concatenate(list(langid.presence(texts)))
    m = langid.fit_rows(rows, [str(k) for k in y])
    marks = np.concatenate([np.flatnonzero(y == k)[:96] for k in (0, 1)])
    kernel = lambda a, b: (a.astype(float) @ b.T.astype(float)) / np.sqrt(np.outer(a.sum(axis=1, dtype=float), b.sum(axis=1, dtype=float)))
    nm, mm = kernel(rows, rows[marks]), kernel(rows[marks], rows[marks])
    # kernel ridge regression with the landmarks' kernel as penalty, both classes weighted alike
    w, target = np.full((80, 1), 80 / (2 * 40)), np.where(y[:, None] == [0, 1], 1.0, -1.0)
    alpha = np.linalg.lstsq(nm.T @ (w * nm) + langid.RIDGE * mm, nm.T @ (w * target), rcond=None)[0]
    f = nm @ alpha
    p = np.exp(langid.STEEP * f) / np.exp(langid.STEEP * f).sum(axis=1, keepdims=True)
    names, scores = m.predict(texts)
    assert names == [str(k) for k in p.argmax(axis=1)] and np.allclose(scores, p.max(axis=1), atol=1e-3)

    places = nbsvm.places(texts)
    m = nbsvm.fit_rows(places, y)
    learn = np.arange(80) % nbsvm.CALIBRATE > 0
    r = nbsvm.log_ratio([x for x, ok in zip(places, learn, strict=True) if ok], y[learn], 1 << nbsvm.BITS)
    some = [int(places[0][0]), int(places[1][-1]), 7]
    for j in some:
        p1, p0 = (1 + sum(j in x for x, z, ok in zip(places, y, learn, strict=True) if ok and z == k) for k in (1, 0))
        n1, n0 = ((1 << nbsvm.BITS) + sum(len(x) for x, z, ok in zip(places, y, learn, strict=True) if ok and z == k) for k in (1, 0))
        assert abs(r[j] - np.log((p1 / n1) / (p0 / n0))) < 1e-9
    w, b = nbsvm.dual_descent([x for x, ok in zip(places, learn, strict=True) if ok], y[learn], r)
    margin = np.array([sum(w[j] * r[j] for j in x) for x in places]) + b
    assert np.allclose(m.score(texts), 1 / (1 + np.exp(-(m.slope * margin + m.shift))), atol=1e-4)
