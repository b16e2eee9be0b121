import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import gru, lm

SHAPE = gru.Shape((0, 2, 5, 6, 7, 8))


def plain_log_likelihood(p, shape, text):
    """One step at a time, the probabilities of all tokens in full."""
    h, x, total = np.zeros(gru.HIDDEN), shape.size, 0.0
    s = lambda v: 1 / (1 + np.exp(-v))
    n = gru.HIDDEN
    for y in text:
        a, v = p["embed"][x] @ p["w"] + p["b"], h @ p["u"]
        z, r = s(a[:n] + v[:n]), s(a[n : 2 * n] + v[n : 2 * n])
        h = (1 - z) * np.tanh(a[2 * n :] + r * v[2 * n :]) + z * h
        soft = lambda u: np.exp(u - u.max()) / np.exp(u - u.max()).sum()
        q = soft(h @ p["class_w"] + p["class_b"])
        every = np.concatenate([q[c] * soft((h @ p["word_w"] + p["word_b"])[a:b]) for c, (a, b) in enumerate(zip(shape.bounds, shape.bounds[1:]))])
        assert abs(every.sum() - 1) < 1e-5
        total, x = total + math.log(every[y]), y
    return total


def texts(seed, n=40):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, SHAPE.size, k) for k in [0, 1, 2, 200, *rng.integers(1, 90, n)]]


def params(seed=0):
    p = gru.fresh(SHAPE, np.arange(1.0, SHAPE.size + 1))
    rng = np.random.default_rng(seed)
    return {k: v + 0.3 * rng.standard_normal(v.shape).astype(np.float32) for k, v in p.items()}


def test_score_carries_the_state_over_windows(monkeypatch):
    monkeypatch.setattr(gru, "WINDOW", 7)
    monkeypatch.setattr(gru, "LANES", 5)
    p, t = params(), texts(1)
    assert gru.score(p, SHAPE, t) == pytest.approx([plain_log_likelihood(p, SHAPE, x) for x in t], abs=1e-3)


def test_gradients():
    p = {k: v.astype(np.float64) for k, v in params(3).items()}
    rng = np.random.default_rng(2)
    x, y, used = rng.integers(0, SHAPE.size, (6, 4)), rng.integers(0, SHAPE.size, (6, 4)), rng.random((6, 4)) < 0.8
    h = rng.standard_normal((4, gru.HIDDEN)) * 0.5

    def f(q):
        states = np.empty((6, 4, gru.HIDDEN))
        hh = h
        for t in range(6):
            a, v, n = q["embed"][x[t]] @ q["w"] + q["b"], hh @ q["u"], gru.HIDDEN
            s = 1 / (1 + np.exp(-(a[:, : 2 * n] + v[:, : 2 * n])))
            c = np.tanh(a[:, 2 * n :] + s[:, n:] * v[:, 2 * n :])
            hh = states[t] = c + s[:, :n] * (hh - c)
        log_softmax = lambda u: u - np.log(np.exp(u).sum(axis=1, keepdims=True))
        lp = log_softmax(states[used] @ q["class_w"] + q["class_b"])
        kinds, out = SHAPE.class_of()[y[used]], 0.0
        for i, k in enumerate(kinds):
            out -= lp[i, k]
            a, b = SHAPE.bounds[k], SHAPE.bounds[k + 1]
            w = (states[used][i] @ q["word_w"] + q["word_b"])[None, a:b]
            out -= log_softmax(w)[0, y[used][i] - a]
        return out / used.sum()

    # gradients run in single precision
    loss, g, _ = gru.gradients(p, SHAPE, SHAPE.class_of(), p["embed"] @ p["w"] + p["b"], x, y, used, h)
    assert loss == pytest.approx(f(p), rel=1e-4)
    for k in p:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-4
            down[k][at] -= 1e-4
            assert g[k][at] == pytest.approx((f(up) - f(down)) / 2e-4, abs=2e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    data = [np.array([0, 5, 1, 6] * 10)[: rng.integers(4, 40)] for _ in range(300)]
    p = gru.fresh(SHAPE, np.bincount(np.concatenate(data), minlength=SHAPE.size).astype(float))
    before = gru.score(p, SHAPE, data).sum()
    for _ in range(8):
        p, seen, _ = gru.train(p, SHAPE, data, rate=0.02, lanes=16, steps=8)
    assert seen == sum(map(len, data)) and gru.score(p, SHAPE, data).sum() > 0.5 * before


def docs(n=400):
    rng = random.Random(4)
    langs = [[f"{k}{i}" for i in range(60)] for k in "abc"]
    out = [(i, " ".join(rng.choice(langs[i % 3]) if rng.random() < 0.95 else f"Rare{rng.randrange(9999)}" for _ in range(rng.randrange(1, 80)))) for i in range(n)]
    return out + [(5000, None), (5001, " \t"), (7, "a1 a2"), (7, "a1 a2"), (5002, "neverseen neverseen WORD"), (None, "a1")]


def base(rows):
    words = lambda t: [*(t or "").encode().lower().split(), None]
    kept = [w for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for w in words(t)]
    c = Counter(kept)
    out = []
    for i, t in rows:
        w = words(t)
        out.append((i, len(w), sum(c[x] > 0 for x in w), len(kept), sum(math.log10((c[x] + 1) / (len(kept) + len(c) + 1)) for x in w)))
    return out


@pytest.mark.parametrize("table", [300_000, 40])
def test_documents(spark, monkeypatch, table):
    monkeypatch.setattr(lm, "TABLE", table)
    rows = docs()
    df = spark.createDataFrame([(t, i, 1.0) for i, t in rows], "text string, doc_id long, score double").repartition(3)
    got = lm.score(df, lm.held_out(F.col("doc_id"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    got, want = sorted(map(tuple, got), key=key), sorted(base(rows), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-6)
    held = [g for g in got if g[0] is not None and zlib.crc32(str(g[0]).encode()) % 7 == 2]
    assert sum(g[5] for g in held) > sum(g[4] for g in held)
    assert all(g[5] < 0 for g in got)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(df, F.lit(True)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0 and got[1]["n_known"] == 0 and math.isfinite(got[1]["score"])
    assert lm.score(df.limit(0), F.lit(False)).count() == 0


def test_learns_from_whole_texts(spark):
    rows = [*docs(60), (7001, "b1 " * 900 + "c1"), (7002, "b1 " * 900 + "c1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit(True))
    words = Counter(w for _, t in rows for w in lm.words_of(t and t.encode()))
    tail = np.zeros((2, lm.TAIL))
    for w, c in words.items():
        tail[:, lm.tail_of(w)] += c, 1
    packed = ("whole texts", b" ".join(words), np.array(list(words.values())), len(rows), *tail, 0.5)
    v = lm.Vocabulary(list(words), *packed[2:])
    got = lm.read(df, spark.sparkContext.broadcast(packed)).collect()
    want = [v.read([(t or "").encode()]).tokens.tolist() for _, t in rows]
    assert sorted(np.frombuffer(r["tokens"], "<u2").tolist() for r in got) == sorted(want)
    assert len({r["key"] for r in got}) == len(set(rows))  # copies of a text are spread over tasks


@pytest.mark.parametrize("table", [300_000, 40])
def test_score_against_brute_force(spark, monkeypatch, table):
    monkeypatch.setattr(lm, "TABLE", table)
    monkeypatch.setattr(lm, "HEAD", 30)
    monkeypatch.setattr(lm, "LEARN", 30_000)
    rows = [(i, t) for i, t in docs(200)] + [(9000, "a1 b2 c3 Unheard " * 700)]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("train", ~lm.held_out(F.col("doc_id")))
    known = lm.count(df.filter("train").select("text"))
    read = lm.read(df, known.vocabulary)
    p, v = lm.fit(read.filter("train"), known.words), known.words
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    ranked = sorted((w for w in c if w is not None), key=lambda w: (-c[w], w))
    place = {w: int(v.table.find(*lm.units.words([w])[4:])[0]) for w in c if w is not None}
    head, tail = {w for w in ranked[:30] if place[w] >= 0}, [w for w in ranked if w not in set(ranked[:30])]
    once, twice = (sum(c[w] == k for w in ranked) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    n, types = Counter(), Counter()
    for w in tail:
        n[lm.tail_of(w)] += c[w]
        types[lm.tail_of(w)] += 1

    def brute(t):
        tokens, share = [], 0.0
        for w in words(t):
            if w is None or w in head:
                tokens.append(v.end if w is None else int(v.token[place[w]]))
                continue
            j = lm.tail_of(w)
            tokens.append(int(v.tails[j]))
            if n[j]:
                share += math.log10((c[w] - d if c[w] else d * types[j]) / n[j])
        return share + plain_log_likelihood(p, v.shape, tokens) / math.log(10)

    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.scores(read, known, p).collect()}
    assert head == set(ranked[:30])
    for i, t in rows:
        assert got[i, len(words(t))] == pytest.approx(brute(t), rel=1e-4, abs=1e-3)


def test_shares_of_a_tail_token_add_up_to_one():
    words, counts = [b"xaa", b"yaa", b"zaa", b"qbb"], np.array([5, 1, 1, 2])
    n, types = np.zeros((2, lm.TAIL))
    for w, k in zip(words, counts, strict=True):
        n[lm.tail_of(w)] += k
        types[lm.tail_of(w)] += 1
    v = lm.Vocabulary(words, counts, 3, n, types, 0.4, head=0)
    j = lm.tail_of(b"xaa")
    own = [10 ** (v.share_log[i] - v.tail_log[v.tails[j]]) for i in range(3)] + [10 ** (v.unseen_log[j] - v.tail_log[v.tails[j]])]
    assert sum(own) == pytest.approx(1)


def test_held_out_documents_gain_over_the_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in lm.score(df, lm.held_out(F.col("doc_id"))).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got)  # a tenth fewer bits
    assert np.mean([r["score"] < r["base_score"] for r in got]) < 0.01


def test_long_texts_in_small_pools(spark, monkeypatch):
    monkeypatch.setattr(lm, "POOL", 500)
    monkeypatch.setattr(lm, "COUNTED", 20)
    rng = random.Random(9)
    rows = [(i, " ".join(f"a{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 700, 5000])))) for i in range(30)]
    got = sorted(lm.score(spark.createDataFrame(rows, "doc_id long, text string"), lm.held_out(F.col("doc_id"))).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in base(rows)] and all(math.isfinite(r["score"]) for r in got)


def test_reading_against_splitting():
    rng = random.Random(12)
    texts = [b"", b" \t\n", b"one", *(bytes(rng.choice(b"abC \x0b\n\xc3\xa9.") for _ in range(rng.randrange(80))) for _ in range(300))]
    every = Counter(w for t in texts for w in lm.words_of(t))
    some = sorted(every)[::2]
    tail = np.zeros((2, lm.TAIL))
    for w, k in every.items():
        tail[:, lm.tail_of(w)] += k, 1
    v = lm.Vocabulary(some, np.array([every[w] for w in some]), len(texts), *tail, 0.3, head=5)
    r, at = v.read(texts), 0
    for i, t in enumerate(texts):
        words = lm.words_of(t)
        own = r.tokens[at : r.ends[i] + 1]
        assert own.tolist() == [int(v.token[some.index(w)]) if w in some else int(v.tails[lm.tail_of(w)]) for w in words] + [v.end]
        rare = Counter(w for w in words if w not in some)
        assert dict(zip(r.rare[r.offsets[i] : r.offsets[i + 1]], r.times[r.offsets[i] : r.offsets[i + 1]].tolist(), strict=True)) == rare
        assert r.known[i] == sum(w in some for w in words) + 1 and r.log_c[i] == pytest.approx(sum(math.log10(every[w] + 1) for w in words if w in some) + math.log10(len(texts) + 1))
        at = r.ends[i] + 1
