import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash as sh
from tessera.llm.components import components


def plain(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint(monkeypatch):
    texts = [None, "", "  \t", "One", "a b", "A b c", "x y z x y z x y z", "é Ü ß q r", "w%d " * 900 % tuple(range(900))]
    assert [sh.fingerprint(t) for t in texts] == [plain(t) for t in texts]
    monkeypatch.setattr(sh, "CHUNK", 100)
    assert sh.fingerprint(texts[-1]) == plain(texts[-1])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_pairs_within_radius_share_an_anchor(x, flips):
    y = x
    for i in flips:
        y ^= 1 << i
    (a, home), (b, other) = (sh.anchors(np.array([v], np.uint64)) for v in (x, y))
    assert set(a[home]) & set(b[0]) or set(b[other]) & set(a[0])
    for v, anchor in ((x, a[0]), (y, b[0])):
        halves = [v & 0xFFFFFFFF, v >> 32]
        assert all(bin(halves[t >> 32] ^ (t & 0xFFFFFFFF)).count("1") <= 2 for t in map(int, anchor))


def test_every_half_is_covered():
    x = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    a, home = sh.anchors(x)
    assert (np.bitwise_count((a[home].reshape(-1, 2)[:, 0]).astype(np.uint64) ^ (x & np.uint64(0xFFFFFFFF))) <= 1).all()


def test_groups_against_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(120)) for _ in range(60)]
    rows = []
    for t in base:
        rows.append(t)
        for _ in range(rng.randrange(6)):
            w = t.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "new"
            rows.append(" ".join(w))
    rows += [None, "", " \n", base[0], base[0].upper(), *["same text here twice"] * 40]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i * 7 % 1000 + 1, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, fp int").repartition(5)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in sh.group(docs).collect()}
    ids = {i * 7 % 1000 + 1: plain(t) for i, t in enumerate(rows)}
    pairs = [(a, b) for a in ids for b in ids if a < b and bin(ids[a] ^ ids[b]).count("1") <= 3]
    want = joined(pairs, ids)
    assert got == {i: (ids[i], want[i]) for i in ids}
    kept = {r["doc_id"] for r in sh.keep_one(docs).collect()}
    assert kept == set(want.values())


def test_large_sets_give_linear_links():
    rng = np.random.default_rng(5)
    fp = np.unique(np.uint64(0xF0F0) ^ (np.uint64(1) << rng.integers(0, 20, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 3000).astype(np.uint64)))
    fp = np.r_[fp, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]
    got = sh.links_of_set(fp)
    assert len(got) < len(fp)
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if bin(int(fp[i] ^ fp[j])).count("1") <= 3]
    assert joined(got, range(len(fp))) == joined(pairs, range(len(fp)))


def test_repeated_and_missing_keys(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, "zz")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in sh.keep_one(docs).collect()) == ["1", "3"]
    empty = docs.limit(0)
    assert sh.group(empty).count() == 0 and sh.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == joined([p for p in pairs if p[0] != p[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept(spark, rows):
    docs = spark.createDataFrame([(t, "x", i) for i, t in rows], "text string, fp string, doc_id long").repartition(3)
    out = sh.keep_one(docs)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_repeated_keys_keep_one_row_of_each_group(spark):
    a, b, c, d = (" ".join(f"{seed}{i}" for i in range(60)) for seed in "abcd")
    assert kept(spark, [(3, b), (5, a), (5, b)]) == [(3, b), (5, a)]
    assert kept(spark, [(5, a), (5, c)]) == sorted([(5, a), (5, c)], key=str)
    assert kept(spark, [(None, a), (None, a), (None, b)]) == sorted([(None, a), (None, b)], key=str)
    assert kept(spark, [(None, a), (7, a), (7, a)]) == [(7, a)]
    rows = [(5, a), (5, b), (3, b), (8, a), (9, c), (9, c), (9, d), (None, a), (None, None), (11, ""), (12, " \n")]
    assert kept(spark, rows) == sorted([(5, a), (3, b), (9, c), (9, d), (11, "")], key=str)


def test_many_copies_and_a_long_text(spark):
    long = "very long text " + " ".join(f"w{i % 9000}" for i in range(60_000))
    rows = [(i, "one text of many copies here") for i in range(400)] + [(1000, long), (1001, long + " end")]
    assert [i for i, _ in kept(spark, rows)] == [0, 1000]
