import random
from collections import Counter

import numpy as np

from tessera.llm import decontaminate as dc


def similar(a, b, k=5):
    """Weighted Jaccard of the shingles of two word lists; the item b sets the shingle size."""
    n = min(k, len(b))
    x, y = (Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def brute(text, items):
    w, out = dc.normal_words(text), []
    for i, t in items:
        b = dc.normal_words(t)
        if not w or not b:
            continue
        all_windows = [(similar(w[s : s + len(b)], b), -s) for s in range(max(1, len(w) - len(b) + 1))]
        s, at = max(all_windows)
        if s >= 0.8:
            out.append((i, s, -at))
    return out


def cases(seed, n_docs=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 5, 8, 15, 38, 59])))) for k in range(25)]
    items += [(90, None), (91, "  "), (92, "?!"), (93, items[4][1]), (94, "the of " * 12)]
    docs = []
    for _ in range(n_docs):
        w = [word() for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.7:
            p = (items[rng.randrange(len(items))][1] or "").split()
            for _ in range(rng.randrange(0, 3)):
                if p:
                    j = rng.randrange(len(p))
                    p[j : j + 1] = rng.choice([[], ["new"], [p[j], "more"], [p[j].upper() + ","], ["--", p[j]]])
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        docs.append(" ".join(w))
    return items, docs + [items[6][1], (items[3][1] + " ") * 3, "the of " * 40, "", "..."]


def test_matches_against_every_window():
    for seed in range(3):
        items, docs = cases(seed)
        m = dc.Matcher(items)
        for t in docs:
            assert m.matches(t) == brute(t, items)
        assert m.matches(None) == []


def test_block_index_is_exact():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a = np.r_[a, a[:9], a[:3] ^ np.uint64(1 << 40)]  # repeated and near fingerprints
    q = np.r_[a[:50] ^ np.uint64(0b1011), a[:20] ^ np.uint64(0xF00F00F00F00), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]
    for n in (5, dc.FEW, dc.FEW + 1, len(a)):
        for radius in (3, 10, 15):
            got = set(zip(*(x.tolist() for x in dc.BlockIndex(a[:n], radius).within(q)), strict=True))
            assert got == {(i, j) for i in range(len(q)) for j in range(n) if bin(int(q[i] ^ a[j])).count("1") <= radius}
    assert len(dc.BlockIndex(a[:0]).within(q)[0]) == len(dc.BlockIndex(a).within(q[:0])[0]) == 0


def test_the_index_admits_few_pairs():
    rng = np.random.default_rng(1)
    a, q = (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64) for n in (300, 3000))
    listed = {(x, y) for i, j in dc.BlockIndex(a).listed(q) for x, y in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(listed) < 0.05 * len(a) * len(q)


def test_running_counts():
    h = np.random.default_rng(2).integers(0, 1 << 63, 90, dtype=np.uint64)
    counts = dc.RunningCounts(h, 60)
    for m in range(1, 71):
        counts.grow()
        fps = counts.majority()
        for i in range(0, min(60, 90 - m + 1), 7):
            assert int(fps[i]) == dc.fingerprint(h[i : i + m]) == int(counts.majority(np.array([i]))[0])


def test_recall_of_edited_passages():
    rng, seen, found = random.Random(7), 0, 0
    items = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(15, 70)))) for k in range(200)]
    m = dc.Matcher(items)
    for i, t in items:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(1, 3)):  # edits near the ends leave most shingles
                at = rng.choice([0, 1, 2, len(w) - 1, len(w) - 2, rng.randrange(len(w))])
                w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"]])
            text = " ".join([*(f"x{rng.randrange(3000)}" for _ in range(30)), *w, *(f"y{rng.randrange(3000)}" for _ in range(30))])
            for j, s, at in brute(text, [(i, t)]):
                seen += 1
                found += (j, s, at) in m.matches(text)
    assert seen > 300 and found >= 0.97 * seen


def test_texts_together_and_long_texts(monkeypatch):
    items, docs = cases(4, 40)
    long = " ".join(docs[:30]) * 3
    want = [brute(t, items) for t in docs]
    m = dc.Matcher(items)
    assert m.matches(long) == brute(long, items)
    monkeypatch.setattr(dc, "CHUNK", 50)
    monkeypatch.setattr(dc, "TOGETHER", 300)
    assert m.matches_of([*docs, long]) == [*want, brute(long, items)]


def test_frames(spark, monkeypatch):
    items, docs = cases(9, 30)
    d = spark.createDataFrame([(k, t, "s", k) for k, t in enumerate(docs)] + [(500, None, None, 0)], "doc_id long, text string, source string, item_id long")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((k, *x) for k, t in enumerate(docs) for x in brute(t, items))
    assert sorted(tuple(r) for r in dc.matches(d, i).collect()) == want
    kept = dc.clean(d, i)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(len(docs)), 500} - {x[0] for x in want}
    monkeypatch.setattr(dc, "BLOCK_WORDS", 150)
    assert sorted(tuple(r) for r in dc.matches(d, i).collect()) == want
    assert dc.matches(d, i.limit(0)).count() == 0 and dc.clean(d, i.limit(0)).count() == len(docs) + 1
    assert dc.matches(d.limit(0), i).count() == 0
    twice = sorted(tuple(r) for r in dc.matches(d, i.unionByName(i.filter("item_id = 6"))).collect())
    assert twice == sorted(want + [x for x in want if x[1] == 6])  # a repeated item matches each time


def test_word_hashes():
    texts = ["", "  \t", "Ab, (cd) 'ef' g-h -- ab AB", "Straße ÉTÉ été", "ΟΔΟΣ οδος İx 𝐀b 😀ab ab😀", "x\u2003y\x1cz", "\ud800a a", "end"] + ["word " * 50]
    h, n = dc.hashed_words(texts)
    words = [dc.normal_words(t) for t in texts]
    assert n.tolist() == list(map(len, words))
    seen = {}
    for w, x in zip([w for ws in words for w in ws], h.tolist(), strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(dc.hashed_words([])[0]) == 0
