"""Language-model scores of whole documents.

1. All words of the training documents are counted, in workers first and then by word.
2. The ``HEAD`` most frequent words and the end are tokens. Every other word belongs to one of ``TAIL`` tokens
   by its last two bytes; of that token's probability a word has the share (c - D) / N_j of its training
   count, and words never seen have the rest, D V_j / N_j, with one discount D from the words that occur
   once and twice. The recurrent model's softmax is factored into classes of tokens of similar mass.
3. The recurrent model (``gru``) learns from all tokens of every training document, with its state carried
   over the document's windows. In each of ``ROUNDS`` rounds tasks train copies on their part, and the copies
   are averaged by tokens seen. A round has its share of the documents, or, where all of them have few
   tokens, all documents as often as ``LEARN`` and ``PASSES`` ask for.
4. Each whole text is scored with its state carried over all windows. Texts are cut into tokens once, for
   learning and for scoring. Counts of the most frequent words (``TABLE`` at most) lie in the workers; a
   document's other words are summed by word and joined to the counts, so the table of all words is never
   broadcast.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import gru, units
from tessera.llm.common import checkpointed, fold

HEAD, TAIL = 3072, 512
#: Rounds of averaging with their learning rates; smaller corpora are passed over again up to so many tokens, or so often.
ROUNDS, RATES, LEARN, PASSES = 3, (0.006, 0.003, 0.0015), 9_000_000, 6
#: Tokens of a task in large and in small corpora: many times the longest documents, so that few lanes wait for one.
TASK_TOKENS, SMALL_TASK, SMALL_TASKS = 2_000_000, 1_000_000, 8
#: Words whose counts are broadcast at most.
TABLE = 300_000
#: Words a worker counts before it hands them on, and tokens that it learns from or scores together.
COUNTED, POOL = 400_000, 2_000_000
#: Bytes of texts that are read together, one text at least.
TOGETHER = 1 << 19
#: Parts of the parameters that are averaged apart.
BLOCKS = 12
#: Steps of the histogram of counts in each doubling.
STEPS = 8


def words_of(text: bytes | None) -> list[bytes]:
    """Words, A-Z in lower case: of bytes, so both mean ASCII alone."""
    return (text or b"").lower().split()


def count_words(texts: DataFrame) -> DataFrame:
    """word and c over all texts (one column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                counts.update(words_of(t.as_py()))
                if len(counts) > COUNTED:
                    yield batch()
                    counts.clear()
        if counts:
            yield batch()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What a worker needs to turn words into tokens and known counts."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n_end: int, tail_n: np.ndarray, tail_v: np.ndarray, discount: float, head: int = HEAD):
        counts = np.asarray(counts, np.int64)
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))[:head]
        tail_n, tail_v = tail_n.copy(), tail_v.copy()
        for i in order:
            tail_n[tail_of(words[i])] -= counts[i]
            tail_v[tail_of(words[i])] -= 1
        mass = np.r_[counts[order], n_end, tail_n].astype(np.float64)
        by_mass = np.argsort(-mass, kind="stable")
        place = np.empty(len(mass), np.int32)
        place[by_mass] = np.arange(len(mass))
        self.counts, self.end, self.tails = mass[by_mass], int(place[len(order)]), place[len(order) + 1 :]
        s, groups = np.cumsum(np.sqrt(self.counts + 1)), round(len(mass) ** 0.5)
        self.shape = gru.Shape(tuple(sorted({0, len(mass), *(int(np.searchsorted(s, s[-1] * k / groups)) + 1 for k in range(1, groups))})))
        self.table = units.Table(len(words))
        if words:
            self.table.add(*units.words(words)[4:], np.arange(len(words), dtype=np.int32))
        self.token = np.array([self.tails[tail_of(w)] for w in words], np.int32)
        self.token[order] = place[: len(order)]
        self.share_log = np.log10(counts - discount)  # of a word in its tail token
        self.share_log[order] = 0
        self.unseen_log = np.log10(np.where(tail_v > 0, discount * tail_v, 1.0))
        self.tail_log = np.zeros(len(mass))
        self.tail_log[self.tails] = np.log10(np.where(tail_n > 0, tail_n, 1))
        self.log_c = np.log10(counts + 1.0)
        self.log_end = float(np.log10(n_end + 1))
        self.end_known = n_end > 0

    def read(self, texts: list[bytes]) -> Read:
        """The tokens of whole texts, each with the end, and what their words count, all words at once."""
        n = len(texts)
        data, start, stop, of, *hashes = units.words(texts)
        at = self.table.find(*hashes)
        seen = np.flatnonzero(at >= 0)
        ends = np.cumsum(np.bincount(of, minlength=n) + 1) - 1
        c, tokens = np.frombuffer(data, np.uint8).astype(np.int64), np.empty(len(of) + n, np.int32)
        last = c[stop - 1] + np.where(stop - start > 1, c[stop - 2] + 1, 0) * 256 if len(of) else at
        tail = _TAILS[last]
        token = np.where(at >= 0, self.token[at] if len(self.token) else 0, self.tails[tail])
        tokens[np.arange(len(of)) + of], tokens[ends] = token, self.end
        per = lambda w, x: np.bincount(of[w], x, n) if len(w) else np.zeros(n)
        every = np.arange(len(of))
        log_c = per(seen, self.log_c[at[seen]]) + self.log_end
        within = per(seen, self.share_log[at[seen]]) - per(every, self.tail_log[token]) - self.tail_log[self.end]
        known = np.bincount(of[seen], minlength=n) + int(self.end_known)
        # words outside the table, each once a text
        miss = np.flatnonzero(at < 0)
        order = miss[np.lexsort((hashes[0][miss], of[miss]))]
        new = np.flatnonzero(np.r_[True, (of[order][1:] != of[order][:-1]) | (hashes[0][order][1:] != hashes[0][order][:-1])]) if len(order) else order
        one = order[new]
        times = np.diff(np.r_[new, len(order)])
        rare = [data[u:v] for u, v in zip(start[one].tolist(), stop[one].tolist(), strict=True)]
        return Read(tokens, ends, known, log_c, within, rare, times, self.unseen_log[tail[one]] if len(one) else np.zeros(0), np.r_[0, np.cumsum(np.bincount(of[one], minlength=n))])


@dataclass
class Read:
    """Tokens of several texts with each one's end, sums by text, and rare words from one offset of a text to the next."""

    tokens: np.ndarray
    ends: np.ndarray
    known: np.ndarray
    log_c: np.ndarray
    within: np.ndarray
    rare: list[bytes]
    times: np.ndarray
    unseen: np.ndarray
    offsets: np.ndarray


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


#: The group of each pair of last bytes, a byte more than the first being its place; the first 256 are words of one byte.
_TAILS = np.array([tail_of(bytes([k])) for k in range(256)] + [tail_of(bytes([a, b])) for a in range(256) for b in range(256)], np.int64)


_vocabularies: dict = {}


def _vocabulary(shared) -> Vocabulary:
    """This worker's vocabulary of a broadcast; only the latest is kept."""
    name, words, *rest = shared.value
    if name not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[name] = Vocabulary(words.split(), *rest)
    return _vocabularies[name]


ROW = "uid long, doc_id long, key long, train boolean, n_tokens long, n_known long, log_c double, log_model double, tokens binary, rare array<binary>, times array<int>, unseen array<double>"


def _read(shared):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.float64())]
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, uid = _vocabulary(shared), TaskContext.get().partitionId() << 40
        def done(keys: list, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal uid
            r, n = v.read(texts), len(texts)
            offsets, size = pa.array(r.offsets, pa.int32()), np.diff(np.r_[-1, r.ends])
            data = pa.py_buffer(r.tokens.astype("<u2").tobytes())
            places = pa.py_buffer((2 * np.r_[0, r.ends + 1]).astype("<i4").tobytes())
            cols = [pa.array(np.arange(uid, uid + n)), *(pa.array(c, t) for c, t in zip(zip(*keys, strict=True), kinds[1:4], strict=True)), pa.array(size), pa.array(r.known.astype(np.int64)), pa.array(r.log_c), pa.array(r.within)]
            cols += [pa.Array.from_buffers(pa.binary(), n, [None, places, data]), pa.ListArray.from_arrays(offsets, pa.array(r.rare, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(r.times, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(r.unseen, pa.float64()))]
            uid += n
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in batches:
            keys, texts, size = [], [], 0
            for *key, t in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3).cast(pa.binary()), strict=True):
                keys.append(key)
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size > TOGETHER:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
            if texts:
                yield done(keys, texts)

    return run


def read(d: DataFrame, vocabulary) -> DataFrame:
    """Every row (doc_id, text, train) with the tokens of its whole text, its end included, and its words' counts."""
    keyed = d.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "train", "text")  # copies differ in their keys
    return checkpointed(keyed.mapInArrow(_read(vocabulary), ROW))


def _train(shared, shape, rate: float, passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, seen, held, size = shared.value, 0, [], 0

        def learn():
            nonlocal p, seen, held, size
            p, n, _ = gru.train(p, shape, held, rate, passes=passes)
            seen, held, size = seen + n, [], 0

        for b in batches:
            for x in b.column(0):
                held.append(np.frombuffer(x.as_py(), "<u2").astype(np.int32))
                size += len(held[-1])
            if size > POOL:
                learn()
        if held:
            learn()
        if seen:
            parts, task = np.array_split(gru.flat(p).astype("<f8") * seen, BLOCKS), TaskContext.get().partitionId()
            cols = [pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "task", "n", "v"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by block; the input is sorted by task, so reruns add up alike."""
    total: dict[int, list] = {}
    for b in batches:
        for k, _, n, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = np.frombuffer(v, "<f8")
            if k in total:
                total[k][0] += n
                total[k][1] += x
            else:
                total[k] = [n, x.copy()]
    cols = [pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([x.tobytes() for _, x in total.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, names=["block", "n", "v"])


def fit(s: DataFrame, v: Vocabulary) -> dict[str, np.ndarray]:
    """The model's parameters from all training rows (key, tokens)."""
    sc = s.sparkSession.sparkContext
    p = gru.fresh(v.shape, v.counts)
    tokens = (s.agg(F.sum(F.length("tokens"))).first()[0] or 0) // 2
    passes = min(PASSES, max(1, round(LEARN / max(tokens, 1))))
    share = tokens if passes > 1 else tokens / ROUNDS
    n = max(1, round(share / TASK_TOKENS), min(SMALL_TASKS, round(share / SMALL_TASK)))
    for r in range(ROUNDS if tokens else 0):
        shared = sc.broadcast(p)
        mine = s if passes > 1 else s.filter(F.pmod("key", F.lit(ROUNDS)) == r)
        mine = mine.repartition(n, "key").sortWithinPartitions("key", "tokens").select("tokens")
        summed = mine.mapInArrow(_train(shared, v.shape, RATES[r], -(-passes // ROUNDS)), "block int, task int, n long, v binary")
        summed = summed.repartition(BLOCKS, "block").sortWithinPartitions("block", "task").mapInArrow(_sums, "block int, n long, v binary")
        blocks = sorted(summed.collect())  # BLOCKS rows, the size of the model
        if blocks:
            p = gru.unflat(np.concatenate([np.frombuffer(x["v"], "<f8") / x["n"] for x in blocks]), p)
        shared.unpersist()
    return p


def _log_likelihoods(shape, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, tokens, size = [], [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(gru.score(model.value, shape, tokens) / np.log(10))], names=["uid", "log_p"])

        for b in batches:
            for uid, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                uids.append(uid)
                tokens.append(np.frombuffer(x.as_py(), "<u2").astype(np.int32))
                size += len(tokens[-1])
                if size > POOL:
                    yield done()
                    uids, tokens, size = [], [], 0
        if uids:
            yield done()

    return run


@dataclass
class Counts:
    """Counts of all training words, which of them are in the workers' table, totals, and that table."""

    counts: DataFrame
    frequent: Column
    total: int
    types: int
    discount: float
    vocabulary: object
    words: Vocabulary


def count(texts: DataFrame) -> Counts:
    """What the training ``texts`` (one column) hold."""
    sc = texts.sparkSession.sparkContext
    counts = checkpointed(count_words(texts))
    n_end = texts.count()
    tail = F.crc32(F.substring("word", -2, 2)) % TAIL
    step = F.floor(F.log2("c") * STEPS)
    by_tail, once, twice = np.zeros((2, TAIL)), 0, 0
    for r in counts.groupBy(tail.alias("j")).agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).collect():  # TAIL rows
        by_tail[:, r[0]] = r[1], r[2]
        once, twice = once + r[3], twice + r[4]
    discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    by_step = sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True)  # some 8 rows a doubling
    least, kept = None, 0
    for s, n in by_step:
        if kept + n > TABLE:
            break
        least, kept = s, kept + n
    frequent = (step >= least) if least is not None else F.lit(False)
    table = counts.filter(frequent).select("word", "c").toArrow()  # at most TABLE rows
    words, c = table["word"].to_pylist(), np.array(table["c"].to_pylist(), np.int64)
    total = int(by_tail[0].sum()) + n_end
    types = int(by_tail[1].sum()) + (n_end > 0)
    packed = (uuid.uuid4().hex, b" ".join(words), c, n_end, *by_tail, discount, HEAD)
    return Counts(counts, frequent, total, types, discount, sc.broadcast(packed), Vocabulary(words, *packed[2:]))


def score(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows outside ``held_out`` (a condition on the key, named ``doc_id`` in it). The scores
    are log10 probabilities of the words and the end; all words never seen count as one word, as in the
    base. Null text counts as empty, repeated rows count and are scored each, without training rows every
    token is unseen; an empty table gives no rows; further columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("train", ~F.coalesce(held_out, F.lit(False)))
    known = count(d.filter("train").select("text"))
    rows = read(d, known.vocabulary)
    return scores(rows, known, fit(rows.filter("train").select("key", "tokens"), known.words))


def scores(rows: DataFrame, known: Counts, model: dict[str, np.ndarray]) -> DataFrame:
    """``score`` of the rows that ``read`` gives, under what was learned."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rare = rows.select("uid", F.explode(F.arrays_zip("rare", "times", "unseen")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"), F.col("x.unseen").alias("unseen"))
    rare = rare.join(known.counts.filter(~known.frequent), "word", "left").select("uid", "times", "unseen", F.coalesce("c", F.lit(0)).alias("c"))
    log_c = F.col("times") * F.log10(F.col("c") + 1.0)
    log_model = F.col("times") * F.when(F.col("c") > 0, F.log10(F.col("c") - F.lit(known.discount))).otherwise(F.col("unseen"))
    no, zero, nothing = F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long"), F.lit(0.0)
    rest = rare.select("uid", no, zero.alias("n_tokens"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("long").alias("n_known"), log_c.alias("log_c"), log_model.alias("log_model"))
    net = rows.select("uid", "tokens").mapInArrow(_log_likelihoods(known.words.shape, shared), "uid long, log_p double")
    net = net.select("uid", no, zero.alias("n_tokens"), zero.alias("n_known"), nothing.alias("log_c"), F.col("log_p").alias("log_model"))
    own = rows.select("uid", "doc_id", "n_tokens", "n_known", "log_c", "log_model")
    whole = own.unionByName(rest).unionByName(net).groupBy("uid").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "log_c", "log_model")])
    base = F.col("log_c") - F.col("n_tokens") * float(np.log10(known.total + known.types + 1))
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("log_model").alias("score"))


def held_out(key: Column) -> Column:
    """Whether a key is kept from learning: crc32 of it as text, modulo 7, is 2."""
    return fold(key, 7) == 2
