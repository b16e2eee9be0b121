import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tessera.llm import decontaminate, mixing, nbsvm, simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = nbsvm.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), held_out=nbsvm.held_out(F.col("k")))
    good = [i for i in sorted(rows) if model.score([rows[i]["text"]])[0] >= nbsvm.THRESHOLD]
    fps, first = {i: simhash.fingerprint(rows[i]["text"]) for i in good}, {}
    for i in good:  # the least key that is reached by links
        seen, front = {i}, [i]
        while front:
            front = [j for j in good if j not in seen and any(bin(fps[j] ^ fps[k]).count("1") <= 3 for k in front)]
            seen |= set(front)
        first[i] = min(seen)
    one = [i for i in good if first[i] == i]
    m = decontaminate.Matcher(items)
    clean = [i for i in one if not m.matches(rows[i]["text"])]
    copies = {r["doc_id"]: r["n_copies"] for r in mixing.copies(docs.filter(F.col("doc_id").isin(clean))).collect()}
    t, want, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for i in clean:
        ids = np.array([*t.encode(rows[i]["text"], add_special_tokens=False).ids, 0], "<u4")
        for _ in range(copies[i]):
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    got = cp.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert 0 < len(clean) < len(one) < len(good) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
        docs = stage(spark, docs, SF)
        assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    prose = lambda k, n: " ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 5000, n))
    item = prose(77, 40)
    rows = [(1, prose(1, 80)), (1, prose(2, 80)), (2, prose(1, 80)), (3, None), (4, ""), (None, prose(3, 60)), (None, prose(3, 60)), (5, prose(4, 30) + " " + item), (6, "long " + prose(5, 60_000)), (7, prose(6, 50)), (7, prose(6, 50)), (8, "one")]
    docs = [(t, i, ["x", "y", None][int(rng.integers(3))], 1, "a", 2.0) for i, t in rows]
    schema = "text string, doc_id long, source string, label int, fp string, size double"  # columns that operators use themselves
    spark.createDataFrame([(i, 1, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame(docs, schema).repartition(3)
    stages, keys = dict(cp.STAGES), lambda d: sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in d.collect()), key=str)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    assert len(keys(stages["quality"](spark, df, str(tmp_path)))) in (0, len(rows))  # one class alone: all or none
    kept = keys(stages["near_duplicates"](spark, df, str(tmp_path)))
    want = [(1, prose(1, 80)), (1, prose(2, 80)), (3, None), (None, prose(3, 60)), (5, rows[7][1]), (6, rows[8][1]), (7, prose(6, 50)), (8, "one")]
    assert kept == sorted(((i, (t or "")[:20]) for i, t in want), key=str)
    assert keys(stages["decontamination"](spark, df, str(tmp_path))) == sorted(((i, (t or "")[:20]) for i, t in rows if i != 5), key=str)
    ids = stages["token_ids"](spark, df, str(tmp_path)).collect()
    assert len(ids) == len(rows) and sorted(r["start"] for r in ids)[0] == 0 and sum(r["n_tokens"] for r in ids) == max(r["start"] + r["n_tokens"] for r in ids)
