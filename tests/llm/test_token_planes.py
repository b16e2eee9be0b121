import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_planes as tp

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a b  c", " lead", "x\n y\t z", "a  b", "tail ", "  ", "don't stop 'til 99 %% <|endoftext|> end<|endoftext|>", "é  ü \x1c q", "a \n  b   c", "word " * 3000, "it's, x.. é!? 12%, a_b_ n̈. 'll'; foo<|endoftext|>. ab<|endoftext|> ñ***"]


def brute(rows):
    t, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_encoder_matches_whole_texts():
    whole = Tokenizer.from_file(PATH)
    e = tp.Encoder(open(PATH, encoding="utf-8").read(), cache=50)
    assert e.cut
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(TEXTS)] == [whole.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_planes_round_trip():
    ids = np.random.default_rng(0).integers(0, 50_000, 1000).astype("<u4").tobytes()
    assert tp.from_planes(tp.to_planes(ids), 1000) == ids


def test_crc_join():
    a, b = b"some bytes", b"and others" * 99
    assert tp.crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_files_against_brute_force(spark, tmp_path, block):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50, None)]
    df = spark.createDataFrame([(t, k, "extra") for k, t in rows[::-1]], "text string, doc_id long, shard string").repartition(3)
    tp.write(df, str(tmp_path), tokenizer=PATH, block=block)
    got = sorted(tuple(r) for r in tp.digest(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == brute(rows)
    stream = [x for r in tp.blocks(spark, str(tmp_path)).orderBy("start").collect() for x in r["ids"]]
    assert len(stream) == got[-1][1] + got[-1][2] and stream[-1] == 0


def test_empty_and_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    tp.write(empty, f"{tmp_path}/a", tokenizer=PATH)
    assert tp.digest(spark, f"{tmp_path}/a").count() == 0
    same = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "z"), (1, "other")], "doc_id long, text string")
    tp.write(same, f"{tmp_path}/b", tokenizer=PATH)
    got = tp.digest(spark, f"{tmp_path}/b").orderBy("start").collect()
    assert len(got) == 4 and got[0]["doc_id"] is None
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))


def test_shards_joined_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tp, "BROADCAST_SHARDS", 0)
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)]
    tp.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path), tokenizer=PATH, block=11)
    assert sorted(tuple(r) for r in tp.digest(spark, str(tmp_path)).collect()) == brute(rows)


def test_the_collector_runs_again_after_an_error():
    import gc

    run = tp._writer(open(PATH, encoding="utf-8").read(), 0, 16, 1, 100, 4)
    assert gc.isenabled()
    with pytest.raises(Exception):
        list(run([object()]))
    assert gc.isenabled()
