import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.operators import metrics as M
from tessera.operators import models, profile
from tessera.operators.ordered import running_sums
from tessera.sources import images
from tessera.streaming.scoring import routed_stream


def test_nan_and_null_rules(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(X.at_least(F.col("x"), F.lit(1.0))).collect()] == [False, False, True, False]
    w = [r[0] for r in df.select(X.winsorised(F.col("x"), F.lit(0.6), F.lit(1.0))).collect()]
    assert np.isnan(w[0]) and w[1:] == [None, 1.0, 0.6]
    assert profile.numeric_summary(df, ["x"]).first()["n"] == 2


def test_alpha_composite(spark):
    px = [(255, 0, 0, 255), (255, 0, 0, 0), (0, 255, 0, 128), (0, 0, 255, 64)]
    df = spark.createDataFrame(px, "r int, g int, b int, a int")
    got = [tuple(x) for x in df.select(*[X.composite(F.col(c), F.col("a")) for c in "rgb"]).collect()]
    assert got == [(255, 0, 0), (128, 128, 128), (64, 192, 64), (96, 96, 160)]


def test_residue_start_against_search(spark):
    df = spark.range(200, 420).select(F.col("id").alias("n"))
    for residue in (0, 4, 7):
        for r in df.select("n", X.residue_start(F.col("n"), 248, residue).alias("s")).collect():
            starts = [s for s in range(residue, r["n"] - 248 + 1, 8)]
            want = min(starts, key=lambda s: (abs(s - (r["n"] - 248) / 2), s)) if starts else None
            assert r["s"] == want


def test_running_sums_with_a_hot_key(spark):
    rows = [("a", float(i), i % 7) for i in range(500)] + [("b", float(i), 1) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, x double, v long").repartition(5)
    for down in (False, True):
        for most in (0, 10**6):
            for r in running_sums(df, ["k"], "x", ["v"], descending=down, one_window=most).collect():
                assert r["cum_v"] == sum(v for k, x, v in rows if k == r["k"] and (x >= r["x"] if down else x <= r["x"]))
    assert running_sums(df.limit(0), ["k"], "x", ["v"]).count() == 0


def test_auc_rules(spark):
    df = spark.createDataFrame([("one", 1, 0.5)] * 5 + [("const", i % 2, 1.0) for i in range(6)] + [("few", i % 2, float(i)) for i in range(3)] + [("nan", i % 2, float("nan") if i > 3 else float(i)) for i in range(6)], "g string, y int, x double")
    got = {r["g"]: r["auc"] for r in M.safe_auc(df, "y", "x", ["g"]).collect()}
    assert got == {"one": None, "const": 0.5, "few": None, "nan": 0.75}


def test_threshold_without_negatives(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    assert M.threshold_at_fpr(df, "y", "p").first()[0] == 1.0
    df = spark.createDataFrame([(0, 0.9), (1, 0.4)], "y int, p double")
    assert M.threshold_at_fpr(df, "y", "p").first()[0] == pytest.approx(0.9) and M.threshold_at_fpr(df, "y", "p").first()[0] > 0.9


def test_one_to_one_is_checked(spark):
    with pytest.raises(ValueError):
        profile.unique_on(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "t")


def png(w, h, color, rows, extra=b""):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def test_manifest(spark, tmp_path):
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (260, 300, 3), dtype=np.uint8)
    rgba = rng.integers(0, 256, (252, 256, 4), dtype=np.uint8)
    top = tmp_path / "gen" / "ai"
    top.mkdir(parents=True)
    (top / "a.png").write_bytes(png(300, 260, 2, [r.tobytes() for r in rgb]))
    (top / "b.PNG").write_bytes(png(256, 252, 6, [r.tobytes() for r in rgba]))
    (top / "small.png").write_bytes(png(100, 100, 2, [r.tobytes() for r in rgb[:100, :100]]))
    (top / "grey.png").write_bytes(png(300, 260, 0, [r.tobytes() for r in rgb[..., 0]]))
    (top / "junk.jpg").write_bytes(b"\xff\xd8\xffjunk")
    (top / "note.txt").write_bytes(b"no image")
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.manifest(spark, str(tmp_path)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a.png": "ACCEPTED", "b.PNG": "ACCEPTED", "small.png": "LOW_SUPPORT", "grey.png": "UNSUPPORTED_INPUT", "junk.jpg": "DECODE_ERROR"}
    x, y = got["a.png"]["crop_origin_x"], got["a.png"]["crop_origin_y"]
    assert x % 8 == 4 and y % 8 == 4
    assert got["a.png"]["patch"] == rgb[y : y + 248, x : x + 248].tobytes()
    assert len(got["b.PNG"]["patch"]) == 248 * 248 * 3 and got["junk.jpg"]["patch"] is None
    assert images.label_counts(images.discover(spark, str(tmp_path))).first()[:2] == ("gen", "ai")
    assert images.tree_counts(images.discover(spark, str(tmp_path))).first()["n"] == 5


def test_jpeg_header():
    tiff = b"MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    app = b"Exif\0\0" + tiff
    sof = struct.pack(">BHHB", 8, 20, 30, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    seg = lambda k, b: bytes([0xFF, k]) + struct.pack(">H", len(b) + 2) + b
    from tessera.operators.kernels import LUMA

    data = b"\xff\xd8" + seg(0xE1, app) + seg(0xDB, b"\0" + bytes(LUMA[k] for k in images.zigzag())) + seg(0xC2, sof) + seg(0xDA, b"")
    h = images.header(data)
    assert (h["orientation"], h["width"], h["height"], h["subsampling"], h["progressive"], h["quality"], h["mode"]) == (6, 30, 20, "4:2:0", True, 50, "RGB")
    assert images.header(b"")["format"] is None


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(y), float(y + e), float(z), "g%d" % (i % 3)) for i, (y, e, z) in enumerate(zip(rng.integers(0, 2, 300), rng.standard_normal(300), rng.standard_normal(300), strict=True))]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double, g string")
    m = models.fit(df, ["a", "b"])
    s = models.raw_scores(m, df, ["id", "y"])
    a, b = models.platt(s)
    assert M.auc(s, "y", "raw_score").first()["auc"] > 0.7 and a > 0
    tau = models.lock_threshold(s, a, b)
    out = models.scored(m, df, ["id"], a, b, tau)
    assert out.count() == 300 and set(r[0] for r in out.select("route.level").distinct().collect()) <= {"LOW", "MEDIUM", "HIGH"}
    assert models.importance(m, ["a", "b"])[0][0] == "a"
    assert models.leave_one_group_out(df, ["a", "b"], "g", ["id"]).count() == 300
    d = {r["branch"]: r["delta"] for r in models.ablation(df, df, ["a", "b"], {"no_a": ["a"]}).collect()}
    assert d["full"] == 0 and d["no_a"] < 0
    top = models.contributions(df, ["id"], ["a", "b"], [1.0, -2.0], 1).first()["top"][0]
    assert 0.5 <= top["share"] <= 1


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿k,v\na,\"1,5\"\nb,x\n".encode())
    assert [tuple(r) for r in images.read_csv(spark, str(tmp_path / "t.csv"), "k string, v double", ["v"]).collect()] == [("a", 1.5), ("b", None)]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.1), (2, 0.9)], "id int, p double").write.parquet(src)
    q = routed_stream(spark, src, "id int, p double", "p", 0.5).writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["id"], r["route"]["level"]) for r in spark.table("routed").collect()} == {(1, "LOW"), (2, "HIGH")}


def test_d_prime(spark):
    from tessera.plans.extras import d_prime, tpr_at_fpr5

    df = spark.createDataFrame([(0.5,), (0.921350396474857,)], "a double")
    got = df.select(d_prime(F.col("a")), tpr_at_fpr5(F.col("a"))).collect()
    assert got[0][0] == pytest.approx(0) and got[0][1] == pytest.approx(0.05) and got[1][0] == pytest.approx(2, abs=1e-6)


def test_fisher_distance(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.standard_normal((400, 3)), rng.standard_normal((400, 3)) + [1, 0, 0]]
    df = spark.createDataFrame([(int(i >= 400), *map(float, r)) for i, r in enumerate(x)], "y int, a double, b double, c double")
    assert M.fisher_distance(df, "y", ["a", "b", "c"]) == pytest.approx(1.0, abs=0.25)


def test_markdown(spark, tmp_path):
    from tessera.operators.report import markdown, write_tables

    df = spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "k string, v double")
    assert markdown(df, 10).splitlines() == ["| k | v |", "|-|-|", "| a\\|b | 0.5 |", "|  | 1.0 |"]
    write_tables({"t": df}, str(tmp_path), "both")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/t.csv").count() == 2


def test_rank_alignment_has_no_limit(spark):
    from tessera.operators.ordered import ranked

    rows = [(i, float(i * 7 % 90)) for i in range(200)]
    got = {r["k"]: r["rank"] for r in ranked(spark.createDataFrame([*rows, (999, None)], "k long, v double"), "v", "k").collect()}
    assert got == {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_rank_alignment_covers_the_shorter_table(spark):
    from tessera.plans import registry

    d = "/root/testdata/sf0.01"
    n = min(spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("customer", "supplier"))
    assert n > 50 and registry.queries()["rank_alignment"](spark, d).count() == n


def auc_of(y, x):
    a, b = x[y == 1][:, None], x[y == 0][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


def test_bootstrap_has_300_replicates(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, int(i % 2), float(rng.normal() + i % 2)) for i in range(80)], "id long, y int, x double")
    assert M.bootstrap_auc(df, "y", "x", "id").first()["replicates"] == 300


def test_paired_bootstrap(spark):
    rng = np.random.default_rng(6)
    y = np.arange(300) % 2
    a, b = rng.normal(size=300) + 1.5 * y, rng.normal(size=300) + 0.2 * y
    rows = [(i, int(k), float(u), float(v)) for i, (k, u, v) in enumerate(zip(y, a, b))]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    got = M.bootstrap_delta(df, "y", "a", "b", "id", replicates=200).first()
    draws = [(lambda i: auc_of(y[i], a[i]) - auc_of(y[i], b[i]))(rng.integers(0, 300, 300)) for _ in range(1000)]
    assert got["replicates"] == 200 and got["delta"] == pytest.approx(auc_of(y, a) - auc_of(y, b))
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=0.03) and got["p"] == 0
    same = M.bootstrap_delta(df.withColumn("b", F.col("a")), "y", "a", "b", "id", replicates=20).first()
    assert same["low"] == same["high"] == 0 and same["p"] == 2


def test_logo_bootstrap(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, int(i % 2), "gh"[i // 2 % 2], float(rng.normal() + 2 * (i % 2)), float(rng.normal())) for i in range(160)], "id long, y int, g string, u double, v double")
    got = models.logo_bootstrap(df, {"good": ["u"], "noise": ["v"]}, [("good", "noise")], "g", "id", replicates=50).collect()
    assert [(r["set_a"], r["set_b"], r["replicates"]) for r in got] == [("good", "noise", 50)] and got[0]["low"] > 0


def test_shortcut_alerts_of_every_kind(spark):
    from tessera.operators import shortcuts as S

    rows = []
    for i in range(100):
        y = i % 2
        rows.append((y, y == 1 and i < 40, "p" if y else None, 10.0 + 10 * y, "cam" if y and i < 60 else None, "both", 64 if y else i, 64, None if i % 4 == 0 else 1.0 * (i % 7)))
    df = spark.createDataFrame([*rows, (None, True, "q", 1.0, "z", "z", 1, 1, 1.0)], "y int, b boolean, c string, n double, t string, u string, w int, h int, f double")
    got = S.alerts(df, "y", binary=["b"], categories=["c"], numbers=["n"], texts=["t", "u"], size=("w", "h")).collect()
    assert {(r["kind"], r["feature"]): (round(r["delta"], 6), r["severity"]) for r in got} == {
        ("binary_rate", "b"): (0.4, "HIGH"), ("category_share", "c"): (1.0, "HIGH"), ("relative_median", "n"): (round(10 / 15, 6), "HIGH"), ("presence", "t"): (0.6, "HIGH"),
        ("exclusive_value", "t"): (1.0, "HIGH"), ("resolution_pattern", "wxh"): (0.98, "HIGH"),
    }
    assert [r["detail"] for r in got if r["kind"] == "exclusive_value"] == ["cam only in 1 30"]


def test_label_ranking_counts_missing_values(spark):
    from tessera.operators import shortcuts as S

    rng = np.random.default_rng(8)
    rows = [(i % 2, None if i % 2 and i < 80 else 1.0, float(i % 2 + rng.normal()), *rng.normal(size=24).tolist()) for i in range(100)]
    names = [f"r{k}" for k in range(24)]
    df = spark.createDataFrame(rows, "y int, gone double, told double, " + ", ".join(f"{n} double" for n in names)).withColumn("twin", -2 * F.col("told"))
    got = S.label_ranking(df, "y", ["gone", "told", "twin", *names]).collect()
    assert len(got) == 20 and got[0]["feature"] == "gone" and got[0]["corr"] is None and got[0]["score"] == pytest.approx(0.8)
    assert {got[1]["feature"], got[2]["feature"]} == {"told", "twin"}
    pairs = S.correlated_pairs(df, ["gone", "told", "twin", "r0"]).collect()
    assert [(r["feature_a"], r["feature_b"], round(r["corr"], 9), r["n"]) for r in pairs] == [("told", "twin", -1.0, 100)]


def test_facts_are_found_anywhere_in_a_file():
    tiff = b"II*\0" + struct.pack("<IHHHIHHHHIHHHHIHHHHIII", 8, 5, 256, 3, 1, 7, 0, 257, 3, 1, 5, 0, 274, 3, 1, 6, 0, 700, 1, 9, 0, 0)[:-4] + struct.pack("<HHII", 34675, 7, 9, 0)
    assert {k: v for k, v in images.header(tiff).items() if v is not None} == {"format": "TIFF", "width": 7, "height": 5, "orientation": 6, "has_exif": False, "has_icc": True, "has_xmp": True, "has_iptc": False}
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0))
    late = png + chunk(b"tEXt", b"k\0" + b"eXIf iCCP" * 900) + chunk(b"IDAT", b"x" * 9000)
    assert [images.header(late + chunk(b"IEND", b""))[k] for k in ("has_exif", "has_icc", "has_xmp", "orientation")] == [False, False, False, None]
    late += chunk(b"iCCP", b"p\0\0") + chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0<x/>") + chunk(b"eXIf", tiff) + chunk(b"IEND", b"")
    assert [images.header(late)[k] for k in ("has_exif", "has_icc", "has_xmp", "orientation")] == [True, True, True, 6]
    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    resource = lambda name, body: b"8BIM" + struct.pack(">H", name) + b"\0\0" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    jpeg = b"\xff\xd8" + part(0xE1, b"http://ns.adobe.com/xap/1.0/\0<x/>") + part(0xED, b"Photoshop 3.0\0" + resource(0x03ED, b"abc") + resource(0x0404, b"\x1c\x02\x05\0\1a"))
    assert [images.header(jpeg)[k] for k in ("has_xmp", "has_iptc")] == [True, True]
    assert images.header(b"\xff\xd8" + part(0xED, b"Photoshop 3.0\0" + resource(0x03ED, b"abc")))["has_iptc"] is False


def test_model_grid_folds_and_solo(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 2), "gh"[i // 2 % 2], float(rng.normal() + 2 * (i % 2)), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int, g string, u double, v double")
    assert models.build("gbt", ["u"], 1.0).getStages()[-1].getMaxIter() == 400
    assert models.cross_validated_auc(df, ["u"], "id") > 0.8 > 0.65 > models.cross_validated_auc(df, ["v"], "id")
    worse = df.withColumn("u", F.col("v"))
    got = models.cross_degradation(df, worse, ["u"], "g", ["id"])
    assert got.count() == 200 and M.auc(got, "y", "raw_score").first()["auc"] < 0.65
    grid = models.candidates(df, df, df, {"good": ["u", "v"], "noise": ["v"]}, kinds=("logreg",)).collect()
    assert [r["candidate"] for r in grid] == ["good__logreg", "noise__logreg"] and all(r["fpr"] <= 0.05 for r in grid)
    parts = {(r["family"], r["mode"]): r for r in models.ablation_intervals(df, df, ["u", "v"], {"u": ["u"], "v": ["v"]}, "id", replicates=40).collect()}
    assert len(parts) == 4 and parts["u", "drop"]["low"] > 0 and parts["v", "solo"]["low"] > 0 and abs(parts["v", "drop"]["delta"]) < 0.05


@pytest.mark.parametrize("one_window", [None, 0])
def test_quantiles_are_exact(spark, one_window):
    from tessera.operators.ordered import quantiles

    rng = np.random.default_rng(8)
    rows = [("a" if i % 3 else None, float(x)) for i, x in enumerate(np.round(rng.normal(size=500), 2))] + [("b", 1.5), ("c", None), ("a", float("nan")), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in quantiles(df, "v", [0, 0.1, 0.5, 0.99, 1], ["k"], one_window=one_window).collect()}
    assert set(got) == {"a", "b", None}
    for k, r in got.items():
        own = [v for g, v in rows if g == k and v is not None and np.isfinite(v)]
        assert r["n"] == len(own) and np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(own, [0, 0.1, 0.5, 0.99, 1]))
    one = quantiles(df, "v", [0.5], one_window=one_window).first()
    assert one["q0"] == pytest.approx(np.median([v for _, v in rows if v is not None and np.isfinite(v)]))
    assert quantiles(df.limit(0), "v", [0.5]).collect() in ([], [(None, None)])


def test_numbers_within_groups(spark):
    from tessera.operators.ordered import numbered_within

    rows = [("a" if i % 4 else "b", i * 37 % 101, i) for i in range(300)] + [(None, 5, 1000), (None, 4, 1001)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    got = {r["id"]: (r["rank"], r["size"]) for r in numbered_within(df, ["g"], [F.col("v"), F.col("id")], size="size").collect()}
    for g in ("a", "b", None):
        own = sorted((v, i) for k, v, i in rows if k == g)
        assert [got[i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]


def test_bootstrap_against_loops(spark):
    import hashlib

    rng = np.random.default_rng(2)
    rows = [(i, int(rng.random() < 0.4), float(np.round(rng.normal(), 1))) for i in range(150)]
    got = {r["replicate"]: r["auc"] for r in M._replicate_aucs(spark.createDataFrame(rows, "id int, y int, x double").repartition(3), "y", "x", "id", 7, "s").collect()}
    for rep in range(7):
        m = {i: sum(int(hashlib.md5(f"s|{rep}|{i}".encode()).hexdigest()[:12], 16) / 2**48 >= q for q in M._POISSON) for i, _, _ in rows}
        pairs = [(m[a] * m[b], 1.0 if u > v else 0.5 if u == v else 0.0) for a, y, u in rows if y for b, z, v in rows if not z]
        assert got[rep] == pytest.approx(sum(w * s for w, s in pairs) / sum(w for w, _ in pairs))


def test_array_moments_are_linear(spark):
    import time

    from tessera.operators import patches as P

    df = spark.createDataFrame([(i, [float((i * k) % 17) for k in range(4096)]) for i in range(40)], "i int, a array<double>").cache()
    df.count()
    t = time.perf_counter()
    got = df.select("i", *P.skew_kurtosis(F.col("a")), P.correlation(F.col("a"), F.reverse("a"))).collect()
    assert len(got) == 40 and time.perf_counter() - t < 6  # the quadratic form took 42 s


def test_clean_text(spark):
    from tessera.functions import scalars as X

    rows = [(b"\x00 a b\x00 ",), (b"  \x00",), (None,), (b"caf\xe9",), (b"",)]
    assert [r[0] for r in spark.createDataFrame(rows, "c binary").select(X.clean_text(F.col("c"))).collect()] == ["a b", None, None, "caf\ufffd", None]


def test_array_files(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.asfortranarray(np.ones((3, 2))))
    (tmp_path / "c.npy").write_bytes(b"nothing")
    np.save(tmp_path / "d.npy", a[0])
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.arrays(spark, str(tmp_path), (2, 4, 3)).collect()}
    assert np.frombuffer(got["a.npy"]["values"], got["a.npy"]["dtype"]).reshape(got["a.npy"]["shape"]).tolist() == a.tolist()
    assert all(got[k]["error"] and got[k]["values"] is None for k in ("b.npy", "c.npy", "d.npy")) and got["a.npy"]["error"] is None
    assert [r["path"][-5:] for r in images.discover(spark, str(tmp_path), [".npy"]).collect()] == ["a.npy", "b.npy", "c.npy", "d.npy"]


def test_quality_goes_by_place():
    from tessera.operators.kernels import LUMA

    order = images.zigzag()
    assert order[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(order) == list(range(64))
    assert images.quality_of([LUMA[k] for k in order]) == 50 and images.quality_of([max(1, LUMA[k] // 5) for k in order]) in (90, 91)


def test_serving(spark, tmp_path):
    import struct
    import zlib

    from tessera.operators import kernels, models
    from tessera.sources import artifacts
    from tessera.streaming.serving import Scorer

    def png(a):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in a))) + chunk(b"IEND", b"")

    rng = np.random.default_rng(3)
    noisy = [rng.integers(0, 256, (260, 270, 3), dtype=np.uint8) for _ in range(3)]
    smooth = [np.clip(np.add.outer(np.arange(260) / 3, np.arange(270) / 4 + k)[..., None] + rng.normal(0, 2, (260, 270, 3)), 0, 255).astype(np.uint8) for k in range(3)]
    rows = [(i, int(i < 3), *map(float, kernels.features(images.canonical(a)))) for i, a in enumerate(noisy + smooth)] * 4
    df = spark.createDataFrame(rows, "id int, y int, " + ", ".join(f"{f} double" for f in kernels.FEATURES))
    m, folder, versions = models.fit(df, kernels.FEATURES), f"file://{tmp_path}/m", {"feature_version": "2"}
    candidate = {"candidate_name": "full_v2__logreg", "feature_set": "full_v2", "model_name": "logreg", "feature_columns": kernels.FEATURES}
    artifacts.save_model(m, folder, calibrator=(1.0, 0.0), threshold=0.5, target_fpr=0.05, gate=0.0, candidate=candidate, versions=versions, saved_at="now")
    s = Scorer(spark, folder, versions)
    assert s.health()["n_features"] == 36
    got = s.predict([png(noisy[0]), png(smooth[1]), b"", b"no image", png(noisy[1][:200])])
    assert [x["status"] for x in got] == ["ok", "ok", "empty", "DECODE_ERROR", "LOW_SUPPORT"] and got[0]["pred_ai"] == 1 and got[1]["pred_ai"] == 0
    table = spark.createDataFrame([("a", images.canonical(noisy[0]).tobytes()), ("b", images.canonical(smooth[1]).tobytes())], "path string, patch binary")
    assert {r["path"]: r["prob"] for r in s.score(table).collect()} == pytest.approx({"a": got[0]["prob_ai"], "b": got[1]["prob_ai"]})


def test_diagnostics(spark):
    from tessera.operators import diagnostics as D

    assert D.d_prime(0.5) == pytest.approx(0) and D.tpr_at(0.5) == pytest.approx(0.05) and D.d_prime(0.9) == pytest.approx(1.8124, abs=1e-3)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.random() < 0.5), f"g{i % 3}", "v1" if i % 2 else "v2") for i in range(240)]
    df = spark.createDataFrame([(i, y, g, v, y + float(rng.normal()), float(rng.normal()), int(i % 4 < 2)) for i, y, g, v in rows], "id int, y int, g string, variant string, u double, w double, nuisance_is_420 int")
    got = D.variants(df, "variant", ["u", "w"], "g", "id").collect()
    assert len(got) == 4 and all(r["stratified_auc"] > 0.6 and r["logo_auc"] > 0.6 for r in got) and all(r["cohen_d"] > 0.5 for r in got if r["feature"] == "u")
    by = {(r["variant"], r["feature"]): r for r in D.subsampling(df, "variant", ["u", "w"]).collect()}
    assert len(by) == 4 and by["v1", "u"]["label_auc"] > by["v1", "w"]["label_auc"]
    sets = D.compared_sets(df, {"both": ["u", "w"], "noise": ["w"]}, "noise", "g", "id")
    assert sets[0]["name"] == "both" and sets[0]["delta"] > 0.1 and sets[1]["delta"] == 0
    one = D.generalisation(df, {"u": ["u"]}, "g", "id")[0]
    assert min(one["pooled_auc"], one["within_auc"], one["logo_auc"]) > 0.6
    assert D.redundancy(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double"), "a", "b") == pytest.approx(1)
    assert D.latency_ms(lambda x: sum(range(x)), [100, 200]) > 0
    assert models.raw_scores(models.fit(df, ["u"], "plain"), df, ["id"]).count() == 240


def test_metadata_is_stripped(spark):
    seg = lambda k, b: bytes([0xFF, k]) + struct.pack(">H", len(b) + 2) + b
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    jpeg = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xE1, b"Exif\0\0xx") + b"\xff" + seg(0xFE, b"note") + seg(0xDB, b"\0" + bytes(64)) + seg(0xDA, b"s") + b"data\xff\xd9"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"h" * 13) + chunk(b"tEXt", b"a") + chunk(b"eXIf", b"b") + chunk(b"IDAT", b"c") + chunk(b"IEND", b"")
    assert images.stripped(jpeg) == b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes(64)) + seg(0xDA, b"s") + b"data\xff\xd9"
    assert images.stripped(png) == b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"h" * 13) + chunk(b"IDAT", b"c") + chunk(b"IEND", b"")
    got = {r["path"]: r for r in images.strip_metadata(spark.createDataFrame([("a", jpeg), ("b", b"GIF89a"), ("c", png[:40])], "path string, content binary")).collect()}
    assert got["a"]["action"] == "processed" and got["b"]["action"] == got["c"]["action"] == "failed" and got["b"]["content"] is None


def test_reports(spark):
    from tessera.operators.report import checklist, report

    text = report("Audit", {"Rows": spark.createDataFrame([(1, "a|b")], "n int, s string"), "None": spark.createDataFrame([], "n int"), "Words": "All fine."})
    assert text.startswith("# Audit\n") and "a\\|b" in text and "No rows." in text and text.endswith("All fine.\n")
    assert checklist({"decode": ("same", "same"), "resize": ("yes", "no")}).count("NO") == 1


def test_a_marker_that_must_be_there(spark):
    df = spark.createDataFrame([("/a/Raw/b.png",), (None,)], "p string")
    assert [r[0] for r in df.select(X.after_marker(F.col("p"), "/raw/", required=True)).collect()] == ["b.png", None]
    with pytest.raises(Exception, match="no /raw/ in /a/b"):
        spark.createDataFrame([("/a/b",)], "p string").select(X.after_marker(F.col("p"), "/raw/", required=True)).collect()
