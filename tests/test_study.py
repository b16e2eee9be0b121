"""The study features, the earlier pipelines' geometry and the table contracts against plain definitions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import closure, contracts, legacy, study
from tessera.operators import kernels as K
from tessera.sources import artifacts


@pytest.fixture(scope="module")
def rgb():
    rng = np.random.default_rng(4)
    base = np.add.outer(np.linspace(20, 200, 96), np.linspace(0, 50, 96))[..., None] + [0, 10, 25]
    return np.clip(base + rng.normal(0, 6, (96, 96, 3)), 0, 255).astype(np.uint8)


def test_byte_conversion():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [128, 128, 128], [255, 255, 255], [0, 0, 0]]], np.uint8)
    # values of the 8-bit conversion
    assert study.ycrcb(rgb)[0].tolist() == [[76, 255, 85], [150, 21, 43], [29, 107, 255], [128, 128, 128], [255, 128, 128], [0, 128, 128]]


def test_every_feature_is_there(rgb):
    f = study.features(rgb)
    assert len(f) == 79 and all(np.isfinite(v) for v in f.values())
    assert set(study.features(rgb, "old_v1")) == set(f)


def test_waves_against_sums(rgb):
    r = study.Views(rgb).noise["cr"]
    got, n = study.waves(r, "w"), r.size
    for k, parity in (("x", lambda i, j: j), ("y", lambda i, j: i), ("xy", lambda i, j: i + j)):
        s = sum(r[i, j] * (-1) ** parity(i, j) for i in range(r.shape[0]) for j in range(r.shape[1]))
        assert got[f"w_pi_{k}"] == pytest.approx(s**2 / ((r**2).sum() * n + study.EPS))


def test_masks_and_boxes(rgb):
    keep = study.keep_mask((20, 23), (0, 4))
    for i in range(20):
        for j in range(23):
            near = any(min((v - p) % 8, 8 - (v - p) % 8) <= 1 for p in (0, 4) for v in (i, j))
            assert keep[i, j] == (not near)
    a = study.Views(rgb).y[:12, :11]
    p, box = np.pad(a, 3, mode="reflect"), study.box_mean(a, 7)
    assert all(box[i, j] == pytest.approx(p[i : i + 7, j : j + 7].mean()) for i in range(12) for j in range(11))


def test_patterns_against_loops(rgb):
    a = study.Views(rgb).y[:14, :15]
    codes = []
    for i in range(1, 13):
        for j in range(1, 14):
            bits = [int(a[i + r, j + c] >= a[i, j]) for r, c in study.RING]
            turns = sum(bits[k] != bits[(k + 1) % 8] for k in range(8))
            codes.append(-1 if turns > 2 else sum(b << k for k, b in enumerate(bits)))
    n = np.unique(codes, return_counts=True)[1] / len(codes)
    got = study.lbp(a, "p")
    assert got["p_nonuniform_ratio"] == pytest.approx(codes.count(-1) / len(codes)) and got["p_entropy"] == pytest.approx(-(n * np.log2(n)).sum())


def test_wavelet_parents(rgb):
    y = study.Views(rgb).y
    quad = lambda a, s: sum(s[k] * a[k // 2 :: 2, k % 2 :: 2] for k in range(4)) * 0.5
    low = quad(y, (1, 1, 1, 1))
    got = study.wavelet(study.Views(rgb))
    for k, signs in zip("hvd", ((1, -1, 1, -1), (1, 1, -1, -1), (1, -1, -1, 1)), strict=True):
        child, parent = np.abs(quad(y, signs)), np.abs(quad(low, signs))
        mean = (child[::2, ::2] + child[1::2, ::2] + child[::2, 1::2] + child[1::2, 1::2]) / 4
        assert got[f"wav_parent_corr_{k}"] == pytest.approx(np.corrcoef(mean.ravel(), parent.ravel())[0, 1], abs=1e-9)


def test_noise_level_against_loops(rgb):
    v = study.Views(rgb)
    y, r = v.y, v.noise["y"]
    level, rough, noise = [], [], []
    for i in range(0, 96, 8):
        for j in range(0, 96, 8):
            b = y[i : i + 8, j : j + 8]
            level.append(b.mean() / 255)
            rough.append(np.abs(b[:, 1:] - b[:, :-1]).mean() + np.abs(b[1:] - b[:-1]).mean())
    for i in range(0, r.shape[0] - 5, 6):
        for j in range(0, r.shape[1] - 5, 6):
            noise.append(r[i : i + 6, j : j + 6].var() / 255**2)
    n = min(len(level), len(noise))
    keep = [k for k in range(n) if rough[k] <= np.quantile(rough[:n], 0.3)]
    m, z = np.array([level[k] for k in keep]), np.array([noise[k] for k in keep])
    got, slope = study.noise_level(v), np.polyfit(m, z, 1)
    assert got["nlf_slope"] == pytest.approx(slope[0], rel=1e-6) and got["nlf_intercept"] == pytest.approx(slope[1], rel=1e-6)
    assert got["nlf_spearman"] == pytest.approx(np.corrcoef(m.argsort().argsort(), z.argsort().argsort())[0, 1])
    assert got["nlf_r2"] == pytest.approx(np.corrcoef(m, z)[0, 1] ** 2, abs=1e-4) and 0 <= got["nlf_monotone_violation"] <= 1


def test_rings_and_peaks(rgb):
    y = study.Views(rgb).y[:32, :32]
    p = np.abs(np.fft.fftshift(np.fft.fft2(y) / y.size)) ** 2
    by: dict = {}
    for i in range(32):
        for j in range(32):
            by.setdefault(round(np.hypot(i - 16, j - 16)), []).append(p[i, j])
    assert np.allclose(study.rings(y), [np.mean(by[k]) for k in sorted(by)])
    x = np.tile([0.0, 1.0, 5.0, 1.0], 20)
    assert study.peak(x) == pytest.approx(max(((x - x.mean())[:-k] * (x - x.mean())[k:]).sum() / ((x - x.mean()) ** 2).sum() for k in range(2, 33)))


def test_flat_patches_give_no_errors():
    for value in (0, 128, 255):
        assert all(np.isfinite(v) for v in study.features(np.full((64, 64, 3), value, np.uint8)).values())


def test_rows_times_degradations(spark, rgb):
    df = spark.createDataFrame([(1, rgb.tobytes()), (2, b"short")], "k int, patch binary")
    got = {(r["k"], r["degradation"]): r for r in study.extract(df, "k", "patch", 96, ("clean", "jpeg90_420", "resize50_jpeg90_420")).collect()}
    assert len(got) == 6 and {r["status"] for (k, _), r in got.items() if k == 2} == {"error"}
    assert got[1, "clean"]["ysrm_square3_mar"] == pytest.approx(study.features(rgb)["ysrm_square3_mar"])
    assert got[1, "resize50_jpeg90_420"]["ysrm_square3_mar"] < got[1, "clean"]["ysrm_square3_mar"]
    whole, mean, std = study.quadrants(rgb, study.features)["energy_ratio_chroma"]
    assert whole > 0 and mean > 0 and std >= 0


def test_bilinear_without_smoothing():
    a = np.arange(64 * 64 * 3).reshape(64, 64, 3).astype(np.uint8)
    assert (study.resized(np.full((64, 64, 3), 77, np.uint8), 0.5) == 77).all() and study.resized(a, 0.75).shape == a.shape


def test_padding_and_crops():
    a = np.arange(300 * 258 * 3).reshape(300, 258, 3) % 251
    b, origin = legacy.padded(a)
    assert b.shape == (300, 259, 3) and origin == (0, 0) and (b[:, -1] == a[:, -2]).all()
    b, origin = legacy.padded(a[:255])
    assert b.shape[:2] == (259, 259) and origin == (0, 2) and (b[0] == np.pad(a[2], [(0, 1), (0, 0)], mode="reflect")).all()
    c, moved = legacy.shifted_crop(a[:272, :256], "conditional")
    assert moved and c.shape == (256, 256, 3) and (c == a[11:267, 0:256]).all()
    assert not legacy.shifted_crop(a, "none")[1] and legacy.shifted_crop(a, "all")[1]
    c = legacy.residue_crop(a, 216, (4, 3))
    assert (c == a[43:259, 20:236]).all()
    with pytest.raises(ValueError, match="LOW_SUPPORT"):
        legacy.residue_crop(a, 256, 5)
    assert legacy.short_side(a.astype(np.uint8), 86).shape == (100, 86, 3)


def test_hash_numbers(spark):
    keys = ["a", "b/c.png", "é", ""]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", legacy.hash_quality(F.col("k")), legacy.hash_pick(F.col("k"), [9, 7, 8])).collect()
    for k, q, pick in got:
        n = int.from_bytes(hashlib.sha256(k.encode()).digest()[:4], "little")
        assert q == 90 + n % 9 and pick == [7, 8, 9][n % 3]


def test_chroma(rgb):
    ycc = study.ycrcb(rgb).astype(np.uint8)
    half = legacy.chroma_halved(ycc)
    assert (half[..., 0] == ycc[..., 0]).all() and legacy.chroma_highband(half) < legacy.chroma_highband(ycc)
    flat = np.full((32, 32, 3), 90, np.uint8)
    assert (legacy.chroma_halved(flat) == 90).all()
    assert set(legacy.proxies(study.ycrcb(rgb))) == {"ps_alpha", "cross_noise_ratio", "srm_square3_energy_cr", "lbp_nonuniform_ratio_cr", "lbp_nonuniform_ratio_cb"}
    assert legacy.bottleneck(rgb, "key").shape == rgb.shape


def test_line_follows_the_rule_for_constants():
    x = np.linspace(0, 1, 50)
    assert K.line(x, np.full(50, 3.0)) == (0.0, 0.0) and K.line(np.full(50, 3.0), x) == (0.0, 0.0)
    assert K.line(x * 1e-5, x) == pytest.approx((1e5, 1.0))


def test_contracts(spark):
    good = spark.createDataFrame([("val", "ai", "ok", "2"), ("id_test", "real", "ok", "2")], "split_role string, label string, status string, feature_version string")
    assert {r["y"] for r in contracts.training_table(good, {"feature_version": "2"}).collect()} == {0, 1}
    for df, words in ((good.drop("label"), "label"), (good.withColumn("status", F.lit("error")), "not ok"), (good.withColumn("feature_version", F.lit("1")), "feature_version"), (good.withColumn("label", F.lit("cat")), "cat"), (good.withColumn("label", F.lit(None).cast("string")), "null")):
        with pytest.raises(ValueError, match=words):
            contracts.training_table(df, {"feature_version": "2"})
    with pytest.raises(ValueError, match="train_core"):
        contracts.split_frames(good)
    assert contracts.split_frames(good, ("val", "id_test"))["val"].count() == 1
    assert contracts.union_of_keys(["a", "b"], ["b", "c"], ["a"]) == ["a", "b", "c"]
    rows = spark.createDataFrame([(0.8, 0.6, 0.5), (0.8, 0.6, float("nan")), (None, 0.1, 0.1), (0.75, 0.6, 0.5)], "a double, b double, c double")
    assert [r[0] for r in rows.select(contracts.strict_gate(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, False, False]
    sizes = spark.createDataFrame([(b"",), (None,), (b"x" * 11,), (b"x",)], "c binary").select(contracts.payload_status(F.col("c"), 10))
    assert [r[0] for r in sizes.collect()] == ["empty", "empty", "too large", "ok"]


def test_recommendation_ties(spark):
    rows = [(240, 4, 1.0, 4, 2.0, 0.9), (240, 3, 1.0, 3, 1.0, 0.9), (240, 5, 1.0, 4, 1.5, 0.9), (248, 4, 0.5, 4, 0.1, 0.9), (247, 4, 1.0, 4, 0.1, 0.9)]
    df = spark.createDataFrame(rows, "crop_size int, residue int, accepted_ai double, phase_distance int, mean_center_linf double, coverage_total double")
    assert closure.recommended(df).select("crop_size", "residue").collect() == [(240, 5)]


def test_model_artefacts(spark, tmp_path):
    from tessera.operators import models

    df = spark.createDataFrame([(k, float(k % 7), float(k % 5), k % 2) for k in range(80)], "id int, u double, v double, y int")
    m, folder = models.fit(df, ["u", "v"]), f"file://{tmp_path}/model"
    candidate, versions = {"candidate_name": "a__logreg", "feature_set": "a", "model_name": "logreg", "feature_columns": ["u", "v"]}, {"feature_version": "2", "preprocess_version": "4"}
    artifacts.save_model(m, folder, calibrator=(1.0, 0.0), threshold=0.5, target_fpr=0.05, gate=-0.1, candidate=candidate, versions=versions, saved_at="2026-01-01T00:00:00+00:00")
    again, threshold, schema = artifacts.load_model(spark, folder, versions)
    assert threshold["threshold"] == 0.5 and schema["feature_columns"] == ["u", "v"]
    assert models.raw_scores(again, df, ["id"]).collect() == models.raw_scores(m, df, ["id"]).collect()
    with pytest.raises(ValueError, match="feature_version"):
        artifacts.load_model(spark, folder, {"feature_version": "3"})
    artifacts.write_json(spark, f"{folder}/{artifacts.THRESHOLD}", {"threshold": 0.6, "target_fpr": 0.05, "cfa_threshold": -0.1})
    with pytest.raises(ValueError, match="threshold"):
        artifacts.load_model(spark, folder, versions)
    assert artifacts.plain({1: np.float32(0.5), (2, 3): {4, 1}, "x": np.arange(2)}) == {"1": 0.5, "(2, 3)": [1, 4], "x": [0, 1]}
    audit = spark.createDataFrame([(f"f{k}", k / 50) for k in range(40)], "feature string, auc_abs double")
    artifacts.save_audit(audit, f"file://{tmp_path}/audit")
    top = spark.read.option("header", "true").csv(f"file://{tmp_path}/audit/feature_audit_top.csv").collect()
    assert len(top) == 20 and top[0]["feature"] == "f39"


def test_stale_files_are_removed(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.npy").write_bytes(b"x")
    stale = spark.createDataFrame([(f"file://{tmp_path}/0.npy",), (f"file://{tmp_path}/2.npy",), (f"file://{tmp_path}/9.npy",)], "output_path string")
    assert artifacts.remove_outputs(spark, stale) == 2 and [p.name for p in tmp_path.glob("*.npy")] == ["1.npy"]
