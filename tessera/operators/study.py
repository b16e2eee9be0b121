"""The study features of whole patches in numpy, run over Arrow batches with every degradation.

They differ from ``kernels`` in their conventions: luma and chroma are rounded to bytes, moments drop values that
are not finite, quantile masks fall back to wider ones, EPS is 1e-12. A patch's views are computed once and
shared; each family is a function of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators import kernels as K
from tessera.operators import patches as P

# The definitions' constants.
EPS, FLOOR = 1e-12, 1.53e-5
SRM = {"square3": P.SQUARE3, "edge3": P.EDGE3, "square5": P.SQUARE5}
NATIVE_PHASES = {"old_v1": (0,), "v4": (4,)}
RING = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))
#: Weights of the 8-bit conversion, in units of 2**-14.
LUMA14, CR14, CB14 = (4899, 9617, 1868), 11682, 9241


def ycrcb(rgb: np.ndarray) -> np.ndarray:
    """Luma and chroma as rounded bytes (in doubles)."""
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    half = 1 << 13
    y = (LUMA14[0] * r + LUMA14[1] * g + LUMA14[2] * b + half) >> 14
    chroma = lambda c, w: np.clip(((c - y) * w + (128 << 14) + half) >> 14, 0, 255)
    return np.stack([y, chroma(r, CR14), chroma(b, CB14)], axis=-1).astype(np.float64)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Of the places where both are finite; 0 below three."""
    a, b = (np.asarray(x, float).ravel() for x in (a, b))
    ok = np.isfinite(a) & np.isfinite(b)
    if ok.sum() < 3:
        return 0.0
    u, v = (x[ok] - x[ok].mean() for x in (a, b))
    return float(u @ v / (np.sqrt((u @ u) * (v @ v)) + EPS))


def skew_kurtosis(v: np.ndarray) -> tuple[float, float]:
    """Skew and excess kurtosis of the finite values; zeros below four or where they are constant."""
    d = np.asarray(v, float).ravel()
    d = d[np.isfinite(d)]
    if d.size < 4:
        return 0.0, 0.0
    d = d - d.mean()
    var = float(np.mean(d * d))
    if var <= EPS:
        return 0.0, 0.0
    return float(np.mean(d**3) / (var**1.5 + EPS)), float(np.mean(d**4) / var**2 - 3)


def line(x: np.ndarray, y: np.ndarray, least: int = 8) -> tuple[float, float, float]:
    """Slope, intercept and R squared of the finite pairs; zeros below ``least`` or where x is constant."""
    x, y = (np.asarray(v, float).ravel() for v in (x, y))
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    spread = float(((x - x.mean()) ** 2).sum()) if x.size else 0.0
    if x.size < least or spread <= EPS:
        return 0.0, 0.0, 0.0
    slope = float((x - x.mean()) @ (y - y.mean()) / spread)
    intercept = float(y.mean() - slope * x.mean())
    off = y - slope * x - intercept
    return slope, intercept, max(0.0, 1 - float(off @ off) / (float(((y - y.mean()) ** 2).sum()) + EPS))


def box_mean(a: np.ndarray, k: int) -> np.ndarray:
    """Mean over k x k neighbours, the borders mirrored without their edge."""
    p = np.pad(a.astype(float), k // 2, mode="reflect")
    w = np.lib.stride_tricks.sliding_window_view
    return w(w(p, k, axis=0).mean(axis=-1), k, axis=1).mean(axis=-1)


def beyond(v: np.ndarray, shares: tuple[float, float], least: int, low: bool) -> np.ndarray:
    """Places at or below (above) a quantile, or a wider one where they are fewer than ``least``."""
    for q in shares:
        cut = np.quantile(v, q)
        mask = v <= cut if low else v >= cut
        if mask.sum() >= least:
            break
    return mask


def falls(x: np.ndarray, v: np.ndarray, bins: int, least: int) -> float:
    """Share of falls between the medians of v in successive quantile bins of x that hold ``least`` values."""
    edges = np.quantile(x, np.linspace(0, 1, bins + 1))
    medians = []
    for k in range(bins):
        a, b = edges[k], edges[k + 1]
        if b > a:
            own = v[(x >= a) & ((x <= b) if b == edges[-1] else (x < b))]
            if own.size >= least:
                medians.append(np.median(own))
    return float((np.diff(medians) < 0).mean()) if len(medians) > 1 else 0.0


def keep_mask(shape: tuple[int, int], phases: tuple[int, ...], width: int = 1) -> np.ndarray:
    """Places more than ``width`` from every line of the eight-pixel grids of the phases."""

    def off(n: int) -> np.ndarray:
        d = (np.arange(n)[:, None] - np.array(phases)[None, :]) % 8
        return (np.minimum(d, 8 - d) > width).all(axis=1)

    return off(shape[0])[:, None] & off(shape[1])[None, :]


class Views:
    """What several families need of one patch."""

    def __init__(self, rgb: np.ndarray):
        self.rgb = rgb
        self.y, self.cr, self.cb = np.moveaxis(ycrcb(rgb), -1, 0)

    @cached_property
    def noise(self) -> dict[str, np.ndarray]:
        """Laplacian residuals of the three channels."""
        return {"y": K.convolved(self.y, P.EDGE3), "cr": K.convolved(self.cr - 128, P.EDGE3), "cb": K.convolved(self.cb - 128, P.EDGE3)}

    @cached_property
    def slopes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Horizontal and vertical gradient of luma, and its size."""
        gx, gy = (-K.convolved(self.y, k) for k in (P.SOBEL_X, P.SOBEL_Y))
        return gx, gy, np.hypot(gx, gy)


def rings(y: np.ndarray) -> np.ndarray:
    """Mean power at each rounded radius from the centre of the spectrum."""
    p = np.abs(np.fft.fftshift(np.fft.fft2(y) / y.size)) ** 2
    r = np.rint(np.hypot(*np.ogrid[-(y.shape[0] // 2) : y.shape[0] - y.shape[0] // 2, -(y.shape[1] // 2) : y.shape[1] - y.shape[1] // 2])).astype(int).ravel()
    return np.bincount(r, p.ravel()) / np.maximum(np.bincount(r), 1)


def frequency(v: Views) -> dict[str, float]:
    ring = rings(v.y)
    mid, radius = ring[8:33], np.arange(20, min(65, len(ring)))
    level = float(mid.mean())
    out = {"frs_mid_variance": float(mid.var() / (level**2 + EPS)) if level >= FLOOR else 0.0, "ps_alpha": 0.0, "ps_deviation_variance": 0.0}
    tail = ring[radius] if radius.size else ring[:0]
    if tail.size and (tail >= FLOOR).any():
        x, z = np.log(radius), np.log(np.maximum(tail, FLOOR))
        slope = float((x - x.mean()) @ (z - z.mean()) / (((x - x.mean()) ** 2).sum() + EPS))
        out |= {"ps_alpha": -slope, "ps_deviation_variance": float((z - slope * x).var())}
    return out


def color(v: Views) -> dict[str, float]:
    return {
        "pearson_y_cr": correlation(v.y, v.cr), "pearson_y_cb": correlation(v.y, v.cb), "pearson_cr_cb": correlation(v.cr, v.cb),
        "energy_ratio_chroma": float((v.cr.var() + v.cb.var()) / (v.y.var() + EPS)),
    }


def spatial(v: Views) -> dict[str, float]:
    size, g = {k: np.abs(n) for k, n in v.noise.items()}, v.slopes[2]
    flat, edge = beyond(g, (0.25, 0.4), 32, True), beyond(g, (0.75, 0.6), 32, False)
    at_edge, at_flat = (float(size["y"][m].mean()) if m.any() else 0.0 for m in (edge, flat))
    out = {"spatial_snr_ratio": float(np.log10((at_edge + FLOOR) / (at_flat + FLOOR))) if at_flat >= 1e-6 else 0.0, "cross_noise_ratio": float((size["y"].mean() + FLOOR) / (size["cb"].mean() + FLOOR))}
    for k, n in v.noise.items():
        out[f"skew_noise_{k}"], out[f"kurt_noise_{k}"] = skew_kurtosis(n)
    return out


def waves(residual: np.ndarray, name: str) -> dict[str, float]:
    """Share of the energy in the three waves of two pixels."""
    sx, sy = ((-1.0) ** np.arange(n) for n in residual.shape[::-1])
    whole = float((residual**2).sum()) * residual.size + EPS
    parts = {"x": (residual @ sx).sum(), "y": (sy @ residual).sum(), "xy": sy @ residual @ sx}
    return {f"{name}_pi_{k}": float(s**2 / whole) for k, s in parts.items()}


def cfa(v: Views) -> dict[str, float]:
    r, g, b = (v.rgb[..., k].astype(float) for k in range(3))
    differences = {"cfa_cr": v.noise["cr"], "cfa_cb": v.noise["cb"], "cfa_rg": K.convolved(r - g, P.EDGE3), "cfa_bg": K.convolved(b - g, P.EDGE3)}
    return {k: x for name, d in differences.items() for k, x in waves(d, name).items()}


def blocks(a: np.ndarray, n: int) -> np.ndarray:
    """Whole n x n blocks, one a row of the first axis."""
    h, w = (x // n for x in a.shape)
    return a[: h * n, : w * n].reshape(h, n, w, n).swapaxes(1, 2).reshape(h * w, n, n)


def noise_level(v: Views) -> dict[str, float]:
    """How the noise of flat blocks goes with their brightness."""
    b = blocks(v.y, 8)
    noise = blocks(v.noise["y"], 6).var(axis=(1, 2)) / 255**2
    n = min(len(b), len(noise))
    level, rough = b.mean(axis=(1, 2))[:n] / 255, (np.abs(np.diff(b, axis=2)).mean(axis=(1, 2)) + np.abs(np.diff(b, axis=1)).mean(axis=(1, 2)))[:n]
    keep = rough <= np.quantile(rough, 0.3)
    keep = keep if keep.sum() >= 16 else np.ones(n, bool)
    order = np.argsort(level[keep], kind="stable")
    m, z = level[keep][order], noise[:n][keep][order]
    rank = np.empty(len(z))
    rank[np.argsort(z, kind="stable")] = np.arange(len(z))
    d = m - m.mean()
    slope = float(d @ (z - z.mean()) / (d @ d + EPS))
    off = z - z.mean() - slope * d
    return {
        "nlf_spearman": correlation(np.arange(len(m)), rank), "nlf_slope": slope, "nlf_intercept": float(z.mean() - slope * m.mean()),
        "nlf_r2": max(0.0, 1 - float(off @ off) / (float(((z - z.mean()) ** 2).sum()) + EPS)), "nlf_monotone_violation": falls(m, z, 6, 2),
    }


def wavelet(v: Views) -> dict[str, float]:
    """How fine details follow the coarse ones, and how heavy their tails are."""
    low, high = K.haar(v.y[: len(v.y) // 4 * 4, : v.y.shape[1] // 4 * 4])
    fine = high * 2  # the averaging step divides by four, the orthonormal one by two
    coarse = K.haar(low * 2)[1] * 2
    out = {}
    for k, child, parent in zip("hvd", fine, coarse, strict=True):
        grouped = np.abs(child).reshape(parent.shape[0], 2, parent.shape[1], 2).mean(axis=(1, 3))
        out[f"wav_parent_corr_{k}"] = correlation(grouped, np.abs(parent))
    for k, level in (("l1", fine), ("l2", coarse)):
        out[f"wav_kurtosis_{k}"] = float(np.mean([skew_kurtosis(x)[1] for x in level]))
    return out


def srm(channel: np.ndarray, name: str, phases: tuple[int, ...] | None = None) -> dict[str, float]:
    """Residual sizes, over all places or those off the grids of the phases (128 at least)."""
    out, keep = {}, None if phases is None else keep_mask(channel.shape, phases)
    for k, kernel in SRM.items():
        r, half = K.convolved(channel, kernel), len(kernel) // 2
        if keep is not None:
            r = r[keep[half : half + r.shape[0], half : half + r.shape[1]]]
            r = r if r.size >= 128 else np.zeros(1)
        out |= {f"{name}_{k}_mar": float(np.abs(r).mean()), f"{name}_{k}_energy": float((r * r).mean())}
    return out


def local_hetero(v: Views) -> dict[str, float]:
    """How the noise around flat places goes with brightness."""
    r, g = v.noise["y"] / 255, v.slopes[2] / 255
    level, noise = box_mean(v.y / 255, 7)[1:-1, 1:-1], np.maximum(box_mean(r * r, 7), 0)
    flat, edge = beyond(g, (0.35, 0.5), 128, True), beyond(g, (0.8, 0.65), 128, False)
    x, z = level[flat], noise[flat]
    middle = lambda a: float(np.median(a)) if a.size else 0.0
    slope, _, r2 = line(x, z)
    return {
        "lochet_flat_slope": slope, "lochet_flat_r2": r2, "lochet_flat_cv": float(z.std() / (z.mean() + EPS)) if z.size else 0.0,
        "lochet_edge_flat_logratio": float(np.log((middle(noise[edge]) + FLOOR) / (middle(z) + FLOOR))), "lochet_flat_monotone_violation": falls(x, z, 5, 8) if x.size >= 16 else 0.0,
    }


def edge_consistency(v: Views) -> dict[str, float]:
    """How noise jumps across strong edges, and along them."""
    r, (gx, gy, g) = np.abs(v.noise["y"]) / 255, v.slopes
    strong = beyond(g, (0.9, 0.75), 128, False)[1:-1, 1:-1]
    jump = lambda a, b: np.abs(np.log((a + FLOOR) / (b + FLOOR)))
    sideways, upright = jump(r[1:-1, :-2], r[1:-1, 2:]), jump(r[:-2, 1:-1], r[2:, 1:-1])
    is_vertical = np.abs(gx)[1:-1, 1:-1] >= np.abs(gy)[1:-1, 1:-1]
    across, along = np.where(is_vertical, sideways, upright)[strong], np.where(is_vertical, upright, sideways)[strong]
    names = ("edge_cross_jump_median", "edge_cross_jump_p90", "edge_cross_along_ratio_median", "edge_grad_resid_corr")
    if across.size < 32:
        return dict.fromkeys(names, 0.0)
    values = np.median(across), np.quantile(across, 0.9), np.median((across + EPS) / (along + EPS)), correlation(g[1:-1, 1:-1][strong] / 255, r[1:-1, 1:-1][strong])
    return dict(zip(names, map(float, values), strict=True))


def peak(series: np.ndarray, first: int = 2, last: int = 32) -> float:
    """Largest autocorrelation of a series over the lags."""
    x = series - series.mean()
    energy = float(x @ x)
    if x.size < last + 4 or energy <= EPS:
        return 0.0
    return max(float(x[:-k] @ x[k:]) / energy for k in range(first, min(last + 1, x.size - 1)))


def resampling(v: Views) -> dict[str, float]:
    y = v.y / 255
    px, py = peak(np.abs(np.diff(y, 2, axis=1)).mean(axis=0)), peak(np.abs(np.diff(y, 2, axis=0)).mean(axis=1))
    return {"resamp_peak_x": px, "resamp_peak_y": py, "resamp_peak_mean": (px + py) / 2}


def lbp(channel: np.ndarray, name: str) -> dict[str, float]:
    """Patterns of the eight neighbours: share of those that change more than twice, and entropy with them as one."""
    n = np.lib.stride_tricks.sliding_window_view(channel, (3, 3))
    bits = np.stack([n[..., 1 + r, 1 + c] >= n[..., 1, 1] for r, c in RING], axis=-1)
    turns = (bits != np.roll(bits, -1, axis=-1)).sum(axis=-1)
    code = np.where(turns > 2, 256, np.packbits(bits, axis=-1, bitorder="little")[..., 0].astype(int))
    p = np.bincount(code.ravel(), minlength=257) / code.size
    some = p[p > 0]
    return {f"{name}_nonuniform_ratio": float(p[256]), f"{name}_entropy": float(-(some * np.log2(some)).sum())}


def features(rgb: np.ndarray, version: str = "v4") -> dict[str, float]:
    """All study features of one patch."""
    v = Views(rgb)
    out = frequency(v) | color(v) | spatial(v) | cfa(v) | noise_level(v) | wavelet(v) | srm(v.y, "ysrm")
    out |= srm(v.y, "ysrm_native_mask", NATIVE_PHASES[version]) | srm(v.y, "ysrm_union_mask", (0, 4)) | srm(v.cr - 128, "crsrm")
    out |= lbp(v.y, "ylbp") | lbp(v.cr, "crlbp") | lbp(v.cb, "cblbp")
    return out | local_hetero(v) | edge_consistency(v) | resampling(v)


def quadrants(rgb: np.ndarray, f) -> dict[str, tuple[float, float, float]]:
    """Each feature of ``f`` over the whole patch, and its mean and deviation over the four quadrants."""
    h, w = (n // 2 for n in rgb.shape[:2])
    whole, parts = f(rgb), [f(rgb[a : a + h, b : b + w]) for a in (0, h) for b in (0, w)]
    return {k: (x, float(np.mean([p[k] for p in parts])), float(np.std([p[k] for p in parts]))) for k, x in whole.items()}


def resized(rgb: np.ndarray, scale: float) -> np.ndarray:
    """Down and up by bilinear samples without smoothing, sixteen pixels at least."""

    def weights(n: int, m: int) -> np.ndarray:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(n)[None, :]))

    def to(a: np.ndarray, h: int, w: int) -> np.ndarray:
        x = np.einsum("ab,cd,bde->ace", weights(a.shape[0], h), weights(a.shape[1], w), a.astype(float))
        return np.clip(np.rint(x), 0, 255).astype(np.uint8)

    h, w = rgb.shape[:2]
    return to(to(rgb, max(16, round(h * scale)), max(16, round(w * scale))), h, w)


def degraded(rgb: np.ndarray, name: str) -> np.ndarray:
    """A patch after one of the named degradations of the study, or as it is (``clean``)."""
    if name.startswith("resize"):
        rgb = resized(rgb, int(name[6:8]) / 100)
    if "jpeg" in name:
        rgb = K.jpeg_roundtrip(rgb, int(name.split("jpeg")[1][:2]))
    return rgb


def extract(df: DataFrame, id_col: str, patch_col: str, n: int, degradations: tuple[str, ...] = ("clean",), version: str = "v4") -> DataFrame:
    """id, degradation, the features, status and error: each patch of n * n * 3 bytes once for every degradation.

    A row becomes several inside the task that reads it; a patch that fails is a row with its reason.
    """
    names = list(features(np.random.default_rng(0).integers(0, 256, (64, 64, 3), dtype=np.uint8), version))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, data in zip(b[id_col], b[patch_col], strict=True):
                for d in degradations:
                    try:
                        f = features(degraded(np.frombuffer(data, np.uint8).reshape(n, n, 3), d), version)
                        rows.append((key, d, *[f[k] for k in names], "ok", ""))
                    except Exception as e:  # a bad patch is a row with its reason
                        rows.append((key, d, *[float("nan")] * len(names), "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[id_col, "degradation", *names, "status", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, patch_col).mapInPandas(run, f"{id_col} {kind}, degradation string, " + ", ".join(f"{k} double" for k in names) + ", status string, error string")
