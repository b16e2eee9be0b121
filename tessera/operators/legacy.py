"""Geometry and proxies of the earlier pipelines: padding, shifted crops, hash picks, chroma halving."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import kernels as K
from tessera.operators import patches as P
from tessera.operators.study import lbp, rings

# Sizes of the earlier pipelines.
CROP, SHIFT, LEAST = 256, 3, 259


def hash_number(key: Column) -> Column:
    """The first four bytes of the key's SHA-256 as a little-endian number."""
    h = F.substring(F.sha2(key.cast("binary"), 256), 1, 8)
    pairs = [F.substring(h, k, 2) for k in (7, 5, 3, 1)]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def hash_quality(key: Column, low: int = 90, high: int = 98) -> Column:
    """A quality from ``low`` to ``high`` by the key's hash."""
    return (F.lit(low) + hash_number(key) % (high - low + 1)).cast("int")


def hash_pick(key: Column, pool: list) -> Column:
    """One of the sorted ``pool`` by the key's hash."""
    return F.element_at(F.array(*[F.lit(x) for x in sorted(pool)]), (hash_number(key) % len(pool) + 1).cast("int"))


def _start(n: Column, crop: int, least: int) -> tuple[Column, Column]:
    """Start of the central crop of a side padded to ``least``, and how much was padded before it."""
    padded = F.greatest(n, F.lit(least))
    return F.floor(padded / 2) - crop // 2, F.greatest(F.floor((F.lit(least) - n) / 2), F.lit(0))


def on_grid(width: Column, height: Column, crop: int = CROP, least: int = LEAST) -> Column:
    """Whether a side of the central crop lies on the source's eight-pixel grid."""
    (x, px), (y, py) = _start(width, crop, least), _start(height, crop, least)
    return (F.pmod(x - px, F.lit(8)) == 0) | (F.pmod(y - py, F.lit(8)) == 0)


def padded(rgb: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, tuple[int, int]]:
    """Mirrored without the edge to ``least`` a side, and the columns and rows added before."""
    add = [max(0, least - n) for n in rgb.shape[:2]]
    before = [a // 2 for a in add]
    if any(add):
        rgb = np.pad(rgb, [(b, a - b) for a, b in zip(add, before, strict=True)] + [(0, 0)] * (rgb.ndim - 2), mode="reflect")
    return rgb, (before[1], before[0])


def shifted_crop(rgb: np.ndarray, mode: str = "conditional", crop: int = CROP, shift: int = SHIFT, origin: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, bool]:
    """The central crop, moved by ``shift`` always, never or where it lies on the grid, and whether it was."""
    h, w = rgb.shape[:2]
    x, y = w // 2 - crop // 2, h // 2 - crop // 2
    moved = {"all": True, "none": False, "conditional": (x - origin[0]) % 8 == 0 or (y - origin[1]) % 8 == 0}[mode]
    x, y = (min(max(0, v + shift * moved), n - crop) for v, n in ((x, w), (y, h)))
    return rgb[y : y + crop, x : x + crop], moved


def residue_crop(rgb: np.ndarray, crop: int, residue: int | tuple[int, int], phase: int = 8) -> np.ndarray:
    """The crop whose starts are ``residue`` (or one for columns and one for rows) on the grid and nearest to half the side less half the crop, the smaller of two."""
    across, down = residue if isinstance(residue, tuple) else (residue, residue)

    def start(n: int, r: int) -> int:
        some = np.arange(r, n - crop + 1, phase)
        if not some.size:
            raise ValueError(f"LOW_SUPPORT: {n} for {crop} at {r}")
        return int(min(some, key=lambda s: (abs(s - (n // 2 - crop // 2)), s)))

    y, x = start(rgb.shape[0], down), start(rgb.shape[1], across)
    return rgb[y : y + crop, x : x + crop]


def short_side(rgb: np.ndarray, n: int) -> np.ndarray:
    """Resized so that the short side has ``n`` pixels."""
    h, w = rgb.shape[:2]
    s = n / min(h, w)
    return K.resized(rgb, max(1, round(h * s)), max(1, round(w * s)))


def bottleneck(rgb: np.ndarray, key: str, low: int = 90, high: int = 98) -> np.ndarray:
    """A round trip at the quality that the key's hash gives."""
    import hashlib

    number = int.from_bytes(hashlib.sha256(key.encode()).digest()[:4], "little")
    return K.jpeg_roundtrip(rgb, low + number % (high - low + 1))


_BINOMIAL = np.array([1, 4, 6, 4, 1]) / 16
_CUBIC = -0.75


def _doubled(n: int) -> np.ndarray:
    """Weights of a cubic resize from n to 2n samples, the edges repeated."""
    at = (np.arange(2 * n) + 0.5) / 2 - 0.5
    base, out = np.floor(at).astype(int), np.zeros((2 * n, n))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        near = (_CUBIC + 2) * d**3 - (_CUBIC + 3) * d**2 + 1
        far = _CUBIC * (d**3 - 5 * d**2 + 8 * d - 4)
        np.add.at(out, (np.arange(2 * n), np.clip(base + k, 0, n - 1)), np.where(d <= 1, near, far))
    return out


def chroma_halved(ycrcb: np.ndarray) -> np.ndarray:
    """Chroma blurred, averaged two by two and enlarged again; sides are even."""
    out = ycrcb.astype(float)
    for k in (1, 2):
        c = np.pad(out[..., k], 2, mode="reflect")
        for axis in (0, 1):
            c = np.apply_along_axis(np.convolve, axis, c, _BINOMIAL, "valid")
        h, w = (n // 2 for n in c.shape)
        c = c.reshape(h, 2, w, 2).mean(axis=(1, 3))
        out[..., k] = _doubled(h) @ c @ _doubled(w).T
    return np.clip(out, 0, 255).astype(np.uint8)


def chroma_highband(ycrcb: np.ndarray) -> float:
    """Share of the chroma's power outside the central half of the spectrum."""
    whole = high = 0.0
    for k in (1, 2):
        p = np.abs(np.fft.fft2(ycrcb[..., k].astype(float) - 128)) ** 2
        far = [np.abs(np.rint(np.fft.fftfreq(n) * n)) > n // 4 for n in p.shape]
        whole, high = whole + p.sum(), high + p[far[0][:, None] | far[1][None, :]].sum()
    return float(high / whole) if whole > 0 else 0.0


def proxies(ycrcb: np.ndarray) -> dict[str, float]:
    """The five cheap stand-ins for the earlier features."""
    y, cr, cb = (ycrcb[..., k].astype(float) for k in range(3))
    n = len(y)
    ring, floor = rings(y), 1 / n**2
    r = np.arange(20, min(64, len(ring) - 1) + 1)
    alpha = 0.0 if not r.size or (ring[r] < floor).all() else float(-np.polyfit(np.log(r), np.log(ring[r] + floor), 1)[0])
    size = lambda c: float(np.abs(K.convolved(c, P.SQUARE3)).mean())
    return {
        "ps_alpha": alpha, "cross_noise_ratio": (size(y) + 1e-3) / (size(cb) + 1e-3), "srm_square3_energy_cr": float((K.convolved(cr - 128, P.SQUARE3) ** 2).mean()),
        "lbp_nonuniform_ratio_cr": lbp(cr, "c")["c_nonuniform_ratio"], "lbp_nonuniform_ratio_cb": lbp(cb, "c")["c_nonuniform_ratio"],
    }
