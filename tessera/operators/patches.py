"""Signal operators on square patches held as arrays of doubles, as column expressions.

A patch of n x n is an array in row order. Everything here maps a row to scalars or arrays inside the JVM,
without exploding pixels, so nothing is shuffled. ``kernels`` has the same operators in numpy for large
patches; tests hold the two against each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8

# Residual kernels and gradient kernels.
EDGE3 = ((0.0, -1.0, 0.0), (-1.0, 4.0, -1.0), (0.0, -1.0, 0.0))
SQUARE3 = ((-1.0, 2.0, -1.0), (2.0, -4.0, 2.0), (-1.0, 2.0, -1.0))
SQUARE5 = ((0.0, 0.0, 0.25, 0.0, 0.0), (0.0, 0.0, -0.5, 0.0, 0.0), (0.25, -0.5, 1.0, -0.5, 0.25), (0.0, 0.0, -0.5, 0.0, 0.0), (0.0, 0.0, 0.25, 0.0, 0.0))
SOBEL_X = ((-1.0, 0.0, 1.0), (-2.0, 0.0, 2.0), (-1.0, 0.0, 1.0))
SOBEL_Y = ((-1.0, -2.0, -1.0), (0.0, 0.0, 0.0), (1.0, 2.0, 1.0))


def total(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def bound(value: Column, f):
    """``f(value)`` with the value computed once, even where ``f`` uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), f), 1)


def variance(a: Column) -> Column:
    return bound(mean(a), lambda m: total(a, lambda x: (x - m) * (x - m))) / F.size(a)


def skew_kurtosis(a: Column, least: int = 32) -> tuple[Column, Column]:
    """Population moments with EPS in the denominators; 0 for few or constant values."""

    def of(m: Column) -> Column:
        sums = F.aggregate(a, F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"), F.lit(0.0).alias("r")), lambda s, x: F.struct(
            (s["p"] + (x - m) * (x - m)).alias("p"), (s["q"] + (x - m) * (x - m) * (x - m)).alias("q"), (s["r"] + (x - m) * (x - m) * (x - m) * (x - m)).alias("r"),
        ))
        return F.transform(F.array(sums), lambda s: F.struct(F.sqrt(s["p"] / F.size(a)).alias("s"), (s["q"] / F.size(a)).alias("m3"), (s["r"] / F.size(a)).alias("m4")))

    v = F.element_at(bound(mean(a), of), 1)
    bad = lambda s: (F.size(a) < least) | (s < EPS)
    skew = bound(v, lambda v: F.when(bad(v["s"]), 0.0).otherwise(v["m3"] / (v["s"] * v["s"] * v["s"] + EPS)))
    return skew, bound(v, lambda v: F.when(bad(v["s"]), 0.0).otherwise(v["m4"] / (v["s"] * v["s"] * v["s"] * v["s"] + EPS) - 3))


def correlation(a: Column, b: Column) -> Column:
    """Population correlation with EPS; 0 if either is constant."""
    means = F.struct(mean(a).alias("a"), mean(b).alias("b"))
    c = bound(means, lambda m: total(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"])))) / F.size(a)
    spread = F.struct(F.sqrt(variance(a)).alias("a"), F.sqrt(variance(b)).alias("b"), c.alias("c"))
    return bound(spread, lambda s: F.when((s["a"] < EPS) | (s["b"] < EPS), 0.0).otherwise(s["c"] / (s["a"] * s["b"] + EPS)))


def trimmed_mean(a: Column, share: float = 0.05) -> Column:
    n = F.size(a)
    cut = F.floor(n * share).cast("int")
    return F.when(2 * cut >= n, mean(a)).otherwise(mean(F.slice(F.array_sort(a), cut + 1, n - 2 * cut)))


def at(a: Column, i: Column) -> Column:
    return F.element_at(a, (i + 1).cast("int"))


def convolved(a: Column, n: int, kernel) -> Column:
    """Valid convolution (kernel flipped), as an array of (n - k + 1) squared."""
    k = len(kernel)
    m = n - k + 1

    def one(i: Column) -> Column:
        base = F.floor(i / m) * n + i % m
        terms = [F.lit(float(kernel[k - 1 - r][k - 1 - c])) * at(a, base + r * n + c) for r in range(k) for c in range(k) if kernel[k - 1 - r][k - 1 - c]]
        return sum(terms[1:], terms[0])

    return F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), one)


def sobel(a: Column, n: int) -> Column:
    return F.zip_with(convolved(a, n, SOBEL_X), convolved(a, n, SOBEL_Y), lambda x, y: F.sqrt(x * x + y * y))


def box_mean(a: Column, n: int, k: int) -> Column:
    return convolved(a, n, tuple((1 / (k * k),) * k for _ in range(k)))


def box_variance(a: Column, n: int, k: int) -> Column:
    m, q = box_mean(a, n, k), box_mean(F.transform(a, lambda x: x * x), n, k)
    return F.zip_with(q, m, lambda x, y: F.greatest(F.lit(0.0), x - y * y))


def haar(a: Column, n: int) -> tuple[Column, Column]:
    """Averaging Haar step: the low band (n/2 squared) and the three high bands after one another."""
    m = n // 2
    idx = F.sequence(F.lit(0), F.lit(m * m - 1))

    def band(signs):
        def one(i: Column) -> Column:
            base = F.floor(i / m) * (2 * n) + (i % m) * 2
            p, q, r, s = (at(a, base + d) for d in (0, 1, n, n + 1))
            return (p + signs[0] * q + signs[1] * r + signs[2] * s) * 0.25

        return F.transform(idx, one)

    return band((1, 1, 1)), F.concat(band((-1, 1, -1)), band((1, -1, -1)), band((-1, -1, 1)))


def checkerboard(a: Column, n: int) -> Column:
    """|mean of the high-pass residual times alternating signs| over its root mean square."""
    d = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: at(a, i) * F.when((F.floor(i / n) + i % n) % 2 == 0, 1.0).otherwise(-1.0))
    return F.abs(mean(d)) / (F.sqrt(total(a, lambda x: x * x) / F.size(a)) + EPS)


def power_at(c: Column, n: int, u: int, v: int) -> Column:
    """Power of the mean-removed patch over n**4 at one frequency; its waves are constant arrays."""
    angle = [2 * math.pi * (u * r + v * q) / n for r in range(n) for q in range(n)]
    part = lambda f: total(F.zip_with(c, F.array(*[F.lit(f(x)) for x in angle]), lambda x, w: x * w))
    re, im = part(math.cos), part(math.sin)
    return (re * re + im * im) / float(n) ** 4


def band_energy(c: Column, n: int, low: float, high: float) -> Column:
    """Mean power at radii (cycles a pixel) in [low, high) of a mean-removed patch.

    Power is the same at opposite frequencies, so one of each pair is computed.
    """
    f = [k / n if k < (n + 1) // 2 else k / n - 1 for k in range(n)]
    places = [(u, v) for u in range(n) for v in range(n) if low <= math.hypot(f[u], f[v]) < high]
    terms = []
    for u, v in places:
        other = (-u % n, -v % n)
        if other >= (u, v):
            terms.append(power_at(c, n, u, v) * (1.0 if other == (u, v) else 2.0))
    return sum(terms[1:], terms[0]) / len(places)


def autocorrelation(c: Column, n: int, lags: list[int]) -> Column:
    """Largest absolute autocorrelation of a mean-removed patch's rows over the lags, over its energy."""
    energy = total(c, lambda x: x * x)
    one = lambda k: F.abs(total(F.transform(F.filter(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: i % n < n - k), lambda i: at(c, i) * at(c, i + k)))) / (energy + EPS)
    return F.greatest(*[one(k) for k in lags])


def lbp_nonuniform(a: Column, n: int) -> Column:
    """Share of inner pixels whose eight neighbours, compared with them in a circle, change more than twice."""
    m = n - 2
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]

    def one(i: Column) -> Column:
        base = (F.floor(i / m) + 1) * n + i % m + 1
        bits = [(at(a, base + r * n + c) >= at(a, base)).cast("int") for r, c in ring]
        turns = sum((F.abs(bits[k] - bits[(k + 1) % 8]) for k in range(1, 8)), F.abs(bits[0] - bits[1]))
        return (turns > 2).cast("double")

    return mean(F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), one))
