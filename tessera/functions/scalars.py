"""Column expressions: null- and NaN-safe predicates, rounding, routing, geometry, paths, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seed of every hash order in the library.
SEED = "42"


def finite(c: Column) -> Column:
    """Whether a double is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def at_least(c: Column, t: Column) -> Column:
    """``c >= t`` that is false for null and NaN (Spark ranks NaN above all numbers)."""
    return F.coalesce(~F.isnan(c) & (c >= t), F.lit(False))


def gated(source: Column, gate: Column) -> Column:
    """Source times gate; NaN stays NaN."""
    return source * gate


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def safe_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def winsorised(c: Column, low: Column, high: Column) -> Column:
    """Clipped to [low, high]; NaN and null stay."""
    return F.when(F.isnan(c), c).otherwise(F.when(c.isNotNull(), F.greatest(F.least(c, high), low)))


def route(score: Column, tau: Column, low: float = 0.30) -> Column:
    """LOW / MEDIUM / HIGH of a score with its action, as a struct."""
    level = F.when(score < low, "LOW").when(score >= tau, "HIGH").otherwise("MEDIUM")
    action = F.when(score < low, "pass").when(score >= tau, "flag").otherwise("review")
    return F.struct(level.alias("level"), action.alias("action"))


def shortcut_level(auc: Column) -> Column:
    return F.when(auc.isNull() | F.isnan(auc), "unknown").when(auc >= 0.8, "high").when(auc >= 0.65, "medium").otherwise("low")


def rate_level(gap: Column) -> Column:
    return F.when(gap > 0.30, "HIGH").when(gap > 0.10, "MEDIUM").otherwise("LOW")


def ood_group(generator: Column, ood: list[str]) -> Column:
    """OOD, ID or UNKNOWN by the generator's name without separators and case."""
    plain = F.translate(F.lower(generator), "-_. ", "")
    return F.when(generator.isNull(), "UNKNOWN").when(plain.isin(*ood), "OOD").otherwise("ID")


def status(decoded: Column, fmt: Column, mode: Column, width: Column, height: Column, support: int = 252) -> Column:
    """The fail-closed decision on an image, first reason first."""
    return (
        F.when(~F.coalesce(decoded, F.lit(False)), "DECODE_ERROR")
        .when(~F.coalesce(fmt.isin("JPEG", "PNG"), F.lit(False)), "UNSUPPORTED_INPUT")
        .when(~F.coalesce(mode.isin("RGB", "RGBA"), F.lit(False)), "UNSUPPORTED_INPUT")
        .when(F.least(width, height) < support, "LOW_SUPPORT")
        .otherwise("ACCEPTED")
    )


def three_valued(c: Column) -> Column:
    """A string as boolean, null where it says neither."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("true", "1", "yes", "y", "t"), True).when(s.isin("false", "0", "no", "n", "f"), False)


def composite(channel: Column, alpha: Column, background: int = 128) -> Column:
    """Straight alpha over a grey background, rounded as integers."""
    return F.floor((alpha * channel + (255 - alpha) * background + 127) / 255).cast("int")


def residue_start(length: Column, crop: int, residue: int, phase: int = 8) -> Column:
    """The crop's start that is ``residue`` modulo ``phase`` and nearest to the centre, the smaller of two; null if none fits."""
    ideal = (length - crop) / 2
    k = F.ceil((ideal - residue) / phase - 0.5)
    top = F.floor((length - crop - residue) / phase)
    return F.when(length - crop >= residue, residue + phase * F.greatest(F.lit(0), F.least(k, top))).cast("long")


def phase_distance(a: Column, b: Column, phase: int = 8) -> Column:
    d = F.pmod(a - b, F.lit(phase))
    return F.least(d, phase - d)


def path_key(p: Column) -> Column:
    """A path for joining: forward slashes, trimmed, lower case."""
    return F.lower(F.trim(F.replace(p, F.lit("\\"), F.lit("/"))))


def after_marker(p: Column, marker: str, required: bool = False) -> Column:
    """What follows the first ``marker`` in any case, or null; an error that names the path where it is required."""
    at = F.instr(F.lower(p), marker.lower())
    rest = F.when(at > 0, F.substring(p, at + len(marker), F.length(p)))
    return rest.when(p.isNotNull(), F.raise_error(F.concat(F.lit(f"no {marker} in "), p))) if required else rest


def with_suffix(p: Column, suffix: str) -> Column:
    return F.regexp_replace(p, r"\.[^./]+$", suffix)


def first_part(rel: Column, words: dict[str, str]) -> Column:
    """The value of the first folder of a path whose lower-cased name is a key of ``words``."""
    folders = F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    pairs = F.create_map(*[F.lit(x) for kv in sorted(words.items()) for x in kv])
    return F.get(F.filter(F.transform(folders, lambda x: pairs[F.lower(x)]), lambda x: x.isNotNull()), 0)


def any_part(rel: Column, order: list[tuple[str, str]], default: str = "unknown") -> Column:
    """The value of the first of ``order`` whose name any part has, however deep."""
    parts = F.split(F.lower(rel), "/")
    out = F.lit(default)
    for word, value in reversed(order):
        out = F.when(F.array_contains(parts, word), value).otherwise(out)
    return out


def hash_key(*cols: Column, seed: str = SEED) -> Column:
    """Order by this for a reproducible shuffle; DuckDB's sha256 gives the same."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]), 256)


def clean_text(content: Column) -> Column:
    """Bytes as text, what is no UTF-8 replaced, without blanks and zero bytes at the ends; null where nothing is left."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.nullif(F.regexp_replace(text, r"^[ \x00]+|[ \x00]+$", ""), F.lit(""))


def jpeg_quality(table: Column, standard: list[int]) -> Column:
    """Estimated quality of a quantisation table of 64 integers."""
    n = len(standard)
    avg = F.aggregate(F.zip_with(table, F.array(*[F.lit(x) for x in standard]), lambda a, b: a * 100.0 / b), F.lit(0.0), lambda s, x: s + x) / n
    q = F.when(avg >= 100, F.bround(5000 / avg)).otherwise(F.bround((200 - avg) / 2))
    return F.least(F.lit(100), F.greatest(F.lit(1), q.cast("int")))
