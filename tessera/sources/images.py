"""Image corpora: discovery, header facts, decoding and the preprocessing manifest."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as X

# Suffixes that are looked for.
SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp", ".tif", ".tiff"]


def _files(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))


def discover(spark: SparkSession, root: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """path, length and modificationTime of the images below ``root``, by suffix, in order of path; contents are not read."""
    return _files(spark, root, suffixes).select("path", "length", "modificationTime").orderBy("path")


def contents(spark: SparkSession, root: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    return _files(spark, root, suffixes).select("path", "length", "content")


def npy_header(data: bytes) -> tuple[str, list[int], int]:
    """Type, shape and where the values begin of an array file in row order; objects and Fortran order are refused."""
    import ast

    if data[:6] != b"\x93NUMPY":
        raise ValueError("no array file")
    wide = data[6] > 1
    (n,) = struct.unpack_from("<I" if wide else "<H", data, 8)
    at = (12 if wide else 10) + n
    h = ast.literal_eval(data[at - n : at].decode("latin-1"))
    if h["fortran_order"] or "O" in h["descr"]:
        raise ValueError("only plain values in row order are read")
    return h["descr"], list(h["shape"]), at


def arrays(spark: SparkSession, root: str, shape: tuple[int, ...] | None = None) -> DataFrame:
    """path, dtype, shape, values (bytes) and error of the .npy files below ``root``; another shape than asked for is an error."""

    @F.pandas_udf("dtype string, shape array<int>, values binary, error string")
    def parsed(c):
        rows = []
        for x in c:
            try:
                kind, size, at = npy_header(bytes(x))
                if shape is not None and tuple(size) != tuple(shape):
                    raise ValueError(f"shape {size}")
                rows.append((kind, size, bytes(x)[at:], None))
            except (ValueError, SyntaxError, KeyError, struct.error) as e:
                rows.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["dtype", "shape", "values", "error"]).astype(object)

    return contents(spark, root, [".npy"]).select("path", parsed("content").alias("x")).select("path", "x.*")


def tree_counts(files: DataFrame) -> DataFrame:
    """Images in each folder."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n"))


def label_counts(files: DataFrame) -> DataFrame:
    """Images by generator and label, the two folders above a file."""
    p = F.split("path", "/")
    return files.groupBy(F.element_at(p, -3).alias("generator"), F.element_at(p, -2).alias("label")).agg(F.count("*").alias("n"))


def _orientation(tiff: bytes) -> int | None:
    """Tag 0x0112 of the first directory of a TIFF structure, if it is 1 to 8."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8 or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
        return None
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(n):
        tag, kind, _ = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        if tag == 0x0112 and kind in (3, 4):
            (v,) = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, at + 10 + 12 * k)
            return v if 1 <= v <= 8 else None
    return None


def _tiff(data: bytes) -> dict[int, int]:
    """Tags of the first directory with their first value, or offset where that is elsewhere."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        short = kind == 3 and count <= 2
        (out[tag],) = struct.unpack_from(order + ("H" if short else "I"), data, at + 10 + 12 * k)
    return out


def _has_iptc(body: bytes) -> bool:
    """Whether Photoshop resources hold one of IPTC (0x0404) that is not empty."""
    at = 14
    while body[at : at + 4] == b"8BIM":
        (name,) = struct.unpack_from(">H", body, at + 4)
        at += 6 + (body[at + 6] + 2) // 2 * 2
        (size,) = struct.unpack_from(">I", body, at)
        if name == 0x0404:
            return size > 0
        at += 4 + (size + 1) // 2 * 2
    return False


def header(data: bytes) -> dict:
    """Facts of a JPEG, PNG or TIFF from its structure; keys that do not apply, and all of other formats, are None."""
    out = dict.fromkeys(["format", "mode", "width", "height", "bit_depth", "orientation", "has_exif", "has_icc", "progressive", "subsampling", "quality", "n_tables", "has_xmp", "has_iptc"])
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, depth, color = struct.unpack_from(">IIBB", data, 16)
            out |= {"format": "PNG", "width": w, "height": h, "bit_depth": depth, "mode": {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(color), "has_exif": False, "has_icc": False, "has_xmp": False, "has_iptc": False}
            at, kind = 8, b""
            while at + 8 <= len(data) and kind != b"IEND":
                size, kind = struct.unpack_from(">I4s", data, at)
                body = at + 8
                if kind == b"eXIf":
                    out["has_exif"] = True
                    out["orientation"] = _orientation(data[body : body + size])
                out["has_icc"] |= kind == b"iCCP"
                out["has_xmp"] |= kind == b"iTXt" and data[body : body + 18] == b"XML:com.adobe.xmp\0"
                at = body + size + 4
        elif data[:4] in (b"II*\0", b"MM\0*"):
            tags = _tiff(data)
            out |= {"format": "TIFF", "width": tags.get(256), "height": tags.get(257), "has_exif": 34665 in tags, "has_icc": 34675 in tags, "has_xmp": 700 in tags, "has_iptc": 33723 in tags}
            out["orientation"] = _orientation(data)
        elif data[:6] in (b"GIF87a", b"GIF89a"):
            out |= {"format": "GIF", "mode": "P"} | dict(zip(("width", "height"), struct.unpack_from("<HH", data, 6), strict=True))
        elif data[:2] == b"BM":
            w, h = struct.unpack_from("<ii", data, 18)
            out |= {"format": "BMP", "width": w, "height": abs(h)}
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            out["format"] = "WEBP"
        elif data[:3] == b"\xff\xd8\xff":
            out |= {"format": "JPEG", "has_exif": False, "has_icc": False, "has_xmp": False, "has_iptc": False, "n_tables": 0}
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF:
                if data[at + 1] == 0xFF:  # bytes that fill up
                    at += 1
                    continue
                kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                body = data[at + 4 : at + 2 + size]
                if kind == 0xE1 and body[:6] == b"Exif\0\0":
                    out |= {"has_exif": True, "orientation": _orientation(body[6:])}
                elif kind == 0xE1 and body[:29] == b"http://ns.adobe.com/xap/1.0/\0":
                    out["has_xmp"] = True
                elif kind == 0xED and body[:14] == b"Photoshop 3.0\0":
                    out["has_iptc"] |= _has_iptc(body)
                elif kind == 0xE2 and body[:11] == b"ICC_PROFILE":
                    out["has_icc"] = True
                elif kind == 0xDB:
                    k = 0
                    while k < len(body):
                        wide = body[k] >> 4
                        table = struct.unpack_from(">64H" if wide else "64B", body, k + 1)
                        if body[k] & 15 == 0:
                            out["quality"] = quality_of(table)
                        out["n_tables"] += 1
                        k += 129 if wide else 65
                elif kind in (0xC0, 0xC1, 0xC2):
                    depth, h, w, n = struct.unpack_from(">BHHB", body)
                    out |= {"width": w, "height": h, "bit_depth": depth, "mode": {1: "L", 3: "RGB", 4: "CMYK"}.get(n), "progressive": kind == 0xC2}
                    if n == 3:
                        first = body[7]
                        out["subsampling"] = {0x11: "4:4:4", 0x21: "4:2:2", 0x22: "4:2:0"}.get(first)
                elif kind == 0xDA:
                    break
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return out


def zigzag() -> list[int]:
    """The places of an 8 x 8 block in the order of its diagonals, by turns upwards and downwards."""
    return [8 * r + c for _, _, r, c in sorted((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8))]


def stripped(data: bytes) -> bytes:
    """A JPEG or PNG without its metadata: the pixels' segments and chunks as they are, nothing is encoded again."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        out, at = [data[:8]], 8
        while at + 12 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            if kind not in (b"eXIf", b"tEXt", b"zTXt", b"iTXt", b"iCCP", b"tIME"):
                out.append(data[at : at + 12 + size])
            at += 12 + size
            if kind == b"IEND":
                return b"".join(out)
        raise ValueError("PNG without end")
    if data[:3] == b"\xff\xd8\xff":
        out, at = [data[:2]], 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
            elif kind == 0xDA:  # the scan and what follows it
                return b"".join([*out, data[at:]])
            else:
                size = struct.unpack_from(">H", data, at + 2)[0]
                if kind not in (*range(0xE1, 0xEE), 0xEF, 0xFE):  # application segments but JFIF and Adobe, comments
                    out.append(data[at : at + 2 + size])
                at += 2 + size
        raise ValueError("JPEG without a scan")
    raise ValueError("neither JPEG nor PNG")


def strip_metadata(files: DataFrame) -> DataFrame:
    """path, action (processed or failed), error and the content without metadata of every file (path, content)."""

    @F.pandas_udf("action string, error string, content binary")
    def run(c):
        rows = []
        for x in c:
            try:
                rows.append(("processed", None, stripped(bytes(x))))
            except (ValueError, struct.error) as e:
                rows.append(("failed", f"{type(e).__name__}: {e}", None))
        return pd.DataFrame(rows, columns=["action", "error", "content"]).astype(object)

    return files.select("path", run("content").alias("x")).select("path", "x.*")


def quality_of(table) -> int:
    """Estimated quality of a luminance table in zigzag order against the standard's table, place by place."""
    from tessera.operators.kernels import LUMA

    mean = float(np.mean([q * 100 / LUMA[at] for q, at in zip(table, zigzag(), strict=True)]))
    return int(min(100, max(1, round(5000 / mean) if mean >= 100 else round((200 - mean) / 2))))


_FACTS = "format string, mode string, width int, height int, bit_depth int, orientation int, has_exif boolean, has_icc boolean, progressive boolean, subsampling string, quality int, n_tables int, has_xmp boolean, has_iptc boolean"


def metadata(files: DataFrame) -> DataFrame:
    """path, size, SHA-256 and header facts of every file; what can't be read is null."""

    @F.pandas_udf(_FACTS)
    def facts(c):
        return pd.DataFrame([header(bytes(x)) for x in c]).astype(object)

    f = files.select("path", F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("sha256"), facts("content").alias("f"))
    return f.select("path", "file_size_bytes", "sha256", "f.*")


def manifest(spark: SparkSession, root: str, crop: int = 248, residue: int = 4, support: int = 252) -> DataFrame:
    """One row per image: status, size, crop origin and the canonical patch (null unless accepted).

    Pixels come from Spark's own image source; alpha is composited over grey and the orientation undone.
    """
    from tessera.operators.kernels import ORIENTATIONS

    facts = metadata(contents(spark, root)).select("path", "format", "mode", "orientation")
    px = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    px = px.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))
    key = F.regexp_replace("path", "^file:/+", "/")
    j = facts.withColumn("path", key).join(px.withColumn("path", key), "path", "left")
    turned = F.coalesce("orientation", F.lit(1)) >= 5
    w, h = F.when(turned, F.col("h")).otherwise(F.col("w")), F.when(turned, F.col("w")).otherwise(F.col("h"))
    j = j.withColumn("width", w).withColumn("height", h).withColumn("status", X.status(F.coalesce(F.col("h") > 0, F.lit(False)), F.col("format"), F.col("mode"), F.col("width"), F.col("height"), support))
    for c, n in (("crop_origin_x", "width"), ("crop_origin_y", "height")):
        j = j.withColumn(c, F.when(F.col("status") == "ACCEPTED", X.residue_start(F.col(n), crop, residue)))

    @F.pandas_udf("binary")
    def patch(data, h, w, n, o, x, y):
        out = []
        for d, hh, ww, nn, oo, xx, yy in zip(data, h, w, n, o, x, y, strict=True):
            if d is None or pd.isna(xx) or pd.isna(yy):
                out.append(None)
                continue
            a = np.frombuffer(d, np.uint8).reshape(int(hh), int(ww), int(nn))
            rgb = a[..., 2::-1].astype(np.int32)
            if nn == 4:
                alpha = a[..., 3:].astype(np.int32)
                rgb = (alpha * rgb + (255 - alpha) * 128 + 127) // 255
            rgb = ORIENTATIONS[int(oo)](rgb)[int(yy) : int(yy) + crop, int(xx) : int(xx) + crop]
            out.append(rgb.astype(np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    good = F.when(F.col("status") == "ACCEPTED", F.col("data"))
    p = patch(good, "h", "w", "n", F.coalesce("orientation", F.lit(1)), "crop_origin_x", "crop_origin_y")
    return j.select("path", "status", "format", "mode", "width", "height", F.least("width", "height").alias("support"), "orientation", "crop_origin_x", "crop_origin_y", p.alias("patch"))


def decoded(spark: SparkSession, content: bytes) -> np.ndarray | None:
    """The pixels of one image in memory as red, green, blue (and alpha), by the reader of Spark's image source; None if it can't be read.

    For serving: tables of images are decoded where they are read.
    """
    reader = getattr(getattr(spark._jvm.org.apache.spark.ml.image, "ImageSchema$"), "MODULE$")
    row = reader.decode("", bytearray(content))
    if row.isEmpty():
        return None
    r = row.get().getStruct(0)
    h, w, n = r.getInt(1), r.getInt(2), r.getInt(3)
    a = np.frombuffer(bytes(r.getAs(5)), np.uint8).reshape(h, w, n)
    return a[..., ::-1] if n == 3 else np.concatenate([a[..., 2::-1], a[..., 3:]], axis=-1) if n == 4 else a


def canonical(a: np.ndarray, orientation: int = 1, crop: int = 248, residue: int = 4, support: int = 252) -> np.ndarray:
    """The canonical patch of decoded pixels: alpha over grey, upright, cropped on the grid; an error where they are too small."""
    from tessera.operators.kernels import ORIENTATIONS

    if a.ndim != 3 or a.shape[2] not in (3, 4):
        raise ValueError("UNSUPPORTED_INPUT")
    if min(a.shape[:2]) < support:
        raise ValueError("LOW_SUPPORT")
    rgb = a[..., :3].astype(np.int32)
    if a.shape[2] == 4:
        alpha = a[..., 3:].astype(np.int32)
        rgb = (alpha * rgb + (255 - alpha) * 128 + 127) // 255
    rgb = ORIENTATIONS[orientation](rgb)
    starts = []
    for n in rgb.shape[:2]:
        some = range(residue, n - crop + 1, 8)
        starts.append(min(some, key=lambda s: (abs(s - (n - crop) / 2), s)))
    y, x = starts
    return rgb[y : y + crop, x : x + crop].astype(np.uint8)


def read_csv(spark: SparkSession, path: str, schema: str, decimal_comma: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, byte-order mark or not; listed columns have a decimal comma."""
    d = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    d = d.toDF(*[c.lstrip("﻿") for c in d.columns])
    cols = [x.strip().split() for x in schema.split(",")]
    value = lambda n, t: F.expr(f"try_cast({'replace(' + n + ', char(44), char(46))' if n in (decimal_comma or []) else n} as {t})").alias(n)
    return d.select(*[value(n, t) for n, t in cols])
