"""Licence scans by canonical digest.

A text is put into canonical form (case, copyright lines, equivalent spellings, punctuation and white
space) and its SHA-256 is joined by hash with the digests of known licences; every line that could be a licence notice is
looked up among the digests of notices. Everything is DataFrame functions; the table of known digests is a
list of the caller's or the one shipped, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import licence_table

# Equivalent spellings, as in the SPDX matching guidelines.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("fulfilment", "fulfillment"),
    ("https:", "http:"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Notices and texts of licences.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    *licence_table.NOTICES,
]
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
TEXTS = [("MIT", MIT_TEXT), ("MIT", f"MIT License\n\n{MIT_TEXT}"), ("MIT", f"The MIT License (MIT)\n\n{MIT_TEXT}"), ("ISC", ISC_TEXT), ("ISC", f"ISC License\n\n{ISC_TEXT}"), *licence_table.TEXTS]

#: A line that holds none of these, in lower case, is no known notice.
MARKERS = ("licen",)
COPYRIGHT = r"(?m)^[^a-z0-9\n(©]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*$"
RESERVED = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form: words of a-z, 0-9 and other letters, single spaces between them."""
    t = F.lower(text)
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT, " "), RESERVED, " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”–—•·©]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``known_digest`` and ``licence`` of a list of (licence, text), one row per digest."""
    df = spark.createDataFrame(texts, "licence string, t string")
    return df.groupBy(digest(F.col("t")).alias("known_digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, licence (of the whole text, or null), notices (sorted, by comma) and n_notices of every row.

    ``texts`` and ``notices`` are lists of (licence, text), by default the table that is shipped: whole texts
    are joined by digest with both, and every line that holds a word of ``MARKERS`` is looked up among the
    notices where it stands, so no row is shuffled. Both lists are sent to the executors; a notice is one
    line with such a word. Null and empty texts share the digest of the empty form and match nothing; repeated
    rows count each; texts are hashed whole; an empty table gives no rows; further columns are ignored.
    """
    spark, notices = docs.sparkSession, NOTICES if notices is None else notices
    if not all(any(m in n.lower() for m in MARKERS) and "\n" not in n for _, n in notices):
        raise ValueError(f"a notice is one line that holds one of {MARKERS}")
    whole = F.broadcast(known(spark, (TEXTS if texts is None else texts) + notices))
    lines = [F.lit(x) for r in known(spark, notices).collect() for x in (r["known_digest"], r["licence"])]  # a fixed list
    of_line = F.create_map(*lines) if lines else F.create_map().cast("map<string,string>")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    maybe = F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit(MARKERS[0])))
    found = F.array_compact(F.transform(maybe, lambda x: F.try_element_at(of_line, digest(x))))
    d = d.select("doc_id", digest(F.col("text")).alias("digest"), found.alias("found"))
    d = d.join(whole, F.col("digest") == F.col("known_digest"), "left")
    return d.select("doc_id", "digest", "licence", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"), F.size("found").cast("long").alias("n_notices"))


def duckdb_canonical(t: str) -> str:
    """``canonical`` as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(regexp_replace(lower({t}), {q(COPYRIGHT)}, ' ', 'g'), {q(RESERVED)}, ' ', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({t}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F‘’“”–—•·©]+', ' ', 'g'))"
