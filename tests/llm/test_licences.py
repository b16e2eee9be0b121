from pyspark.sql import functions as F

from tessera.llm import licences as li


def test_scan(spark):
    mit = "Copyright (c) 2019 Somebody\n\n" + li.MIT_TEXT
    rows = [
        (1, mit), (2, mit.upper().replace("COPYRIGHT HOLDERS", "copyright holders").replace("SUBLICENSE", "sub-licence")), (3, li.ISC_TEXT.replace("\n", "   ")), (4, li.MIT_TEXT + " And more."),
        (5, "Some prose.\nReleased under the MIT Licence\nmore\n  LICENSED UNDER CC BY NC 4.0 "), (6, None), (7, ""), (8, "© 2020 me\nAll rights reserved."), (9, "Released under the MIT License."),
        (9, "Released under the MIT License."), (None, "The licence of prose\n" * 500), (11, "MIT License\n(c) x\n" + li.MIT_TEXT),
    ]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, licence string")
    got = {(r["doc_id"], r["licence"], r["notices"], r["n_notices"]) for r in li.scan(df).collect()}
    assert li.scan(df).count() == len(rows)
    assert got == {
        (1, "MIT", "", 0), (2, "MIT", "", 0), (3, "ISC", "", 0), (4, None, "", 0), (5, None, "CC-BY-NC-4.0,MIT", 2), (6, None, "", 0), (7, None, "", 0), (8, None, "", 0), (9, "MIT", "MIT", 1),
        (None, None, "", 0), (11, "MIT", "", 0),
    }
    assert li.scan(df.limit(0)).count() == 0


def test_native(spark):
    plan = li.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_canonical_spellings(spark):
    df = spark.createDataFrame([("The  LICENCE, of an Organisation!",)], "t string")
    assert df.select(li.canonical(F.col("t"))).first()[0] == "the license of an organization"


def test_table_of_licences(spark):
    shipped = "/usr/share/common-licenses"
    rows = [(k, open(f"{shipped}/{f}", encoding="utf-8").read()) for k, f in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0-only", "GPL-2"), ("GPL-3.0-only", "GPL-3"), ("LGPL-2.1-only", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD-3-Clause", "BSD"))]
    apache = rows[0][1]
    rows += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Somebody")), ("Apache-2.0", apache[: apache.index("APPENDIX")]), (None, apache + " And more.")]
    lines = [("MIT", "// SPDX-License-Identifier: MIT"), ("GPL-2.0-or-later", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License");'), ("GPL", " * it under the terms of the GNU General Public License as published by"), ("", "The licence of prose")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)] + [(100 + i, f"Prose.\n{t}\nmore") for i, (_, t) in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in li.scan(df).collect()}
    assert [got[i]["licence"] for i in range(len(rows))] == [k for k, _ in rows]
    assert [got[100 + i]["notices"] for i in range(len(lines))] == [k for k, _ in lines]


def test_no_form_has_two_licences(spark):
    for table in (li.TEXTS + li.NOTICES, li.NOTICES):
        df = spark.createDataFrame(table, "licence string, t string")
        assert df.groupBy(li.digest(F.col("t"))).agg(F.collect_set("licence").alias("x")).filter(F.size("x") > 1).collect() == []


def test_a_table_of_ones_own(spark):
    df = spark.createDataFrame([(1, "Our Licence: do as you like."), (2, "MIT License\n" + li.MIT_TEXT), (3, "prose\nOURS license 2\nours LICENCE 2!")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["notices"], r["n_notices"]) for r in li.scan(df, texts=[("Ours", "our license do as you LIKE")], notices=[("Ours-2", "Ours licence 2")]).collect()}
    assert got == {1: ("Ours", "", 0), 2: (None, "", 0), 3: (None, "Ours-2", 2)}
    assert {r["licence"] for r in li.scan(df, texts=[], notices=[]).collect()} == {None}


def test_no_row_is_shuffled(spark):
    plan = li.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan
