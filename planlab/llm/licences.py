"""Licence scan by canonical digest (operator 6), in DataFrame expressions only.

A text is normalised (case, equivalent spellings, copyright lines, punctuation, white space) and its
digest is hash-joined with the digests of known licence texts. A whole document may be a licence, and so may
each of its lines: a line is a text of its own, as licence notices in files are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planlab.llm.common import broadcast_rows, table
from planlab.llm.licence_texts import TEXTS
from planlab.session import checkpointed

# Public licence notices and entire texts of short licences, and spellings read as equal.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("All-rights-reserved", "All rights reserved."),
    *TEXTS,
)
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("&", " and "), ("https:", "http:"), ("©", "(c)"))


def canonical(text: Column) -> Column:
    """Normalised text: lower case, one spelling, no copyright lines, letters and digits with single spaces."""
    text = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for other, one in SPELLINGS:
        text = F.replace(text, F.lit(other), F.lit(one))
    text = F.regexp_replace(text, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b(?=[^\n]*(?:\d{4}|\(c\)))|\(c\)\s)[^\n]*$", " ")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, which is computed once; null where nothing is left of it."""
    return F.transform(F.array(canonical(text)), lambda plain: F.when(plain != "", F.sha2(plain, 256)))[0]


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, licence, line_licences`` of every row of ``docs``.

    ``known`` has ``licence`` and ``text``. ``licence`` is that of the whole text (null: none; of several with one
    digest the least); ``line_licences`` are the distinct licences of its lines, sorted. Null and empty
    texts have none. A repeated row, or one without doc_id, is scanned as any other.
    """
    table_ = known.select("licence", digest(F.col("text")).alias("d")).where("d IS NOT NULL AND licence IS NOT NULL")
    table_ = checkpointed(table_.groupBy("d").agg(F.min("licence").alias("licence")))
    lookup = broadcast_rows(table_)
    # a row is known by what it holds; rows that agree share the lines found
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("t"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    lines = rows.select("t", F.explode_outer(lines).alias("line")).where("line IS NOT NULL")
    met = lines.select("t", digest(F.col("line")).alias("d")).join(lookup, "d")
    per = met.groupBy("t").agg(F.array_sort(F.collect_set("licence")).alias("line_licences"))
    whole = rows.select("doc_id", "t", digest(F.col("text")).alias("d"))
    out = whole.join(lookup, "d", "left").join(per, "t", "left")
    return out.select("doc_id", "licence", F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences"))


def op6_licence_scan(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    found = scan(docs, spark.createDataFrame(list(KNOWN), "licence string, text string"))
    return found.withColumn("line_licences", F.array_join("line_licences", " "))
