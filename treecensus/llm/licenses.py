"""Operator 2, license scans: MinHash bands over overlapping windows retrieve templates, containment verifies.

Texts and templates are sequences of lower-case words, compared by five-word shingles.  For each
template length class L (a power of two of shingles) a text has windows of 2 L shingles, one every
L, so that an occurrence of up to L shingles lies whole in one of them.  A window and a template
of its class whose contained share is ``LEAST`` or more have a Jaccard similarity of at least
0.75 * L / 2 / (2 L) = 0.18; with bands of one minimum and 64 of them they share a band with
probability 1 - (1 - 0.18) ** 64, or 0.999997.  Retrieved pairs are confirmed on all shingles.

A window without any shingle of a template has similarity 0 with it.  So only windows that hold
at least one template shingle are hashed; a table of a fixed size, asked at two places for each
shingle, finds them inside each row (a chance hit costs a window, never a match).  Everything is column expressions; the only joins are with the
templates, a fixed list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIZE, LEAST, BANDS, CELLS = 5, 0.75, 64, 1 << 20
WORD = "[a-z0-9]+"

# Public license notices, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of "
                         "the GNU General Public License as published by the Free Software Foundation, either version 3 "
                         "of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: Redistributions of source code must retain the "
                     "above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingles_of(words: str) -> Column:
    """A hash of every five words in a row of a column (not an expression: it is read at every place)."""
    last = F.size(words) - SIZE
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SIZE)))
    )).otherwise(F.array().cast("array<bigint>"))


def minima_of(shingles: Column) -> Column:
    """One minimum for each band, of hashes that differ by the band's number."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)),
                       lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))))


def length_class(n: int) -> int:
    size = 1
    while size < n:
        size *= 2
    return size


def templates(spark: SparkSession, known: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """template, license, class, own (distinct shingles). Templates need at least five words."""
    rows = [(i, name, text, length_class(len(re.findall(WORD, text.lower())) - SIZE + 1)) for i, (name, text) in enumerate(known)]
    if any(len(re.findall(WORD, r[2].lower())) < SIZE for r in rows):
        raise ValueError("a template needs at least five words")
    frame = spark.createDataFrame(rows, "template int, license string, text string, class int")
    words = frame.select("template", "license", "class", words_of(F.col("text")).alias("words"))
    return words.select("template", "license", "class", F.array_distinct(shingles_of("words")).alias("own"))


def _windows(hits: Column, size: int) -> Column:
    """The windows of a length class that hold one of the places: (class, at)."""
    around = F.transform(hits, lambda p: F.array(
        F.floor(p / size) * size, F.greatest(F.floor(p / size) * size - size, F.lit(0))))
    return F.transform(F.array_distinct(F.flatten(around)),
                       lambda a: F.struct(F.lit(size).alias("class"), a.cast("int").alias("at")))


def scan(documents: DataFrame, known: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license, template, place (first word of the first such window), share: one row per match.

    ``share`` is the largest part of the template's shingles found in a window of the document.
    Null and short texts match nothing; repeated rows give repeated matches.  A document with
    several licenses has a row for each template found.
    """
    spark = documents.sparkSession
    table = templates(spark, known).collect()  # a fixed list
    hashes = sorted({h for r in table for h in r.own})
    cells = bytearray(CELLS)
    for h in hashes:
        cells[h % CELLS] |= 1
        cells[(h >> 24) % CELLS] |= 2
    marked = F.lit(bytes(cells))
    here = lambda h, kinds: F.substring(marked, F.pmod(h, F.lit(CELLS)).cast("int") + 1, F.lit(1)).isin(kinds)
    held = F.broadcast(spark.createDataFrame(
        [(r.template, r.license, r["class"], r.own) for r in table], "template int, license string, class int, own array<bigint>"))

    # the row number comes last: no filter or generator is pushed below it, where it would read ``all`` anew at each place
    rows = (documents.select("doc_id", words_of(F.col("text")).alias("words"))
            .select("doc_id", shingles_of("words").alias("all"))
            .select("doc_id", "all", F.monotonically_increasing_id().alias("row")))
    hit = lambda i: here(F.get("all", i), [b"\1", b"\3"]) & here(F.shiftright(F.get("all", i), 24), [b"\2", b"\3"])
    rows = rows.withColumn("hits", F.when(F.size("all") > 0, F.filter(F.sequence(F.lit(0), F.size("all") - 1), hit))
                           .otherwise(F.array().cast("array<int>")))
    sizes = sorted({r["class"] for r in table})
    starts = F.flatten(F.array(*(_windows(F.col("hits"), size) for size in sizes)))
    windows = (rows.select("doc_id", "row", "all", F.explode(starts).alias("w"))
               .select("doc_id", "row", F.col("w.class").alias("class"), F.col("w.at").alias("at"),
                       F.slice("all", F.col("w.at") + 1, 2 * F.col("w.class")).alias("part")))
    signed = windows.withColumn("signature", minima_of(F.col("part")))
    marks = held.withColumn("own_signature", minima_of(F.col("own")))
    agree = F.exists(F.zip_with("signature", "own_signature", lambda a, b: a == b), lambda same: same)
    found = (signed.join(F.broadcast(marks), "class").where(agree)
             .withColumn("share", F.size(F.array_intersect("own", "part")) / F.size("own")).where(F.col("share") >= LEAST))
    return (found.groupBy("row", "template").agg(
        F.first("doc_id").alias("doc_id"), F.first("license").alias("license"), F.min("at").alias("place"),
        F.max("share").alias("share")).select("doc_id", "license", "template", "place", "share"))
