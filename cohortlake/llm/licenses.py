"""License scans: which license notices a document carries.

Documents are cut into overlapping windows of WINDOW five-word shingles, one every shingle. Each
window has BANDS MinHash values, each a band of its own: with bands of one row, a window and a
template window of Jaccard similarity s collide with probability 1 - (1 - s) ** BANDS. A notice
of a single shingle is half of a window, which collides with 0.992, and lies in two windows; a
longer notice that is kept whole in any two shingles on end has a window like its template's and
collides for certain. A notice of fewer words than five is one shingle of its own number of words;
it is looked up by its hash among all shingles of so many words, so it is found for certain
wherever it stands. Templates whose bands or hash collide are verified by the exact share of their
shingles, as words, that the document has. Only DataFrame functions run. Nothing but the matches
is shuffled; the templates are constants of the plan.

Words are those between white space, in lower case. A text of more than SLICE characters is worked
on in slices that overlap, and what they have of a notice is put together. Cases: null and empty
texts carry none; a text of fewer words than five is one shingle beside long notices; a notice is
reported once for a doc_id, however often its text or its repeated rows have it, and texts of one
doc_id are each looked at by themselves; extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW = 2
BANDS = 7
CONTAINMENT = 0.8
SLICE, OVERLAP = 1 << 20, 1 << 12
"""Characters of a slice, and how far it reaches into the next; five words of a notice are shorter than that."""

# The wording of public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "All rights reserved"),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def sliced(docs: DataFrame, size: int = SLICE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, __id (hash of the text), __w: the words of each slice, without those that its ends may cut."""
    text = F.coalesce(F.col("text"), F.lit(""))
    last = F.floor(F.greatest(F.char_length("__text") - 1, F.lit(0)) / size).cast("int")
    one = F.array(F.struct(F.col("__text").alias("text"), F.lit(False).alias("begun"), F.lit(False).alias("goes_on")))
    many = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.substring(F.col("__text"), i * size + 1, F.lit(size + overlap)).alias("text"), (i > 0).alias("begun"), (i < last).alias("goes_on")))
    cut = docs.select("doc_id", text.alias("__text"), F.xxhash64(text).alias("__id")).select("doc_id", "__id", F.explode(F.when(F.char_length("__text") <= size, one).otherwise(many)).alias("__s"))
    w = words(F.col("__s.text"))
    whole = cut.select("doc_id", "__id", "__s.begun", "__s.goes_on", w.alias("__w"))
    kept = F.slice("__w", F.col("begun").cast("int") + 1, F.greatest(F.size("__w") - F.col("begun").cast("int") - F.col("goes_on").cast("int"), F.lit(0)))
    return whole.select("doc_id", "__id", F.when(F.col("begun") | F.col("goes_on"), kept).otherwise(F.col("__w")).alias("__w"))


def short_widths(notices: tuple[tuple[str, str], ...]) -> list[int]:
    """The numbers of words of the notices that have fewer than SHINGLE."""
    return sorted({n for _, text in notices if 0 < (n := len(re.findall("[^\\x20\\x09-\\x0D]+", text))) < SHINGLE})


def hashed(df: DataFrame, widths: list[int]) -> DataFrame:
    """df with __h, hashes of the shingles of __w in order, and for each n of widths __n{n}, those of its n-word shingles.

    What a lambda refers to is computed for each element anew, so each step is a column of its own.
    """
    each = df.withColumn("__e", F.transform("__w", lambda w: F.xxhash64(w)))
    none = F.array().cast("array<bigint>")
    whole = lambda n: F.transform(F.sequence(F.lit(0), F.size("__e") - n), lambda i: F.xxhash64(*[F.get("__e", i + j) for j in range(n)]))
    short = F.when(F.size("__e") > 0, F.array(F.xxhash64(F.concat_ws(" ", "__w")))).otherwise(none)
    narrow = {f"__n{n}": F.when(F.size("__e") >= n, whole(n)).otherwise(none) for n in widths}
    return each.withColumns({"__h": F.when(F.size("__e") >= SHINGLE, whole(SHINGLE)).otherwise(short)} | narrow).drop("__e")


def shingles(words: Column, width: Column) -> Column:
    """The shingles of width words, as words."""
    whole = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.array_distinct(F.when(F.size(words) >= width, whole).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")))


def banded(df: DataFrame, seeds: list[int]) -> tuple[DataFrame, list[Column]]:
    """df, and for each band the least hash of every window of __h under the band's permutation.

    A window at the end that is cut short has fewer shingles.
    """
    df = df.withColumns({f"__v{k}": F.transform("__h", _permuted(s)) for k, s in enumerate(seeds)})
    shifted = lambda v: [v, *[F.slice(v, F.lit(j + 1), F.greatest(F.size(v) - j, F.lit(0))) for j in range(1, WINDOW)]]
    return df, [reduce(lambda x, y: F.zip_with(x, y, lambda a, b: F.least(a, b)), shifted(F.col(f"__v{k}"))) for k in range(len(seeds))]


def _permuted(seed: int) -> Callable[[Column], Column]:
    return lambda h: F.xxhash64(h, F.lit(seed))


def _seeds(spark: SparkSession, bands: int) -> list[int]:
    return [r.s for r in spark.range(bands).select(F.xxhash64("id", F.lit("band")).alias("s")).orderBy("id").collect()]


def templates(spark: SparkSession, seeds: list[int], notices: tuple[tuple[str, str], ...] = TEMPLATES) -> list:
    """Each notice with the width of its shingles, its shingles, band values and, if it is short, hash; as many rows as there are notices."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "\\'")) for i, (name, text) in enumerate(notices))
    w = words(F.col("text"))
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(n, name, text)")
    widths = short_widths(notices)
    rows, bands = banded(hashed(rows.withColumn("__w", w), widths), seeds)
    width = F.when(F.size("__w").isin(widths), F.size("__w")).otherwise(SHINGLE)
    short = reduce(lambda rest, n: F.when(F.size("__w") == n, F.get(f"__n{n}", F.lit(0))).otherwise(rest), widths, F.lit(None).cast("long"))
    return rows.select("n", "name", width.alias("width"), shingles(F.col("__w"), width).alias("shingles"), F.array(*bands).alias("bands"), short.alias("short")).orderBy("n").collect()


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, n_bands: int = BANDS) -> DataFrame:
    """(doc_id, license, notice, shared, notice_shingles) of every notice that a document carries; notice is its number."""
    spark = docs.sparkSession
    seeds = _seeds(spark, n_bands)
    known = templates(spark, seeds, notices)
    longs = lambda values: F.split(F.lit(",".join(map(str, sorted(values)))), ",").cast("array<bigint>")
    keys = lambda t: {v for band in t["bands"] for v in band} if t["short"] is None else {t["short"]}
    table = [{"n": t["n"], "name": t["name"], "width": t["width"], "bands": sorted(keys(t)), "shingles": t["shingles"]} for t in known]
    table = F.from_json(F.lit(json.dumps(table)), "array<struct<n long, name string, width int, bands array<bigint>, shingles array<string>>>")
    widths = short_widths(notices)
    rows, own = banded(hashed(sliced(docs), widths), seeds)
    wanted = [(band, {v for t in known if t["short"] is None for v in t["bands"][k]}) for k, band in enumerate(own)]
    wanted += [(F.col(f"__n{n}"), {t["short"] for t in known if t["short"] is not None and t["width"] == n}) for n in widths]
    hits = F.concat(*[F.array_intersect(band, longs(values)) for band, values in wanted if values])
    rows = rows.select("doc_id", "__id", "__w", hits.alias("__hit"))
    retrieved = F.when(F.size("__hit") > 0, F.filter(table, lambda t: F.arrays_overlap(t["bands"], F.col("__hit"))))
    # outer, so that the planner infers no filter below, which would compute all of this twice
    rows = rows.select("doc_id", "__id", "__w", F.explode_outer(retrieved).alias("__t")).where(F.col("__t").isNotNull())
    found = F.array_intersect(F.col("__t.shingles"), shingles(F.col("__w"), F.col("__t.width")))
    rows = rows.select("doc_id", "__id", F.col("__t.name").alias("license"), F.col("__t.n").alias("notice"), F.size("__t.shingles").cast("long").alias("notice_shingles"), found.alias("__found"))
    # a row for each slice that meets a band; no more shingles than the notice has
    rows = rows.groupBy("doc_id", "__id", "license", "notice", "notice_shingles").agg(F.size(F.array_distinct(F.flatten(F.collect_set("__found")))).cast("long").alias("shared"))
    rows = rows.where(F.col("shared") >= F.lit(containment) * F.col("notice_shingles"))
    return rows.groupBy("doc_id", "license", "notice").agg(F.max("shared").alias("shared"), F.first("notice_shingles").alias("notice_shingles"))
