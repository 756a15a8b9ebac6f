"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, text_of

#: Words of a shingle, shingles of a window (so neighbouring windows share four words), bands of one minimum each.
#: A window of six words with one of its two shingles from a template misses it with probability 2 ** -10; a notice
#: of six words or more fills some window or meets several, and a window that it fills is always retrieved. A template
#: of one shingle is looked up by that shingle itself, as band ALONE, and never missed.
SHINGLE, WINDOW, BANDS = 5, 2, 10
ALONE = -1
MIN_CONTAINMENT = 0.8
#: The template table is sent to all tasks; a larger one is refused.
MAX_TEMPLATE_WORDS = 50_000
TOKEN = r"[\p{L}\p{N}]+"

#: Public licence notices and texts (fixed values), each of at least five words.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}


def shingles(text: Column) -> tuple[Column, Column]:
    """The words of a text, and a column over `words` with the hash of every five in a row, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    five = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(SHINGLE)])
    hashes = F.when(F.size("words") >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), five)).otherwise(F.array().cast("array<bigint>"))
    return words, hashes


def band(b: int, shingle: Column) -> Column:
    return F.xxhash64(shingle, F.lit(b))


def window(start: Column) -> list[Column]:
    """The shingles of the window that begins at shingle `start`; the last window of a text may repeat its first."""
    first = F.get("h", start)
    return [first, *(F.coalesce(F.get("h", start + k), first) for k in range(1, WINDOW))]


def gives_minimum(shingle: Column, start: Column) -> Column:
    """Whether the shingle gives the minimum of some band of its window."""
    return _any([band(b, shingle) == F.least(*[band(b, s) for s in window(start)]) for b in range(BANDS)])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, t, t_size): each template's distinct shingles, worked out once, so that no plan over it parses texts again."""
    words, hashes = shingles(F.col("text"))
    rows = spark.createDataFrame(sorted(templates.items()), "template string, text string").withColumn("words", words)
    told = rows.select("template", F.array_distinct(hashes).alias("t")).collect()  # at most MAX_TEMPLATE_WORDS numbers
    return spark.createDataFrame([(r.template, r.t, len(r.t)) for r in told], "template string, t array<bigint>, t_size int")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_containment: float = MIN_CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs` and template found in its whole text: doc_id, template, containment, first_word.

    Words are lower-cased runs of letters and digits. Windows lie on a fixed grid; those with a band minimum that some
    template's shingles can give are candidates. A candidate is kept when at least `min_containment` of the template's
    distinct shingles occur around it, within one template's length on either side; first_word is where the earliest
    such window starts. Null, empty or short texts and empty tables give no rows. Rows that repeat an id are reported
    as one. Only the two named columns are read. Candidates alone are exploded and grouped; no text is shuffled.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    if sum(len(x.split()) for x in templates.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"the templates hold more than {MAX_TEMPLATE_WORDS} words")
    table = template_table(spark, templates)
    # A minimum tells its shingle, so a template is indexed by its shingles; the
    # templates' sets are sent once each. Both tables grow with the words of the templates, which are bounded above.
    index = table.select("template", "t_size", F.explode("t").alias("s"))
    known = index.groupBy("s").agg(F.min("t_size").alias("least")).collect()  # at most MAX_TEMPLATE_WORDS numbers
    any_of, alone = [r.s for r in known], [r.s for r in known if r.least == 1]
    reach = table.agg(F.max("t_size")).first()[0] or 0

    words, hashes = shingles(text_of(text_col))
    hashed = docs.select(quoted(id_col).alias("doc_id"), words.alias("words")).select("doc_id", hashes.alias("h"))
    among = lambda s, numbers: s.isin(numbers) if numbers else F.lit(False)
    may_hit = lambda i: _any([among(s, any_of) & (among(s, alone) | gives_minimum(s, i)) for s in window(i)])
    grid = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(WINDOW))).otherwise(F.array().cast("array<int>"))
    hits = hashed.withColumn("at", F.explode(F.filter(grid, may_hit)))
    start = F.greatest(F.col("at") - reach, F.lit(0))
    keys = F.array_distinct(F.array(*[F.struct(s.alias("s"), gives_minimum(s, F.col("at")).alias("won")) for s in window(F.col("at"))]))
    near = hits.select("doc_id", "at", F.slice("h", start + 1, F.lit(2 * reach + WINDOW)).alias("near"), (F.col("at") - start).alias("offset"), F.explode(keys).alias("k"))
    met = near.join(F.broadcast(index), F.col("k.s") == index.s).where(F.col("k.won") | (F.col("t_size") == 1))
    pairs = met.select("doc_id", "at", "near", "offset", "template", "t_size").join(F.broadcast(table.select("template", "t")), "template")
    low = F.greatest(F.col("offset") - F.col("t_size"), F.lit(0))
    around = F.slice("near", low + 1, F.col("offset") - low + F.col("t_size") + WINDOW)
    share = F.size(F.array_intersect("t", around)) / F.col("t_size")
    checked = pairs.select("doc_id", "template", "at", share.alias("containment")).where(F.col("containment") >= min_containment)
    return checked.groupBy("doc_id", "template").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
