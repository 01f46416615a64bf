"""License scans (op5): MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

DataFrame expressions only. A window around each guard word is sketched; a guard word is one of a
few words such that no text without any of them can contain a template to the wanted share, so
that other windows need no look.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: Share of a template's shingles, in percent, that a document must have.
CONTAINED = 80
#: Chance, at most, that the bands miss a window that holds a template to that share.
MISS = 1e-4

#: Public licence notices and their usual one-line statements.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_shingles(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def needed(n: int) -> int:
    return -(-CONTAINED * n // 100)


def guard_words(shingles: dict[str, list[str]]) -> list[str]:
    """Few words such that in each template the shingles without any of them are fewer than a match needs."""
    left = {k: [set(x.split()) for x in v] for k, v in shingles.items()}
    out: list[str] = []
    while todo := {k: v for k, v in left.items() if len(v) >= needed(len(shingles[k]))}:
        words = {w for v in todo.values() for s in v for w in s if len(w) > 4}
        best = max(sorted(words), key=lambda w: (sum(any(w in s for s in v) for v in todo.values()), sum(w in s for v in todo.values() for s in v), len(w)))
        out.append(best)
        left = {k: [s for s in v if best not in s] for k, v in left.items()}
    return out


def classes(sizes: dict[str, int]) -> list[tuple[int, int, list[str]]]:
    """(window stride, bands, templates): templates of like size share windows of twice the stride."""
    out, names = [], sorted(sizes, key=lambda k: (sizes[k], k))
    while names:
        low = sizes[names[0]]
        some = [k for k in names if sizes[k] <= 1.6 * low]
        high = sizes[some[-1]]
        alike = 0.8 * low / (2 * high + 0.2 * low)
        out.append((high, math.ceil(math.log(MISS) / math.log(1 - alike)), some))
        names = names[len(some) :]
    return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, template, n_shared, n_shingles, containment): templates that a document contains.

    Words are runs of a-z and 0-9 after lower-casing; a template must have SHINGLE words or more.
    Null, empty and short texts contain nothing; a template that occurs twice comes out once;
    of repeated rows of a doc_id the one that shares most counts; other columns are left out. The table of templates
    is a parameter of bounded size and is sent to all executors.
    """
    spark: SparkSession = docs.sparkSession
    shingles = {k: template_shingles(v) for k, v in templates.items()}
    if short := [k for k, v in shingles.items() if not v]:
        raise ValueError(f"templates of under {SHINGLE} words: {short}")
    guards = guard_words(shingles)
    groups = classes({k: len(v) for k, v in shingles.items()})

    t = docs.where(F.col("text").rlike("(?i)(?<![a-z0-9])(?:" + "|".join(guards) + ")(?![a-z0-9])")).select("doc_id", F.lower("text").alias("text"))
    t = t.withColumn("w", F.filter(F.split("text", "[^a-z0-9]+"), lambda x: x != "")).where(F.size("w") >= SHINGLE)
    last = F.size("w") - SHINGLE  # of the shingles
    t = t.withColumn("s", F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, SHINGLE), " "))))
    known = F.array(*map(F.lit, guards))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(known, F.get("w", i)))
    t = t.withColumn("at", at)
    # a guard word at p stands in shingles p - 4 to p; those start in windows from (p - 4) / stride - 1 on
    place = lambda stride: F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.greatest(F.floor((p - SHINGLE + 1) / stride) - 1, F.lit(0)), F.floor(p / stride)))))
    def cut_out(g: int, stride: int, bands: int):
        return F.transform(place(stride), lambda k: F.struct(F.lit(g).alias("g"), F.lit(bands).alias("bands"), F.slice("s", (k * stride + 1).cast("int"), 2 * stride).alias("x")))

    windows = F.flatten(F.array(*[cut_out(g, stride, bands) for g, (stride, bands, _) in enumerate(groups)]))
    t = t.select("doc_id", "s", F.explode(windows).alias("v")).where(F.size("v.x") > 0)
    band = lambda x, b: F.array_min(F.transform(x, lambda h: F.xxhash64(h, b)))
    t = t.select("doc_id", "s", "v.g", F.explode(F.transform(F.sequence(F.lit(0), F.col("v.bands") - 1), lambda b: F.struct(b.alias("b"), band(F.col("v.x"), b).alias("m")))).alias("k"))

    rows = [(name, g, bands, x) for g, (_, bands, names) in enumerate(groups) for name in names for x in [shingles[name]]]
    known_t = spark.createDataFrame(rows, "template string, g int, bands int, words array<string>")
    known_t = known_t.withColumn("t", F.transform("words", lambda x: F.xxhash64(x)))
    keys = known_t.select("template", "g", "t", F.explode(F.transform(F.sequence(F.lit(0), F.col("bands") - 1), lambda b: F.struct(b.alias("b"), band(F.col("t"), b).alias("m")))).alias("k"))
    hit = t.join(F.broadcast(keys), [t.g == keys.g, t.k.b == keys.k.b, t.k.m == keys.k.m])
    n, shared = F.size("t"), F.size(F.array_intersect("t", "s"))
    found = hit.select("doc_id", "template", shared.cast("long").alias("n_shared"), n.cast("long").alias("n_shingles")).where(100 * F.col("n_shared") >= CONTAINED * F.col("n_shingles"))
    best = found.groupBy("doc_id", "template").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").alias("n_shingles"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def scan_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The same rows by comparing every shingle, in SQL."""
    values = ", ".join(f"('{k}', '{x}')" for k, v in templates.items() for x in template_shingles(v))
    return f"""
WITH t(template, shingle) AS (VALUES {values}),
n AS (SELECT template, count(*) AS n_shingles FROM t GROUP BY template),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE - 2}, 1)), lambda i: array_to_string(w[i:i+{SHINGLE - 1}], ' '))) AS shingle FROM w),
f AS (SELECT doc_id, template, count(*) AS n_shared FROM s JOIN t USING (shingle) GROUP BY doc_id, template)
SELECT doc_id, template, n_shared, n_shingles, n_shared / n_shingles AS containment FROM f JOIN n USING (template) WHERE 100 * n_shared >= {CONTAINED} * n_shingles"""
