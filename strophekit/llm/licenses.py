"""Operator 6: license scans with Spark expressions only.

Texts and license templates are read as lower-case words of letters and digits.
Overlapping windows of 6 words, two words apart, are compared by MinHash over their
word pairs: the least pair hash under each of 6 permutations (bands of one row). A
template has a window at every place, so a passage of 7 words or more holds a
whole window of its template, and even the shortest template, 5 words, fills 4 of the 5
pairs of some window: it is retrieved with probability 1 - 0.2^6 = 0.99994 at least.
A retrieved template counts as present when the text holds at least 80 % of its
distinct shingles of five words, by their exact hashes.

Everything happens inside the row: no join, no shuffle, nothing is dropped.
Templates are an argument of the program and so of bounded size; they are literals: one map
per permutation, one list of shingles.

Notices of fewer than five words (``brief``) have their whole word run as only shingle and
are searched at every place, so none is missed.  Among ``templates`` they are refused.

Null or empty text: no license.  Repeated rows and null ids give a row each; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophekit.llm.common import let

WINDOW, STRIDE = 6, 2
SHINGLE = 5
CONTAINMENT = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"
# One seed per permutation: a pair's hash is hashed anew with it, so that the orders are independent.
PERMUTATIONS = (1, 2, 3, 4, 5, 6)

FOUND = "array<struct<name: string, containment: double>>"

# Notices by name.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "bsd-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer.""",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    "mit-notice": "Released under the MIT License.",
    "mit-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
}

# Notices of fewer than five words.
BRIEF_TEMPLATES = {"all-rights-reserved": "All rights reserved."}


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def runs(hashes: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words."""
    return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (size - 1), F.lit(0))),
                       lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, size)]))


def window_minima(pairs: Column, permutation: int, stride: int) -> Column:
    """The least pair hash of each window under one permutation."""
    def minima(permuted: Column) -> Column:
        n = F.size(permuted)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_min(F.slice(permuted, s, WINDOW - 1)))

    return let(F.transform(pairs, lambda x: F.xxhash64(x, F.lit(permutation))), minima)


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Per template its shingles, and its windows' minima under each permutation."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")

    def described(hashes: Column) -> Column:
        pairs = runs(hashes, 2)
        full = F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(1))  # windows that are not cut off at the end
        minima = [F.array_distinct(F.slice(window_minima(pairs, p, 1), F.lit(1), full)).alias(f"m{i}") for i, p in enumerate(PERMUTATIONS)]
        return F.struct(F.array_distinct(runs(hashes, SHINGLE)).alias("shingles"), *minima)

    rows = rows.select("name", let(word_hashes(F.col("text")), described).alias("d")).select("name", "d.*")
    out = [r.asDict() for r in rows.collect()]
    for r in out:
        if not r["shingles"]:
            raise ValueError(f"template {r['name']} has fewer than {SHINGLE} words")
    return out


def brief_runs(spark: SparkSession, templates: dict[str, str]) -> dict[str, list[int]]:
    """The word hashes of each brief notice."""
    if not templates:
        return {}
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    out = {r["name"]: r["run"] for r in rows.select("name", word_hashes(F.col("text")).alias("run")).collect()}
    for name, run in out.items():
        if not 0 < len(run) < SHINGLE:
            raise ValueError(f"brief notice {name} has {len(run)} words")
    return out


def holds_run(hashes: Column, run: list[int]) -> Column:
    """Whether the words ``run`` stand next to each other in a text."""
    there = F.lit(True)
    for v in run:
        there = there & F.array_contains(hashes, F.lit(v))

    def starts(h: Column, i: Column) -> Column:
        here = h == F.lit(run[0])
        for k, v in enumerate(run[1:], 1):
            here = here & F.coalesce(F.get(hashes, i + k) == F.lit(v), F.lit(False))
        return here

    return there & (F.size(F.filter(hashes, starts)) > 0)


def with_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", column: str = "licenses",
                  brief: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``column``: names and containments of the templates and
    ``brief`` notices present, ascending by name."""
    known = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    short = brief_runs(docs.sparkSession, brief or {})
    wanted = [sorted({v for t in known for v in t[f"m{i}"]}) for i in range(len(PERMUTATIONS))]

    names, shingles_of = F.lit([t["name"] for t in known]), F.lit([t["shingles"] for t in known])
    # per permutation one literal map from a minimum to the numbers of the templates that have it
    holders = [{v: [k for k, t in enumerate(known) if v in held[k]] for v in wanted[i]}
               for i in range(len(PERMUTATIONS)) for held in [[set(t[f"m{i}"]) for t in known]]]
    maps = [F.map_from_arrays(F.lit(list(h)), F.lit(list(h.values()))) if h else None for h in holders]

    def hits(pairs: Column) -> Column:
        """Per permutation the window minima that some template has too."""
        def one(i: int, p: int) -> Column:
            return F.filter(window_minima(pairs, p, STRIDE), lambda m: m.isin(wanted[i]))
        return F.array(*[one(i, p) for i, p in enumerate(PERMUTATIONS)])

    def matches(hashes: Column) -> Column:
        long = let(let(runs(hashes, 2), hits), lambda found: F.when(
            F.exists(found, lambda h: F.size(h) > 0), verified(hashes, found)).otherwise(F.array().cast(FOUND))) if known else F.array().cast(FOUND)
        if not short:
            return long
        cells = [F.when(holds_run(hashes, run), F.struct(F.lit(name).alias("name"), F.lit(1.0).alias("containment")))
                 for name, run in sorted(short.items())]
        return F.array_sort(F.concat(long, F.filter(F.array(*cells), lambda m: m.isNotNull()).cast(FOUND)))

    def verified(hashes: Column, found: Column) -> Column:
        retrieved = F.array_sort(F.array_distinct(F.flatten(F.array(*[
            F.flatten(F.transform(F.get(found, F.lit(i)), lambda m: F.try_element_at(maps[i], m))) for i in range(len(PERMUTATIONS))]))))

        def present(shingles: Column) -> Column:
            def cell(k: Column) -> Column:
                own = F.get(shingles_of, k)
                return F.struct(F.get(names, k).alias("name"), (F.size(F.array_intersect(shingles, own)) / F.size(own)).alias("containment"))
            return F.filter(F.transform(retrieved, cell), lambda m: m["containment"] >= CONTAINMENT)

        return let(F.array_distinct(runs(hashes, SHINGLE)), present)

    return docs.withColumn(column, let(word_hashes(F.col(f"`{text}`")), matches))
