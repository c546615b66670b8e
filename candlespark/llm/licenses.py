"""License scans: MinHash of overlapping text windows retrieves templates, exact shingle containment decides.

Texts are lower-cased and cut into words of letters and digits; shingles are five words.

* Short templates (under ``LONG`` shingles) are retrieved by windows of one shingle at every
  word; the MinHash of a window is its shingle's hash, so a contained shingle collides always.
* Long templates are retrieved by windows of ``WINDOW`` (4) shingles that begin at every second
  word, with ``BANDS`` bands of one row. The index has the signature of every window of a
  template, at every word. A text that holds 0.8 of a template's m >= 8 shingles has, for every
  pattern of changed words, an unbroken run of five shingles: a changed word costs five
  shingles, so at most 0.04 m words changed, and the longest run has at least
  0.8 m / (0.04 m + 1) >= 4.8 shingles. Such a run holds a whole window, which equals a template
  window and collides in every band with probability one.

All of it is built-in DataFrame functions; a document is one row throughout, and nothing is
shuffled. The templates are a small table in this file, so their broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW, STRIDE = 4, 2
LONG = 8
THRESHOLD = 0.8
#: One XOR mask for each band; min(hash XOR mask) is the band's MinHash.
BANDS = (0, 0x5DEECE66D1234567)

# The wording of public license notices.
TEMPLATES = {
    "apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "mit/line": "Released under the MIT License.",
    "gpl-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0/line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0/warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit/condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd/warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "isc/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl/grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl/warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense/grant": "This is free and unencumbered software released into the public domain.",
}


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def _positions(n: Column, step: int = 1) -> Column:
    """0, step, 2 step, ... below n; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    """Hash of the shingle at every word."""
    return F.transform(_positions(F.size(words) - (SHINGLE - 1)), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))


def _signatures(hashes: Column, mask: int, step: int) -> Column:
    """A band's MinHash of the window at every ``step``-th shingle; the last windows may be shorter."""
    starts = _positions(F.size(hashes) - (WINDOW - 1) + (step - 1), step)
    return F.transform(starts, lambda i: F.least(*(F.get(hashes, i + k).bitwiseXOR(F.lit(mask)) for k in range(WINDOW))))


def _template_index(spark: SparkSession, templates: dict[str, str]) -> tuple[list[tuple[str, list[str], list[int]]], list[int], list[list[int]]]:
    """(template, its distinct shingles, its keys), keys of short templates, keys of long ones by band.

    Computed by the same expressions as for texts, over the few rows of the template table.
    """
    table = spark.createDataFrame(list(templates.items()), "template string, text string").withColumn("words", _words(F.col("text")))
    table = table.withColumn("words", F.filter("words", lambda w: w != "")).withColumn("h", _hashes(F.col("words")))
    shingles = F.array_distinct(F.transform(_positions(F.size("words") - (SHINGLE - 1)), lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " ")))
    rows = table.select("template", shingles.alias("s"), "h", *(_signatures(F.col("h"), m, 1).alias(f"b{k}") for k, m in enumerate(BANDS))).collect()
    entries, short, long = [], [], [[] for _ in BANDS]
    for r in rows:
        if not r["s"]:
            raise ValueError(f"template {r['template']} has fewer than {SHINGLE} words")
        if len(r["h"]) < LONG:
            keys = list(r["h"])
            short += keys
        else:
            keys = [x for k in range(len(BANDS)) for x in r[f"b{k}"]]
            for k in range(len(BANDS)):
                long[k] += r[f"b{k}"]
        entries.append((r["template"], list(r["s"]), keys))
    return entries, short, long


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and template it contains: id, license, n_shared, n_shingles, containment.

    Containment is the share of the template's distinct shingles that the whole text has; rows
    below ``threshold`` are not reported. Null and empty texts, and texts under five words, give
    no row. Repeated rows each give theirs, as rows are independent. Only two columns are read.
    """
    spark = docs.sparkSession
    entries, short, long = _template_index(spark, TEMPLATES if templates is None else templates)
    none = F.array().cast("array<bigint>")
    pick = lambda column, keys: F.filter(column, lambda x: x.isin(sorted(set(keys)))) if keys else none
    one = docs.select(F.col(id_col), _words(F.col(text)).alias("__words"))
    two = one.select(id_col, "__words", _hashes(F.col("__words")).alias("__h"))
    hits = [pick(F.col("__h"), short)] + [pick(_signatures(F.col("__h"), m, STRIDE), long[k]) for k, m in enumerate(BANDS)]
    three = two.select(id_col, "__words", F.array_distinct(F.concat(*hits)).alias("__keys"))
    table = F.array(*(F.struct(F.lit(k).alias("at"), F.array(*map(F.lit, keys)).alias("keys")) for k, (_, _, keys) in enumerate(entries)))
    found = F.transform(F.filter(table, lambda t: F.arrays_overlap(t["keys"], F.col("__keys"))), lambda t: t["at"])
    # outer: an inner explode would repeat the whole retrieval in an inferred filter below it
    four = three.select(id_col, "__words", F.explode_outer(F.when(F.size("__keys") > 0, found)).alias("at")).where("at IS NOT NULL")
    names = spark.createDataFrame([(k, name, s) for k, (name, s, _) in enumerate(entries)], "at int, license string, s array<string>")
    own = F.transform(_positions(F.size("__words") - (SHINGLE - 1)), lambda i: F.array_join(F.slice("__words", i + 1, SHINGLE), " "))
    checked = four.join(F.broadcast(names), "at").select(id_col, "license", F.size(F.array_intersect("s", own)).cast("long").alias("n_shared"), F.size("s").cast("long").alias("n_shingles"))
    return checked.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold)


def oracle(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for the same rows by brute force: every template against every whole text."""
    rows = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items())
    words = r"string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+')"
    return f"""
        WITH t AS (SELECT license, list_filter({words.format("body")}, lambda w: w <> '') AS w FROM (VALUES {rows}) v(license, body)),
        s AS (SELECT DISTINCT license, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS shingle FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM t)),
        d AS (SELECT doc_id, row_number() OVER () AS r, {words.format("text")} AS w FROM documents),
        x AS (SELECT DISTINCT doc_id, r, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS shingle FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)),
        n AS (SELECT license, count(*) AS n_shingles FROM s GROUP BY license)
        SELECT doc_id, license, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles)::DOUBLE AS containment
        FROM x JOIN s USING (shingle) JOIN n USING (license)
        GROUP BY doc_id, r, license HAVING count(*) >= {THRESHOLD} * any_value(n_shingles)
    """
