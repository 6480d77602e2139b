"""License scans in native expressions: MinHash bands over overlapping text windows, then exact shingle containment.

A text becomes lower-case words (runs of letters and digits) and the hashes of its five-word shingles. Templates are
grouped by their number m of shingles; for each m, windows of ``m + s`` shingles start every ``s = max(1, m // 4)``
shingles, so an occurrence of a template lies whole in some window. Windows and templates get ``BANDS`` MinHash values
of one row each. A window that holds 0.8 of a template's shingles has a Jaccard similarity of at least
``0.8 m / (1.2 m + s)``, over 0.44 for any m, so it shares a band with probability over ``1 - 0.56 ** 16 = 0.9999``;
an exact copy, at 0.5 or more, with over 0.99998. Of windows and templates that meet, those with at least
``CONTAINED`` of the template's shingles in the window are kept: that test is exact.

Before any of this, texts and windows without a *cover word* are passed over. Cover words are chosen so that more than
1 - ``CONTAINED`` of every template's shingles hold one; a text without any can't reach the containment, so nothing
is lost and most texts cost one pattern search.

The template table is a stated set. Its bands and its shingles are joined one after the other, and each is broadcast if
it is measured to hold at most ``BROADCAST_HASHES`` hashes, else joined by shuffle.

Defined results: null texts, and texts or templates of under five words, match nothing; rows with equal ids count as one
document; equal containments are one row, as there is one row for each document and license; repeated rows of the
template table count once; an empty table of either kind gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE, BANDS, CONTAINED = 5, 16, 0.8
#: Tables of at most so many hashes (8 MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_HASHES = 1_000_000

#: Public license notices, as they stand in sources and at the foot of texts.
TEMPLATES = [
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
]

_WORDS = "filter(split(lower({0}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"
_SHINGLES = f"if(size({{0}}) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0, size({{0}}) - {SHINGLE}), i -> xxhash64(array_join(slice({{0}}, i + 1, {SHINGLE}), ' '))))"
_SIGNATURE = f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform({{0}}, h -> xxhash64(h, b))))"


def template_words(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def cover_words(texts: list[str], contained: float = CONTAINED) -> list[str]:
    """A few words, the longest first, of which every template has one in more than 1 - contained of its shingles."""
    left = {}
    for k, text in enumerate(texts):
        found = template_words(text)
        if len(found) >= SHINGLE:
            left[k] = [set(found[i : i + SHINGLE]) for i in range(len(found) - SHINGLE + 1)]
    need = {k: len(s) - contained * len(s) for k, s in left.items()}
    picked: list[str] = []
    while left:
        words = {w for s in left.values() for x in s for w in x} - set(picked)
        best = max(sorted(words), key=lambda w: (min(len(w), 7), sum(any(w in x for x in s) for s in left.values()), len(w)))
        picked.append(best)
        left = {k: s for k, s in left.items() if sum(bool(x & set(picked)) for x in s) <= need[k] + 1e-9}
    return picked


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def templates_in(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """(license_id, text) of a folder of whole license texts, a file each, named by the file; and their cover words.

    For full texts, which are not kept here. Texts of licenses are a stated, small set, so their words come to the driver.
    """
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+?)(\\.txt)?$", 1).alias("license_id"), F.col("value").alias("text"))
    return rows, cover_words(sorted({r["text"] for r in rows.select("text").collect()}))


def scan(docs: DataFrame, known: DataFrame, cover: list[str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """known: license_id, text; cover: :func:`cover_words` of those texts.

    Returns doc_id, license_id, containment, n_windows (windows that hold it), first_word (where the first starts).
    """
    known = known.select("license_id", "text").distinct().select("license_id", F.expr(_WORDS.format("text")).alias("tw"))
    known = known.select("license_id", F.expr(f"array_distinct({_SHINGLES.format('tw')})").alias("tsh"), F.expr(f"greatest(0, size(tw) - {SHINGLE - 1})").alias("m")).where("m > 0")
    known = known.withColumn("tsig", F.expr(_SIGNATURE.format("tsh")))
    known = known.withColumn("tid", F.xxhash64("license_id", "tsh"))
    lengths = {r["m"]: r["n"] for r in known.groupBy("m").agg(F.count("*").alias("n")).collect()}  # a few lengths
    if not lengths:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("bigint").alias("n_windows"), F.lit(0).cast("bigint").alias("first_word")).where("false")
    by_band = known.select("tid", "tsig", F.col("m").alias("tm"), F.posexplode("tsig").alias("tband", "tv"))
    by_id = known.select(F.col("tid").alias("kid"), "license_id", "tsh")
    if (BANDS + 4) * BANDS * sum(lengths.values()) <= BROADCAST_HASHES:
        by_band = F.broadcast(by_band)
    if sum(m * n for m, n in lengths.items()) <= BROADCAST_HASHES:
        by_id = F.broadcast(by_id)

    # Outer generators: others get a filter that works their arrays out a second time.
    names = ", ".join(f"'{w}'" for w in cover)
    stems = [w for w in cover if not any(x != w and x in w for x in cover)]
    low = docs.select(F.col(doc_id).alias("doc_id"), F.lower(text).alias("t"))
    found = low.where(" or ".join(f"contains(t, '{w}')" for w in stems)).select("doc_id", F.expr(_WORDS.replace("lower({0})", "{0}").format("t")).alias("w"))
    places = f"filter(transform(w, (x, i) -> if(x in ({names}), i, -1)), i -> i >= 0)"
    found = found.select("doc_id", "w", F.expr(places).alias("places"))
    # Starts of windows, on their grid, whose shingles take in a place; a window is its words and SHINGLE - 1 more.
    grid = "filter(array_distinct(flatten(transform(places, p -> sequence({s} * ceil(greatest(0, p - {reach}) / {s}), {s} * (p div {s}), {s})))), at -> at <= size(w) - " + str(SHINGLE) + ")"
    each = [f"transform({grid.format(s=max(1, m // 4), reach=SHINGLE - 2 + m + max(1, m // 4))}, at -> named_struct('m', {m}, 'at', cast(at as bigint), 'ws', slice(w, cast(at as int) + 1, {m + max(1, m // 4) + SHINGLE - 1})))" for m in sorted(lengths)]
    windows = found.select("doc_id", F.explode_outer(F.expr(f"concat({', '.join(each)})")).alias("x")).where("x is not null")
    windows = windows.select("doc_id", "x.m", "x.at", F.expr(_SHINGLES.format("x.ws")).alias("win"))
    banded = windows.select("*", F.expr(_SIGNATURE.format("win")).alias("sig")).select("*", F.posexplode_outer("sig").alias("band", "v"))
    met = banded.join(by_band, (F.col("m") == F.col("tm")) & (F.col("band") == F.col("tband")) & (F.col("v") == F.col("tv")))
    met = met.where(f"filter(sequence(0, {BANDS - 1}), k -> sig[k] = tsig[k])[0] = band")  # each pair once
    held = met.select("doc_id", "tid", "at", "win").join(by_id, F.col("tid") == F.col("kid")).select("doc_id", "license_id", "at", (F.size(F.array_intersect("tsh", "win")) / F.size("tsh")).alias("share"))
    return (
        held.where(F.col("share") >= CONTAINED)
        .groupBy("doc_id", "license_id")
        .agg(F.round(F.max("share"), 6).alias("containment"), F.countDistinct("at").alias("n_windows"), F.min("at").alias("first_word"))
    )


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), templates(spark), cover_words([t for _, t in TEMPLATES]))


def _sql() -> str:
    """Every window of every text against every template, without bands or cover words."""
    rows = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in TEMPLATES)
    split = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    shingled = f"list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))"
    return f"""
WITH tpl(license_id, text) AS (VALUES {rows}),
t0 AS (SELECT license_id, {split.format("text")} AS w FROM tpl),
t1 AS (SELECT license_id, {shingled} AS sh FROM t0 WHERE len(w) >= {SHINGLE}),
t AS (SELECT license_id, list_distinct(sh) AS tsh, CAST(len(sh) AS BIGINT) AS m FROM t1),
sizes AS (SELECT DISTINCT m, greatest(1, m // 4) AS s FROM t),
d0 AS (SELECT doc_id, {split.format("text")} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, {shingled} AS sh FROM d0 WHERE len(w) >= {SHINGLE}),
hits AS (SELECT DISTINCT doc_id, sh FROM d WHERE len(list_intersect(sh, (SELECT list_distinct(flatten(list(tsh))) FROM t))) > 0),
win AS (SELECT doc_id, m, pos, sh[pos + 1:pos + m + s] AS win FROM (SELECT doc_id, sh, m, s, unnest(range(0, len(sh), s)) AS pos FROM hits, sizes)),
held AS (SELECT doc_id, license_id, pos, len(list_intersect(tsh, win)) / len(tsh) AS share FROM win JOIN t USING (m))
SELECT doc_id, license_id, round(max(share), 6) AS containment, count(DISTINCT pos) AS n_windows, CAST(min(pos) AS BIGINT) AS first_word
FROM held WHERE share >= {CONTAINED} GROUP BY doc_id, license_id
"""


SQL = _sql()
