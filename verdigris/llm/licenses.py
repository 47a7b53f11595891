"""License scans in DataFrame functions only: MinHash bands over text windows retrieve templates, containment verifies.

Texts and templates are words (runs of letters and digits, lower case) and their shingles of five
words. A template of more than L / 2 and up to L shingles, L a power of two, is of class L. Texts are
cut into windows of 2 L shingles, one every L, so that any L neighbouring shingles lie in a window
whole. Window and template share a band, one minimum of their shingles under one of BANDS hashes, with
the probability of their Jaccard similarity, which is 0.4 L / 2.1 L or more if the window holds 0.8
of the template: at most one match in 20,000 is missed. Pairs that share a band are then verified:
the window must hold THRESHOLD of the template's shingles.

Two exact tests come before, because most texts hold no license: a text that lacks so many of every
template's words that THRESHOLD cannot be reached, and a window without any template's shingle, are
not worth any MinHash.

Notices of fewer than five words are one shingle of their own length, sought among the texts' shingles of that length.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle; MinHash bands; share of a template's shingles that a window must hold; most templates.
WORDS, BANDS, THRESHOLD, MOST = 5, 48, 0.8, 5000

# Public license notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher."),
)
# Notices of fewer than WORDS words.
NOTICES = (("Proprietary", "All rights reserved."),)


def words(text: str) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def size_class(shingles: int) -> int:
    """The power of two that is shingles or the next above."""
    return 1 << (shingles - 1).bit_length()


def anchors(templates: Sequence[tuple[str, str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every text that matches some template has one or more.

    For each template, words are taken until the shingles with one of them are more than 1 - threshold of all: a text
    with none of those words lacks too many. Words of few templates' shingles are taken last, long ones first.
    """
    found: set[str] = set()
    for _, text in templates:
        w = words(text)
        n = min(WORDS, len(w))
        shingles = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        left, mine = set(shingles), set()
        for x in sorted(set(w), key=lambda x: (x not in found, -len(x), x)):
            if len(shingles) - len(left) > (1 - threshold) * len(shingles) + 1e-9:
                break
            mine.add(x)
            left = {s for s in left if x not in s}
        found |= mine
    return sorted(found)


def shingle_hashes(w: Column, length: int = WORDS) -> Column:
    """Hashes of the shingles of length words of an array of words, in order; none for fewer words than a shingle has."""
    at = F.sequence(F.lit(1), F.size(w) - (length - 1))
    return F.when(F.size(w) >= length, F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + n) for n in range(length)]))).otherwise(F.array().cast("array<bigint>"))


def split_words(text: str | Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def seeds(bands: int = BANDS) -> list[int]:
    """One number for each band. An element's place in the band's order is the hash of it and that number."""
    draw = random.Random(5)
    return [draw.getrandbits(64) - (1 << 63) for _ in range(bands)]


def band_minima(shingles: Column) -> Column:
    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed))))

    return F.array(*map(least, seeds()))


def once(value: Column) -> Column:
    """value as a generator's output, which the optimizer does not compute again for each filter on it."""
    return F.explode(F.array(value))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES, notices: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """template (number), license, shingles (distinct hashes), class. Templates of fewer than five words are refused, as are notices of more."""
    if len(templates) + len(notices) > MOST or any(len(words(t)) < WORDS for _, t in templates):
        raise ValueError(f"at most {MOST} templates, each of {WORDS} words or more")
    if any(not 0 < len(words(t)) < WORDS for _, t in notices):
        raise ValueError(f"notices have 1 to {WORDS - 1} words")
    both = [*templates, *notices]
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(both)])
    table = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    sizes = F.element_at(F.array(*[F.lit(size_class(max(1, len({tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)})))) for w in (words(t) for _, t in both)]), F.col("template") + 1)
    hashes = shingle_hashes(F.col("w"))
    for n in {len(words(t)) for _, t in notices}:
        hashes = F.when(F.size("w") == n, shingle_hashes(F.col("w"), n)).otherwise(hashes)
    return table.withColumn("w", split_words("text")).select("template", "license", F.array_distinct(hashes).alias("shingles"), sizes.alias("class"))


def scan(df: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, notices: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """key, license, containment, start_word: licenses found in the rows of df, each once for a key.

    containment is the largest share of one of the license's templates in a window, start_word the first word
    (from 0) of the first window with that share. A match gives way to a better one of another license that itself stays,
    if most of the places in the text that it rests on are the other's too. Null, empty and short texts match nothing; repeated rows and keys
    give one row together; null keys count as one. Without templates nothing is found. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if not templates and not notices:
        return rows.filter("false").select(F.col("key").alias(key), F.lit("").alias("license"), F.lit(0e0).alias("containment"), F.lit(0).alias("start_word"))
    table = template_table(spark, templates, notices)
    # at most MOST templates' shingles
    known = F.broadcast(table.select(F.explode("shingles").alias("shingle"), "class").distinct())
    held = rows.select("key", once(split_words("text")).alias("w")).filter(F.arrays_overlap("w", F.array(*map(F.lit, anchors([*templates, *notices], threshold)))))
    lengths = sorted({min(WORDS, len(words(t))) for _, t in [*templates, *notices]})
    hashed = held.select("key", F.xxhash64("w").alias("row"), F.explode(F.array(*[shingle_hashes(F.col("w"), n) for n in lengths])).alias("h"))
    hits = hashed.select("key", "row", "h", F.posexplode("h").alias("place", "shingle")).join(known, "shingle")
    # a place is in two windows: number place / L and the one before
    block = F.floor(F.col("place") / F.col("class")).cast("int")
    numbered = hits.select("key", "row", "h", "class", F.explode(F.array_distinct(F.array(block, F.greatest(block - 1, F.lit(0))))).alias("number"))
    start = F.col("number") * F.col("class")
    cut = numbered.select("key", "row", "class", start.alias("start"), F.slice("h", start + 1, F.col("class") * 2).alias("window"))
    windows = cut.distinct()
    banded = windows.select("*", F.posexplode(band_minima(F.col("window"))).alias("band", "low"))
    # a row for each template and band: at most MOST x BANDS
    wanted = F.broadcast(table.select("template", "class", F.posexplode(band_minima(F.col("shingles"))).alias("band", "low")))
    retrieved = banded.join(wanted, ["class", "band", "low"]).select("key", "row", "template", "class", "start", "window").distinct()
    verified = retrieved.join(F.broadcast(table.select("template", "license", "shingles")), "template").withColumn("containment", F.size(F.array_intersect("window", "shingles")) / F.size("shingles"))
    # places in the text of the window's shingles that are the template's
    places = F.filter(F.transform("window", lambda x, i: F.when(F.array_contains("shingles", x), F.col("start") + i)), lambda x: x.isNotNull())
    matches = verified.filter(F.col("containment") >= threshold - 1e-9).withColumn("places", places).groupBy("key", "row").agg(F.collect_list(F.struct((-F.col("containment")).alias("rank"), "license", "containment", "start", "class", "places")).alias("m"))

    def beats(y: Column, x: Column) -> Column:
        """Whether y, of another license, matches better than x on most of x's places."""
        apart = (y["start"] >= x["start"] + x["class"] * 2) | (x["start"] >= y["start"] + y["class"] * 2)
        return (y["license"] != x["license"]) & (y["containment"] > x["containment"]) & ~apart & (F.size(F.array_intersect(x["places"], y["places"])) * 2 > F.size(x["places"]))

    # best first, so that only matches that stay can beat others
    stay = F.aggregate(F.array_sort("m"), F.filter("m", lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: beats(y, x)), kept).otherwise(F.concat(kept, F.array(x))))
    found = matches.select("key", F.explode(stay).alias("x")).select("key", "x.*")
    best = found.groupBy("key", "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(F.col("key").alias(key), "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).cast("int").alias("start_word"))


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, notices: Sequence[tuple[str, str]] = NOTICES) -> str:
    """The same result in SQL, from all shingles of all texts; of the matches of a text, one is looked at in each step."""
    both = [*templates, *notices]
    values = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(both))
    lengths = sorted({min(WORDS, len(words(t))) for _, t in both})
    each = lambda n: rf"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    of = " UNION ALL ".join(f"SELECT doc_id, unnest({each(n)}) s, unnest(range(0, len(w) - {n - 1})) i FROM d WHERE len(w) >= {n}" for n in lengths)
    return rf"""
WITH RECURSIVE t AS (SELECT *, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') w FROM (VALUES {values}) v(template, license, body)),
ts AS (SELECT DISTINCT template, license, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE {each(WORDS)} END) s FROM t),
tn AS (SELECT template, count(*) n, CAST(pow(2, ceil(log2(count(*)))) AS INT) l FROM ts GROUP BY template),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') w FROM documents WHERE text IS NOT NULL),
ds AS ({of}),
m AS (SELECT doc_id, template, license, s, i, n, l, i // l k FROM ds JOIN ts USING (s) JOIN tn USING (template)),
wins AS (SELECT * FROM m UNION SELECT doc_id, template, license, s, i, n, l, greatest(k - 1, 0) FROM m),
c AS (SELECT doc_id, license, template, l, k * l start_at, count(DISTINCT s) / CAST(any_value(n) AS DOUBLE) containment, list_sort(list(DISTINCT i)) places FROM wins GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY containment DESC, license, start_at, l, places) r FROM c WHERE containment >= {THRESHOLD} - 1e-9),
o AS (SELECT x.doc_id, x.r, y.r better FROM f x JOIN f y ON y.doc_id = x.doc_id AND y.license <> x.license AND y.containment > x.containment AND y.start_at < x.start_at + 2 * x.l AND x.start_at < y.start_at + 2 * y.l AND len(list_intersect(x.places, y.places)) * 2 > len(x.places)),
bl AS (SELECT f.doc_id, f.r, coalesce(list(better) FILTER (better IS NOT NULL), []) beaten_by FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.r = f.r GROUP BY ALL),
st AS (SELECT doc_id, 0::BIGINT r, []::BIGINT[] kept FROM f GROUP BY doc_id UNION ALL SELECT st.doc_id, bl.r, CASE WHEN list_has_any(st.kept, bl.beaten_by) THEN st.kept ELSE list_append(st.kept, bl.r) END FROM st JOIN bl ON bl.doc_id = st.doc_id AND bl.r = st.r + 1),
e AS (SELECT doc_id, arg_max(kept, r) kept FROM st GROUP BY 1),
g AS (SELECT f.* FROM f JOIN e ON e.doc_id = f.doc_id AND list_contains(e.kept, f.r)),
b AS (SELECT doc_id, license, max(containment) containment FROM g GROUP BY ALL)
SELECT doc_id, license, b.containment, CAST(min(start_at) AS INT) start_word FROM b JOIN g USING (doc_id, license, containment) GROUP BY ALL
"""
