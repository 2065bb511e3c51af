"""License scans: MinHash bands over overlapping windows retrieve templates,
exact shingle containment verifies them. DataFrame functions only, one narrow
stage without a shuffle.

Templates of fewer than 32 shingles are retrieved by each of their shingles
(windows of one), so none that is held can be missed. Longer ones are cut into
pieces of 16 shingles; a text has windows of the same number. If a text holds a
share ``threshold`` of a template's shingles, then it holds that share of some
piece, as pieces do not overlap (but for a last one that is moved back to the
template's end). Windows of 16 move by 4 shingles, so one of them lies within 2
shingles of the piece: similarity at least (13 - 2) / (16 + 2 + 3) = 0.52, and
``BANDS`` = 8 bands of one minimum each retrieve the template with probability
1 - 0.48^8 = 0.997 or more; an unchanged piece (0.78 or more) with 1 - 6e-6.
Each further piece of a template multiplies the chance of a miss.

Licenses that differ in a few words only (a version, "Lesser") hold each
other's shingles to more than the threshold. ``REQUIRED`` names phrases that
must stand, word by word, within the matching span.

Minima come from one 64-bit hash per shingle; band k orders the hashes by
their exclusive-or with a constant. Windows of 16 are built from minima of
4-shingle chunks, so each shingle is looked at once per band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, THRESHOLD, BANDS = 5, 0.8, 8
#: Templates of so many shingles are cut into pieces of 16; shorter ones are retrieved by single shingles.
LONG = 32
#: Band keys that are compared in one pass over the texts; more templates take further passes.
KEYS_PER_PASS = 4096
_CHUNK = 4
_BETWEEN = r"[^\p{L}\p{N}]+"

#: Notices and license texts as their publishers word them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "MIT-notice-distributed": "Distributed under the MIT License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "Apache-2.0-tag": "SPDX-License-Identifier: Apache-2.0",
    "GPL-2.0-only-tag": "SPDX-License-Identifier: GPL-2.0-only",
    "GPL-3.0-only-tag": "SPDX-License-Identifier: GPL-3.0-only",
    "BSD-3-Clause-tag": "SPDX-License-Identifier: BSD-3-Clause",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide. This software is distributed without any warranty."
    ),
    "BSD-3-Clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
}

#: Phrases that tell a license from others of nearly the same wording.
REQUIRED = {
    "GPL-3.0-notice": ["version 3"],
    "GPL-2.0-notice": ["version 2"],
    "GPL-2.0-or-later": ["gnu general public license", "version 2 of"],
    "GPL-3.0-or-later": ["gnu general public license", "version 3 of"],
    "LGPL-2.1-or-later": ["lesser general public", "version 2 1 of"],
    "AGPL-3.0-or-later": ["affero general public", "version 3 of"],
    "CC-BY-4.0-notice": ["attribution 4 0"],
    "CC-BY-SA-4.0-notice": ["attribution sharealike 4 0"],
}


def _with_shingles(df: DataFrame, words: int) -> DataFrame:
    """Adds ``w``, the text's words, and ``sh``, the hashes of its shingles in order; shorter texts are one shingle, empty ones none."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), _BETWEEN), "")
    hashed = df.withColumn("w", tokens).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    n = F.size("wh")
    many = F.transform(F.sequence(F.lit(1), n - words + 1), lambda i: F.xxhash64(*[F.element_at("wh", i + j) for j in range(words)]))
    return hashed.withColumn("sh", F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.array().cast("array<bigint>"))).drop("wh")


def _band(k: int) -> int:
    """Constants by a multiplicative rule, as signed 64-bit numbers."""
    c = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    return c - (1 << 64) if c >= 1 << 63 else c


def _next(col: str, by: int) -> Column:
    """Minimum of each element and the one ``by`` places on."""
    return F.zip_with(col, F.slice(col, by + 1, F.greatest(F.size(col), F.lit(0))), lambda x, y: F.least(x, y))


def _lowest(constant: int):
    """Chunk -> its lowest hash in the order of one band."""
    return lambda chunk: F.array_min(F.transform(chunk, lambda x: x.bitwiseXOR(F.lit(constant))))


def _with_keys(df: DataFrame, sizes: set[int], bands: int) -> DataFrame:
    """Adds ``found``: the band keys of all windows of the given sizes over ``sh``."""
    parts = []
    if 1 in sizes:
        parts.append(F.col("sh"))
    if 16 in sizes:
        n = F.size("sh")
        starts = F.when(n >= _CHUNK, F.sequence(F.lit(1), n, F.lit(_CHUNK))).otherwise(F.array().cast("array<int>"))
        df = df.withColumn("chunks", F.transform(starts, lambda i: F.slice("sh", i, _CHUNK)))
        for k in range(bands):
            df = df.withColumn(f"low{k}", F.transform("chunks", _lowest(_band(k))))
        for k in range(bands):
            df = df.withColumn(f"half{k}", _next(f"low{k}", 1))
        for k in range(bands):
            df = df.withColumn(f"band{k}", _next(f"half{k}", 2))
            parts.append(F.col(f"band{k}"))
    return df.withColumn("found", F.concat(*parts))


def _pieces(shingles: list[int]) -> tuple[int, list[list[int]]]:
    size = 16 if len(shingles) >= LONG else 1
    starts = list(range(0, len(shingles) - size + 1, size))
    if len(shingles) % size:
        starts.append(len(shingles) - size)
    return size, [shingles[i : i + size] for i in starts]


def index_templates(spark: SparkSession, templates: dict[str, str], words: int = WORDS, bands: int = BANDS) -> list[tuple[str, int, list[int], set[int]]]:
    """(name, window size, shingles, band keys) of each template; templates without a word are left out."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    out = []
    for name, shingles in _with_shingles(rows, words).select("name", "sh").collect():  # the templates, not documents
        if not shingles:
            continue
        size, pieces = _pieces(shingles)
        if size == 1:
            keys = set(shingles)
        else:
            keys = {min(x ^ _band(k) for x in p) for p in pieces for k in range(bands)}
        out.append((name, size, list(dict.fromkeys(shingles)), keys))
    return out


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    keys_per_pass: int = KEYS_PER_PASS,
    required: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per row and template that it holds: doc_id, license, matched, template_shingles, containment, first_word, last_word.

    Words are runs of letters and digits, in lower case; shingles have ``words``
    words, a shorter text or template is one shingle. Containment is the share
    of the template's distinct shingles that the whole text holds, and rows
    have at least ``threshold``. ``required`` (default: ``REQUIRED`` for the default
    templates, none for others) maps a template to phrases, in lower-case words
    parted by one blank, that must all stand between the first and the last
    matching word. ``first_word`` and ``last_word`` (from 0) span
    the matching shingles. Null and empty texts hold nothing; repeated rows
    each give their rows; ids may be null; other columns are ignored. Many
    templates are scanned in several passes, none is left out.
    """
    spark = docs.sparkSession
    required = (REQUIRED if templates is None else {}) if required is None else required
    index = index_templates(spark, TEMPLATES if templates is None else templates, words, bands)
    passes: list[list] = [[]]
    for t in index:
        if passes[-1] and sum(len(x[3]) for x in passes[-1]) + len(t[3]) > keys_per_pass:
            passes.append([])
        passes[-1].append(t)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    results = [_one_pass(base, group, words, threshold, bands, required) for group in passes if group]
    if not results:
        none = {"license": "string", "matched": "int", "template_shingles": "int", "containment": "double", "first_word": "int", "last_word": "int"}
        return base.filter(F.lit(False)).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _one_pass(base: DataFrame, group: list, words: int, threshold: float, bands: int, required: dict[str, list[str]]) -> DataFrame:
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    all_keys = longs(sorted({k for t in group for k in t[3]}))
    keyed = _with_keys(_with_shingles(base, words), {t[1] for t in group}, bands)
    # The row number keeps the filter above this projection. Pushed down, its condition would hold
    # all columns' definitions, each evaluated anew for every element.
    marked = keyed.select("doc_id", "w", "sh", F.array_intersect("found", all_keys).alias("hits"), F.monotonically_increasing_id().alias("_row"))
    hits = marked.filter((F.size("hits") > 0) & (F.col("_row") >= 0))
    # the few texts with a hit: which templates, and are they there
    candidates = F.filter(
        F.array(*[F.struct(F.lit(name).alias("license"), longs(sh).alias("t"), F.arrays_overlap("hits", longs(sorted(keys))).alias("hit")) for name, _, sh, keys in group]),
        lambda c: c["hit"],
    )
    one = hits.select("doc_id", "w", "sh", F.explode(candidates).alias("c")).select("doc_id", "w", "sh", "c.license", "c.t")
    checked = one.withColumn("matched", F.size(F.array_intersect("t", "sh"))).withColumn("template_shingles", F.size("t"))
    held = checked.filter(F.col("matched") >= F.lit(threshold) * F.col("template_shingles"))
    places = held.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.array_contains("t", F.element_at("sh", i + 1))))
    places = places.withColumn("first_word", F.array_min("at")).withColumn("last_word", F.array_max("at") + words - 1)
    span = F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("first_word") + 1, F.col("last_word") - F.col("first_word") + 1), " "), F.lit(" "))
    phrases = F.lit(True)
    for name, *_ in group:
        for phrase in required.get(name, ()):
            phrases = phrases & ((F.col("license") != name) | F.contains(span, F.lit(f" {phrase} ")))
    return places.filter(phrases).select(
        "doc_id", "license", "matched", "template_shingles", (F.col("matched") / F.col("template_shingles")).alias("containment"), "first_word", "last_word"
    )


def sql(templates: dict[str, str] | None = None) -> str:
    """Brute force: all shingles of all documents against all shingles of all templates."""
    required = REQUIRED if templates is None else {}
    span = "' ' || array_to_string(x.w[lo + 1 : hi + 5], ' ') || ' '"
    phrases = "".join(f" AND (h.license <> '{n}' OR contains({span}, ' {p} '))" for n, ps in required.items() for p in ps)
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in (TEMPLATES if templates is None else templates).items())
    return rf"""
WITH given AS (SELECT * FROM (VALUES {values}) v(license, text)
), words AS (
  SELECT 't' AS kind, license AS name, 0 AS doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM given
  UNION ALL
  SELECT 'd', '', doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') FROM documents
), shingles AS (
  SELECT kind, name, doc_id, i - 1 AS at, array_to_string(w[i : i + 4], ' ') AS s FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT name AS license, s FROM shingles WHERE kind = 't'
), total AS (
  SELECT license, count(*) AS n FROM wanted GROUP BY license
), held AS (
  SELECT d.doc_id, t.license, count(DISTINCT d.s) AS matched, min(d.at) AS lo, max(d.at) AS hi FROM shingles d JOIN wanted t ON d.s = t.s WHERE d.kind = 'd' GROUP BY 1, 2
)
SELECT h.doc_id, h.license, CAST(matched AS INTEGER) AS matched, CAST(n AS INTEGER) AS template_shingles, matched / n AS containment,
  CAST(lo AS INTEGER) AS first_word, CAST(hi + 4 AS INTEGER) AS last_word
FROM held h JOIN total t ON h.license = t.license JOIN words x ON x.kind = 'd' AND x.doc_id = h.doc_id WHERE matched >= 0.8 * n{phrases}
"""
