"""Finding licence notices: normalised text against templates, by Dice coefficient over word bigrams.

Column expressions only. A unit of text is compared with those templates alone whose number of distinct
bigrams allows the threshold at all: with n bigrams in the unit and m in the template, 2 * min(n, m) / (n + m)
bounds the coefficient.

Beside lines, paragraphs and texts there are windows: as many words as a template has, anywhere in the text, whatever
its lines and paragraphs. With threshold s a window shares at least s * m / (2 - s) of the template's m bigrams, so any
larger rest of them has one in the window: the template's anchors, its longest bigrams. An anchor in the text, at its
place in the template, says where a window starts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in all templates together; they become part of the plan.
MOST_TEMPLATE_WORDS = 20_000
#: Bigrams of a text that are looked at together for windows, at least; four times the longest template if that is more.
PIECE = 4096

MIT_TERMS = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
    "specific language governing permissions and limitations under the License."
)
GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
    "License for more details."
)

#: (licence, wording): notices as they are commonly written.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_NOTICE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", MIT_TERMS),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GPL_NOTICE),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("proprietary", "All rights reserved."),
)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def pairs_of(words: Column) -> Column:
    """Hashes of neighbouring words, in order."""
    n = F.size(words)
    return F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def bigrams_of(words: Column) -> Column:
    """Distinct hashes of neighbouring words."""
    return F.array_distinct(pairs_of(words))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once: a lambda that reads it does not repeat its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def units_of(text: Column) -> Column:
    """Every line, every paragraph of several lines, and the text if it has several paragraphs."""
    paragraphs = F.split(text, r"\n[ \t\r]*\n")

    def unit(kind: str, strings: Column) -> Column:
        return F.transform(strings, lambda s, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("position"), s.alias("words")))

    several = F.filter(unit("paragraph", paragraphs), lambda u: u["words"].contains("\n"))
    whole = F.when(F.size(paragraphs) > 1, unit("text", F.array(text))).otherwise(F.expr("array()"))
    return F.concat(unit("line", F.split(text, "\n")), several, whole)


@dataclass(frozen=True)
class Template:
    """Distinct bigrams, the number of all, and (bigram, place) of those that may start a window."""

    license: str
    grams: list[int]
    length: int
    anchors: list[tuple[int, int]]


def spare_share(threshold: float) -> float:
    """The share of a template's bigrams that a window at the threshold need not have."""
    return 1 - threshold / (2 - threshold)


def anchor_places(pairs: Sequence[str], threshold: float) -> list[int]:
    """Places of the longest distinct bigrams, one more than a window at the threshold can be without."""
    longest = sorted(set(pairs), key=lambda g: (-len(g), g))
    chosen = set(longest[: math.floor(len(longest) * spare_share(threshold) + 1e-9) + 1])
    return [i for i, g in enumerate(pairs) if g in chosen]


def template_rows(spark: SparkSession, templates: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    if sum(len(text.split()) for _, text in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words; scan with a part of them at a time")
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "i int, license string, wording string")
    rows = frame.select("i", "license", words_of(F.col("wording")).alias("words"))
    found = []
    for r in sorted(rows.select("*", pairs_of(F.col("words")).alias("pairs")).collect(), key=lambda r: r.i):
        if r.pairs:
            places = anchor_places([f"{a} {b}" for a, b in zip(r.words, r.words[1:], strict=False)], threshold)
            found.append(Template(r.license, list(dict.fromkeys(r.pairs)), len(r.pairs), [(r.pairs[i], i) for i in places]))
    return found


def windows(docs: DataFrame, known: Sequence[Template], options: Column, threshold: float) -> DataFrame:
    """doc_id, unit, position, i (of the template) and dice of the windows that no better one of the template overlaps.

    Long texts are cut into pieces that overlap by as much as windows and their neighbours need.
    """
    longest = max(t.length for t in known)
    step = max(PIECE, 4 * longest)
    starts: dict[int, list[Column]] = {}
    for i, t in enumerate(known):
        for gram, place in t.anchors:
            starts.setdefault(gram, []).append(F.struct(F.lit(i).alias("i"), F.lit(place).alias("place")))
    by_anchor = F.create_map(*(c for gram, at in starts.items() for c in (F.lit(gram), F.array(*at))))

    def is_anchor(gram: Column) -> Column:
        return gram.isin(*starts)

    def dice(template: Column, window: Column) -> Column:
        n = F.size(window)
        shared = F.size(F.array_intersect(template["grams"], window))
        return F.when(2 * F.least(template["m"], n) >= threshold * (template["m"] + n), 2 * shared / (template["m"] + n))

    def scored(c: Column) -> Column:
        template = options[c["i"]]
        window = F.array_distinct(F.slice("piece", c["start"] + 1, template["length"]))
        # one element, so that the window is computed once
        return F.struct(c["i"].alias("i"), c["start"].alias("start"), F.transform(F.array(window), lambda w: dice(template, w))[0].alias("dice"))

    def overlapped(w: Column) -> Column:
        def better(v: Column) -> Column:
            near = (v["i"] == w["i"]) & (F.abs(v["start"] - w["start"]) <= options[w["i"]]["length"])
            return near & ((v["dice"] > w["dice"]) | ((v["dice"] == w["dice"]) & (v["start"] < w["start"])))

        return F.exists("near", better)

    worded = computed(docs.select("doc_id", "text"), "words", words_of(F.col("text"))).drop("text").where(F.size("words") > 1)
    paired = computed(worded, "pairs", pairs_of(F.col("words"))).drop("words").where(F.exists("pairs", is_anchor))
    bases = F.sequence(F.lit(0), F.size("pairs") - 1, F.lit(step))
    cut = F.transform(
        bases,
        lambda b: F.struct(
            b.alias("base"),
            F.greatest(b - longest, F.lit(0)).alias("first"),
            F.slice("pairs", F.greatest(b - longest, F.lit(0)) + 1, step + 3 * longest).alias("piece"),
        ),
    )
    pieces = paired.select("doc_id", F.inline(cut)).where(F.exists("piece", is_anchor))
    hits = F.filter(F.transform("piece", lambda g, at: F.struct(g.alias("g"), at.alias("at"))), lambda h: is_anchor(h["g"]))
    named = F.transform(hits, lambda h: F.transform(by_anchor[h["g"]], lambda a: F.struct(a["i"].alias("i"), (h["at"] - a["place"]).alias("start"))))
    inside = F.filter(F.flatten(named), lambda c: (c["start"] >= 0) & (c["start"] + options[c["i"]]["length"] <= F.size("piece")))
    tried = computed(pieces, "tried", F.array_distinct(inside)).where(F.size("tried") > 0)
    near = computed(tried, "near", F.filter(F.transform("tried", scored), lambda w: w["dice"] >= threshold)).where(F.size("near") > 0)
    place = F.col("first") + F.col("w.start")
    return (
        near.select("doc_id", "base", "first", F.explode(F.filter("near", lambda w: ~overlapped(w))).alias("w"))
        .where((place >= F.col("base")) & (place < F.col("base") + step))
        .select("doc_id", F.lit("window").alias("unit"), place.cast("long").alias("position"), F.col("w.i").alias("i"), F.col("w.dice").alias("dice"))
    )


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, unit, position, license, template and dice for every unit whose best template reaches the threshold.

    Units are those of ``units_of``, positions count from 0. Of equally good templates the one listed first counts.
    The unit "window" is any run of as many words as a template has; its position is the text's word at which it
    starts. A window counts for its own template, unless an overlapping window is better for that template; of
    equally good ones the first counts. A notice that fills a line is found as a line and as a window.
    Null and empty texts, and units with fewer than two words, match nothing. Repeated rows are reported
    as often as they occur. Other columns than doc_id and text are not looked at. No exchange.
    """
    known = template_rows(docs.sparkSession, templates, threshold)
    if not known:
        raise ValueError("no template has two words")
    options = F.array(
        *(
            F.struct(F.lit(i).alias("i"), F.lit(len(t.grams)).alias("m"), F.lit(t.length).alias("length"), F.array(*map(F.lit, t.grams)).alias("grams"))
            for i, t in enumerate(known)
        )
    )
    names = F.array(*(F.lit(t.license) for t in known))
    units = docs.select("doc_id", F.explode(units_of(F.col("text"))).alias("u")).select("doc_id", "u.unit", "u.position", F.col("u.words").alias("string"))
    worded = computed(units, "words", words_of(F.col("string"))).drop("string").where(F.size("words") > 1)
    grams = computed(worded, "grams", bigrams_of(F.col("words"))).drop("words").withColumn("n", F.size("grams"))
    possible = F.filter(options, lambda t: 2 * F.least(t["m"], F.col("n")) >= threshold * (t["m"] + F.col("n")))
    compared = computed(grams, "possible", possible).where(F.size("possible") > 0)
    score = F.transform(
        "possible",
        lambda t: F.struct((2 * F.size(F.array_intersect(t["grams"], F.col("grams"))) / (t["m"] + F.col("n"))).alias("dice"), (-t["i"]).alias("i")),
    )
    best = computed(compared, "best", F.array_max(score)).where(F.col("best.dice") >= threshold)
    found = best.select("doc_id", "unit", "position", (-F.col("best.i")).alias("i"), F.col("best.dice").alias("dice"))
    both = found.unionByName(windows(docs, known, options, threshold))
    return both.select("doc_id", "unit", "position", names[F.col("i")].alias("license"), F.col("i").alias("template"), "dice")


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same question over the table documents in DuckDB's SQL."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))

    def words(column: str) -> str:
        return f"string_split(trim(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"

    def in_order(column: str) -> str:
        return f"list_transform(range(1, len({column})), lambda i: {column}[i] || ' ' || {column}[i + 1])"

    def pairs(column: str) -> str:
        return f"list_distinct({in_order(column)})"

    return f"""
WITH paragraphs AS (SELECT doc_id, text, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS parts FROM documents),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS position, unnest(string_split(text, chr(10))) AS string FROM documents
  UNION ALL
  SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(range(len(parts))) AS position, unnest(parts) AS string FROM paragraphs) WHERE contains(string, chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, text FROM paragraphs WHERE len(parts) > 1
),
grams AS (
  SELECT doc_id, unit, position, {pairs("w")} AS g
  FROM (SELECT doc_id, unit, position, {words("string")} AS w FROM units) WHERE len(w) > 1
),
templates AS (
  SELECT i, license, {pairs("w")} AS t, {in_order("w")} AS o
  FROM (SELECT i, license, {words("wording")} AS w FROM (VALUES {quoted}) AS v(i, license, wording))
),
scored AS (
  SELECT doc_id, unit, position, license, i AS template, 2 * len(list_intersect(t, g)) / (len(t) + len(g)) AS dice
  FROM grams, templates WHERE 2 * least(len(t), len(g)) >= {threshold} * (len(t) + len(g))
),
anchors AS (
  SELECT i, g FROM (SELECT i, unnest(t) AS g, len(t) AS m FROM templates)
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(g) DESC, g) <= floor(m * {spare_share(threshold)} + 1e-9) + 1
),
places AS (SELECT i, g, place FROM (SELECT i, unnest(o) AS g, unnest(range(len(o))) AS place FROM templates) SEMI JOIN anchors USING (i, g)),
texts AS (
  SELECT r, doc_id, {in_order("w")} AS p
  FROM (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents) WHERE len(w) > 1
),
starts AS (
  SELECT DISTINCT r, i, spot - place AS start
  FROM (SELECT r, unnest(p) AS g, unnest(range(len(p))) AS spot FROM texts) JOIN places USING (g)
),
windows AS (
  SELECT r, doc_id, license, i, start, len(o) AS length, t, list_distinct(list_slice(p, start + 1, start + len(o))) AS g
  FROM starts JOIN texts USING (r) JOIN templates USING (i) WHERE start >= 0 AND start + len(o) <= len(p)
),
near AS (
  SELECT * FROM (SELECT r, doc_id, license, i, start, length, 2 * len(list_intersect(t, g)) / (len(t) + len(g)) AS dice FROM windows)
  WHERE dice >= {threshold}
)
(SELECT doc_id, unit, position, license, template, dice FROM scored WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY dice DESC, template) = 1)
UNION ALL
SELECT doc_id, 'window', start, license, i, dice FROM near AS a WHERE NOT EXISTS (
  SELECT 1 FROM near AS b WHERE b.r = a.r AND b.i = a.i AND abs(b.start - a.start) <= a.length
  AND (b.dice > a.dice OR b.dice = a.dice AND b.start < a.start)
)
"""
