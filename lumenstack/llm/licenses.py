"""Licence scans in DataFrame operations only.

A unit is a line of a text, or a whole text of several lines. Normalised (A-Z
lower-cased, every run of other characters than a-z and 0-9 one space), it is
compared with licence templates by the Dice coefficient of the sets of word
bigrams: 2 |A and B| / (|A| + |B|). Coefficient t bounds the sizes,
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so most units and templates part
without a comparison; units are first dropped by words and distinct words,
which bound the number of bigrams from above and (less one) from below.

Passages are what lines and whole texts can't hold: notices wrapped over lines
of a longer text, or inside a longer line. A passage is a run of words, over
line ends, of at most as many bigrams as the template's bounds allow; it begins
and ends with bigrams of the template. Whatever reaches a template has one of its
``anchors``, words that too many of its bigrams hold to be missed, so texts
without any are left at once. Of overlapping passages of a template the
closest counts, of several templates the one that shares most bigrams. A unit
that reaches a template by itself stands for the passages inside it. Only texts
with enough bigrams of a template anywhere are searched.

The same holds of units: whatever reaches a template has a word of each of its
anchor sets (``anchor_sets``). Texts that lack one of them for every template
are left before they are normalised, by a search for bytes.

There is no shuffle: templates are literals of a fixed size.

Null or empty text: no match. Units of fewer than two words have no bigrams and
match nothing. Very long texts are compared whole as well as by line. Of equal
coefficients the template whose name comes first counts. Repeated rows repeat
their matches. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices and operative sentences of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'

#: Full texts (BSD-2-Clause up to its liability clause), looked for as passages only.
FULL_TEXTS = {
    "BSD-2-Clause-text": TEMPLATES["BSD-3-Clause"]
    + ' 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "ISC-text": TEMPLATES["ISC"]
    + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-text": TEMPLATES["MIT-grant"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
}


def bigrams(text: str) -> set[str]:
    words = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def _bounds(size: int, least: float) -> tuple[int, int]:
    """The least and largest number of bigrams that can reach ``least``."""
    fits = [n for n in range(1, int(size * (2 - least) / least) + 2) if 2 * min(n, size) / (n + size) >= least]
    return fits[0], fits[-1]


def _templates(templates: dict[str, str], least: float) -> tuple[Column, list[str], int, int]:
    names = sorted(templates)
    rows, low, high = [], 1 << 30, 0
    for rank, name in enumerate(names):
        grams = sorted(bigrams(templates[name]))
        lo, hi = _bounds(len(grams), least)
        low, high = min(low, lo), max(high, hi)
        rows.append(F.struct(F.lit(-rank).alias("rank"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams")))
    return F.array(*rows), names, low, high


#: Every character of the basic plane but a-z, 0-9 and line ends, and what it becomes.
_FROM = UPPER + "".join(c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if c not in UPPER + LOWER + "0123456789\n")
_TO = LOWER + " " * (len(_FROM) - len(UPPER))


def _plain(text: str) -> Column:
    """A-Z lower-cased, every run of other characters than a-z, 0-9 and line ends
    one space. A look-up by character is far cheaper than a regular expression,
    which only texts with characters beyond the basic plane need."""
    flat = F.translate(text, _FROM, _TO)
    flat = F.when(F.octet_length(flat) == F.char_length(flat), flat).otherwise(F.regexp_replace(flat, "[^a-z0-9\n]", " "))
    return F.regexp_replace(flat, " {2,}", " ")


def _one_line(plain: str) -> Column:
    return F.regexp_replace(F.replace(plain, F.lit("\n"), F.lit(" ")), " {2,}", " ")


def _once(**columns: Column) -> list[Column]:
    """Columns behind a generator of one row: the optimiser can't copy their
    expressions into the filters and lambdas that use them."""
    return [F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))]


def matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, unit (line number from 1; 0: the whole text; -n: a passage that
    begins in line n), license_id, dice (6 digits) of every unit that reaches
    ``least`` with a template: its best one."""
    known, names, low, high = _templates(templates or TEMPLATES, least)
    # lower-casing knows other letters and locales too; that may add words, never hide one
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_once(low=F.replace(F.lower("text"), F.lit("\u0131"), F.lit("i"))))
    texts = texts.filter(_may_match("low", templates or TEMPLATES | FULL_TEXTS, least)).select("doc_id", *_once(plain=_plain("text")))
    # unit 0 is the whole text if it has several lines, unit n its line n
    whole = F.when(F.contains("plain", F.lit("\n")), _one_line("plain")).otherwise("")
    units = texts.select("doc_id", F.posexplode(F.concat(F.array(whole), F.split("plain", "\n"))).alias("unit", "line"))
    units = units.select("doc_id", "unit", *_once(words=F.split(F.trim("line"), " ")))
    units = units.filter((F.size("words") > low) & (F.size(F.array_distinct("words")) - 1 <= high))
    n = F.greatest(F.size("words") - 1, F.lit(0))  # the optimiser may ask for pairs of any unit
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = units.select("doc_id", "unit", *_once(grams=F.array_distinct(pairs))).withColumn("size", F.size("grams"))
    close = F.filter(known, lambda t: F.col("size").between(t["lo"], t["hi"]))
    dice = F.transform(close, lambda t: F.struct((2.0 * F.size(F.array_intersect(F.col("grams"), t["grams"])) / (F.col("size") + t["n"])).alias("dice"), t["rank"].alias("rank")))
    best = grams.filter(F.col("size").between(low, high)).select("doc_id", "unit", *_once(best=F.array_max(dice))).filter(F.col("best.dice") >= least)
    name = F.element_at(F.array(*map(F.lit, names)), F.lit(1) - F.col("best.rank"))
    found = best.select("doc_id", "unit", name.alias("license_id"), F.round("best.dice", 6).alias("dice"))
    return found.unionByName(_passages(texts, known, templates or TEMPLATES | FULL_TEXTS, least))


def _pairs(words: str) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _dice(grams: Column, t: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(F.array_distinct(grams)) + t["n"])


def _apart(passages: Column, kind: str) -> Column:
    """Of overlapping passages the first one, in their order."""
    clash = lambda a, b: (a["first"] <= b["last"]) & (b["first"] <= a["last"])
    return F.aggregate(F.array_sort(passages), F.expr(f"cast(array() as array<{kind}>)"), lambda kept, c: F.when(F.exists(kept, lambda k: clash(k, c)), kept).otherwise(F.concat(kept, F.array(c))))


#: Anchor sets of a template that a text is searched for.
ANCHOR_SETS = 4

_COMMON = frozenset("a all and any are as at be by for from in is it of on or that the this to with you".split())


def anchors(grams: list[str], need: int, apart_from: frozenset[str] = frozenset()) -> set[str]:
    """Words without which fewer than ``need`` of ``grams`` remain; common words
    only if others don't suffice. None of ``apart_from``; empty if the rest doesn't suffice."""
    left, out = set(grams), set()
    while len(left) >= need:
        held: dict[str, int] = {}
        for g in left:
            for w in set(g.split()) - apart_from:
                held[w] = held.get(w, 0) + 1
        if not held:
            return set()
        out.add(max(sorted(held), key=lambda w: (w not in _COMMON, held[w])))
        left = {g for g in left if out.isdisjoint(g.split())}
    return out


def anchor_sets(grams: list[str], need: int) -> list[set[str]]:
    """Disjoint sets of words; whatever has ``need`` of ``grams`` has a word of each."""
    out: list[set[str]] = []
    while len(out) < ANCHOR_SETS and (words := anchors(grams, need, frozenset().union(*out))):
        out.append(words)
    return out


def _need(size: int, lo: int, least: float) -> int:
    """The fewest bigrams of a template of ``size`` that whatever reaches it shares."""
    return next(k for k in range(1, size + 1) if 2 * k / (max(k, lo) + size) >= least)


def _may_match(low: str, templates: dict[str, str], least: float) -> Column:
    """Whether the lower-cased text has a word of each anchor set of a template."""
    every = []
    for name in sorted(templates):
        grams = sorted(bigrams(templates[name]))
        sets = anchor_sets(grams, _need(len(grams), _bounds(len(grams), least)[0], least))
        has = [functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in sorted(words))) for words in sets]
        every.append(functools.reduce(operator.and_, has))
    return functools.reduce(operator.or_, every)


def _passages(texts: DataFrame, lines_known: Column, templates: dict[str, str], least: float) -> DataFrame:
    names = sorted(templates)
    rows, every, rare = [], set(), set()
    for rank, name in enumerate(names):
        grams = sorted(bigrams(templates[name]))
        every.update(grams)
        lo, hi = _bounds(len(grams), least)
        need = _need(len(grams), lo, least)
        rare |= anchors(grams, need)
        rows.append(F.struct(F.lit(rank).alias("rank"), F.lit(hi).alias("hi"), F.lit(need).alias("need"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams")))
    known = F.array(*rows)

    split = texts.select("doc_id", "plain", *_once(words=F.split(F.trim(_one_line("plain")), " ")))
    split = split.filter(F.exists("words", lambda w: w.isin(*sorted(rare))))
    known_grams = F.filter(_pairs("words"), lambda g: g.isin(*sorted(every)))
    some = split.select("doc_id", "plain", "words", *_once(seen=F.array_distinct(known_grams))).filter(F.size("seen") > 1)
    near = some.select("doc_id", "plain", "words", *_once(near=F.filter(known, lambda t: F.size(F.array_intersect(F.col("seen"), t["grams"])) >= t["need"]))).filter(F.size("near") > 0)
    line_of = F.flatten(F.transform(F.split("plain", "\n"), lambda line, i: F.transform(F.filter(F.split(line, " "), lambda w: w != ""), lambda w: i + 1)))
    near = near.select("doc_id", "near", *_once(grams=_pairs("words"), line_of=line_of))

    one = "struct<off:double,len:int,first:int,last:int,shared:int>"
    many = "struct<fewer:int,off:double,rank:int,first:int,last:int>"

    def window(t: Column, first: Column, last: Column) -> Column:
        part = F.slice("grams", first + 1, last - first + 1)
        shared = F.size(F.array_intersect(part, t["grams"]))
        return F.struct((-_dice(part, t)).alias("off"), (last - first).alias("len"), first.alias("first"), last.alias("last"), shared.alias("shared"))

    def of(t: Column) -> Column:
        places = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
        # wrapped, so that the places are found once
        windows = F.transform(F.array(places), lambda at: F.flatten(F.transform(at, lambda first, i: F.transform(F.filter(F.slice(at, i + 1, t["hi"]), lambda last, j: (j + 1 >= t["need"]) & (last - first < t["hi"])), lambda last: window(t, first, last)))))
        best = _apart(F.filter(F.flatten(windows), lambda w: w["off"] <= -least), one)
        return F.transform(best, lambda w: F.struct((-w["shared"]).alias("fewer"), w["off"].alias("off"), t["rank"].alias("rank"), w["first"].alias("first"), w["last"].alias("last")))

    line = lambda i: F.element_at("line_of", i + 1)
    reaches = lambda grams: F.exists(lines_known, lambda t: F.when(F.size(grams) > 0, _dice(grams, t) >= least).otherwise(False))
    found = near.select("doc_id", "grams", "line_of", *_once(passages=_apart(F.flatten(F.transform("near", of)), many))).filter((F.size("passages") > 0) & ~reaches(F.col("grams")))
    found = found.select("doc_id", "grams", "line_of", F.explode("passages").alias("p")).withColumns({"from": line(F.col("p.first")), "to": line(F.col("p.last") + 1)})
    own = F.filter("grams", lambda g, i: (line(i) == F.col("from")) & (line(i + 1) == F.col("from")))
    found = found.filter((F.col("from") != F.col("to")) | ~reaches(own))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("p.rank") + 1)
    return found.select("doc_id", (-F.col("from")).cast("int").alias("unit"), name.alias("license_id"), F.round(-F.col("p.off"), 6).alias("dice"))


def sql(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    """The same in DuckDB SQL, without bounds or pruning."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(g) for g in sorted(bigrams(text)))}])" for name, text in sorted((templates or TEMPLATES).items()))
    return f"""
        WITH known(license_id, b) AS (VALUES {rows}),
        plain AS (SELECT doc_id, string_split(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
        units AS (
            SELECT doc_id, unnest(range(1, len(lines) + 1))::INT AS unit, unnest(lines) AS line FROM plain
            UNION ALL SELECT doc_id, 0, array_to_string(lines, ' ') FROM plain WHERE len(lines) > 1),
        words AS (SELECT doc_id, unit, list_filter(string_split(line, ' '), lambda w: w <> '') AS w FROM units),
        grams AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM words WHERE len(w) > 1),
        scored AS (SELECT doc_id, unit, license_id, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM grams, known WHERE list_has_any(a, b))
        SELECT doc_id, unit, license_id, round(dice, 6) AS dice FROM scored WHERE dice >= {least}
        QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license_id) = 1
    """
