"""License scans: normalised text against license templates by the Dice coefficient over word bigrams.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import written

# fixed values: license and notice
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
PERCENT = 80

_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_CC = "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {} 4.0 International Public License"
_CC_NOTICE = "This work is licensed under a Creative Commons {} 4.0 International License."
# Paragraphs by which whole license texts are known, and notices of further licenses.
BODIES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _NOTICE.format("GNU Affero General Public License", 3)),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD.format("", "", "")),
    ("BSD-2-Clause", _BSD.format("1. ", "2. ", "")),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD.format("", "", _BSD_NAME)),
    ("BSD-3-Clause", _BSD.format("1. ", "2. ", f"3. {_BSD_NAME}")),
    *((f"CC-{short}-4.0", text.format(name)) for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for text in (_CC, _CC_NOTICE)),
    *((f"CC-{short.replace(' ', '-')}-4.0", f"Licensed under CC {short} 4.0.") for short in ("BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an \"owner\") of an original work of authorship and/or a database (each, a \"Work\")."),
    ("GPL-2.0", _NOTICE.format("GNU General Public License", 2)),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _NOTICE.format("GNU Lesser General Public License", "2.1")),
    ("LGPL-2.1", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("LGPL-3.0", _NOTICE.format("GNU Lesser General Public License", 3)),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("MIT", _MIT_GRANT),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
KNOWN = TEMPLATES + BODIES
# Words of much other English text, chosen as keywords last.
COMMON = frozenset(
    "a all and are as at be by can commercial change conditions copy copyright following for free from general is it in intended international network no not of on or original other "
    "person practical product provided publish rights source specifically subject that the this throughout to under use version without work works you your any with available following".split()
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """ASCII letters in lower case and digits; every run of other characters is one space."""
    return F.btrim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+", " "))


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring words of a normalised text, as ``one two``."""
    words = F.split(text, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _words(text: str) -> list[str]:
    return "".join(c if c in _LOWER or c in "0123456789" else " " for c in text.translate(str.maketrans(_UPPER, _LOWER))).split()


def _pairs(text: str) -> list[str]:
    words = _words(text)
    return sorted(set(map(" ".join, zip(words, words[1:], strict=False))))


def keywords(templates: list[list[str]], percent: int) -> list[str]:
    """Words of which every matching text holds at least one.

    A match shares at least ``percent / (200 - percent)`` of a template's bigrams, so of a few more than
    the rest it holds one; words are chosen, long ones first, until they touch that many bigrams of each template.
    """
    chosen: set[str] = set()
    for pairs in templates:
        split = [set(p.split(" ")) for p in pairs]
        enough = len(pairs) - -(-percent * len(pairs) // (200 - percent)) + 1
        while (open_ := [p for p in split if not p & chosen]) and len(split) - len(open_) < enough:
            words = {w for p in open_ for w in p}
            chosen.add(max(words, key=lambda w: (w not in COMMON, min(len(w), 6), sum(w in p for p in open_), w)))  # noqa: B023
    return sorted(chosen)


def _holding(docs: DataFrame, words: list[str]) -> DataFrame:
    """The rows of ``docs`` whose ``text`` holds one of ``words``; the text is put in lower case once, since a filter does not pass a generator."""
    small = F.col("_small")
    held = F.lit(False)
    for word in words:
        # A short word is often part of another one.
        alone = small.rlike(f"(?<![a-z0-9]){word}(?![a-z0-9])") if len(word) < 4 else F.lit(True)
        held = held | (F.contains(small, F.lit(word)) & alone)
    return docs.select("*", F.explode(F.array(F.lower("text"))).alias("_small")).filter(held).drop("_small")


def _hits(own: Column, t: Column) -> Column:
    """The places in ``own``, the bigrams of a text in order, that hold a bigram of template ``t``."""
    return F.filter(F.transform(own, lambda x, i: F.when(F.array_contains(t["pairs"], x), i)), lambda i: i.isNotNull())


def _best_ends(own: Column, hits: Column, t: Column, percent: int) -> Column:
    """``same, dice, lo, hi``: for each hit the best window that starts there, where one matches.

    Bigrams at an end that the template lacks only lower the coefficient, so windows start and end at hits.
    """

    def measured(s: Column, e: Column) -> Column:
        made = F.transform(F.array(F.slice(own, s + 1, e - s + 1)), lambda x: F.struct(F.size(F.array_intersect(x, t["pairs"])).alias("same"), F.size(F.array_distinct(x)).alias("n")))
        return F.transform(made, lambda m: F.struct((2 * m["same"] / (m["n"] + F.size(t["pairs"]))).alias("dice"), m["same"].alias("same"), (-e).alias("end"), (200 * m["same"] >= percent * (m["n"] + F.size(t["pairs"]))).alias("fits")))[0]

    def ends(s: Column, i: Column) -> Column:
        near = F.filter(F.slice(hits, i + t["need"], t["span"]), lambda e: e < s + t["span"])
        best = F.array_max(F.filter(F.transform(near, lambda e: measured(s, e)), lambda w: w["fits"]))
        return F.transform(F.array(best), lambda w: F.when(w.isNotNull(), F.struct(w["same"].alias("same"), w["dice"].alias("dice"), s.alias("lo"), (-w["end"]).alias("hi"))))[0]

    # A match holds so many of the template's bigrams that the next hits cannot be far.
    starts = F.transform(hits, lambda s, i: F.when(F.get(hits, i + t["need"] - 1) < s + t["span"], ends(s, i)))
    return F.filter(starts, lambda w: w.isNotNull())


def _windows(docs: DataFrame, listed: Column, every: Column, percent: int) -> DataFrame:
    """Matching word windows of ``docs`` (doc_id, text, not null), with the bigrams and lines they lie in."""
    words = F.split(normalised(F.col("text")), " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    own = docs.select("doc_id", "text", F.explode(F.array(F.when(F.size(words) > 1, pairs))).alias("own")).filter("own IS NOT NULL")
    small = own.select("*", F.explode(F.array(F.array_intersect("own", every))).alias("small"))
    likely = small.select("doc_id", "text", "own", F.explode(F.filter(listed, lambda t: F.size(F.array_intersect(t["pairs"], F.col("small"))) >= t["need"])).alias("t"))
    hits = likely.select("*", F.explode(F.array(_hits(F.col("own"), F.col("t")))).alias("hits"))
    found = hits.select("doc_id", "text", "t", F.explode(F.array(_best_ends(F.col("own"), F.col("hits"), F.col("t"), percent))).alias("w")).filter(F.size("w") > 0)
    # The line of each word.
    counts = lambda line, i: F.array_repeat(i + 1, F.size(F.filter(F.split(normalised(line), " "), lambda w: w != "")))
    lined = found.select("doc_id", F.col("t.license").alias("license"), "w", F.explode(F.array(F.flatten(F.transform(F.split("text", "\n", -1), counts)))).alias("line"))
    each = lined.select("doc_id", "license", "line", F.explode("w").alias("w"))
    return each.select("doc_id", "license", "w.*", F.get("line", F.col("w.lo")).alias("first"), F.get("line", F.col("w.hi") + 1).alias("last"))


def _settled(matches: Column) -> Column:
    """Of the matches of a document those that count, by the number of bigrams shared, then by the coefficient, units before windows.

    Each is taken unless one already taken explains the same place better: windows that share a word, a
    window and a line it touches or the whole text, and the whole text and a line that shares less.
    """

    def rivals(x: Column, c: Column) -> Column:
        inside = lambda line, w: (line["unit"] == 0) | ((line["unit"] >= w["first"]) & (line["unit"] <= w["last"]))
        return (
            F.when((x["kind"] == 1) & (c["kind"] == 1), (x["lo"] <= c["hi"] + 1) & (c["lo"] <= x["hi"] + 1))
            .when(x["kind"] == 1, inside(c, x))
            .when(c["kind"] == 1, inside(x, c))
            .otherwise((x["unit"] == 0) & (c["unit"] > 0) & (x["less_same"] < c["less_same"]))
        )

    ordered = F.array_sort(matches)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda taken, c: F.when(F.exists(taken, lambda x: rivals(x, c)), taken).otherwise(F.concat(taken, F.array(c))))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = KNOWN, percent: int = PERCENT) -> DataFrame:
    """``doc_id, unit, license, dice`` of ``docs`` (doc_id long, text string): a unit is a line (its number from 1), as 0 a whole text of several lines, or a window of words (the line it starts in).

    A unit matches a template if 2 |A and B| / (|A| + |B|) over the distinct word bigrams
    reaches ``percent`` hundredths; a line or text has the license of its best template, of equal ones the first by name.  A template is compared only with units
    whose size allows that.  Windows run over line breaks and are as long as the template, more or less by what ``percent`` allows; of matches
    at one place that which shares most bigrams counts (``_settled``).  Null texts, empty texts, units of fewer than two words and rows without doc_id match nothing.
    """
    # The templates are a parameter of a few entries, so they travel as a literal with the plan.
    known = [(name, pairs, len(_words(text)) - 1) for name, text in templates if (pairs := _pairs(text))]
    need, span = (lambda n: -(-percent * n // (200 - percent))), (lambda n: n * (200 - percent) // percent)
    listed = F.array(*(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, pairs)).alias("pairs"), F.lit(need(len(pairs))).alias("need"), F.lit(span(n)).alias("span")) for name, pairs, n in known))
    every = F.array(*(F.lit(p) for p in sorted({p for _, pairs, _ in known for p in pairs})))
    # Most documents hold no keyword, and are not taken apart.
    words = keywords([pairs for _, pairs, _ in known], percent)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    worth = written(_holding(named, words), "worth")
    lines = F.split("text", "\n", -1)
    units = worth.select("doc_id", F.when(F.size(lines) > 1, F.array_prepend(lines, F.col("text"))).otherwise(F.array(F.lit(None).cast("string"), F.col("text"))).alias("units"))
    units = _holding(units.select("doc_id", F.posexplode("units").alias("unit", "text")).filter("text IS NOT NULL"), words)
    # A filter is not moved below a generator, so each unit is taken apart once.
    made = units.select("doc_id", "unit", F.explode(F.array(bigrams(normalised(F.col("text"))))).alias("own")).filter(F.arrays_overlap("own", every))
    n = F.size("own")
    # 2 min(a, b) / (a + b) is the most that sizes a and b allow.
    fits = F.filter(listed, lambda t: 200 * F.least(n, F.size(t["pairs"])) >= percent * (n + F.size(t["pairs"])))
    compared = made.select("doc_id", "unit", "own", F.explode(fits).alias("t"))
    same = F.size(F.array_intersect("own", F.col("t.pairs")))
    dice = 2 * same / (F.size("own") + F.size(F.col("t.pairs")))
    enough = 200 * same >= percent * (F.size("own") + F.size(F.col("t.pairs")))
    best = compared.filter(enough).groupBy("doc_id", "unit").agg(F.min(F.struct((-dice).alias("less"), F.col("t.license").alias("license"), same.alias("same"))).alias("b"))

    def match(same: str, dice: Column, kind: int, license: str, unit: str, **place: object) -> Column:
        at = [F.lit(place.get(k)).cast("int").alias(k) if place.get(k) is None else F.col(k).alias(k) for k in ("lo", "hi", "first", "last")]
        return F.struct((-F.col(same)).alias("less_same"), (-dice).alias("less"), F.lit(kind).alias("kind"), F.col(license).alias("license"), F.col(unit).alias("unit"), *at)

    whole = best.select("doc_id", match("b.same", -F.col("b.less"), 0, "b.license", "unit").alias("m"))
    cut = _windows(worth, listed, every, percent).select("doc_id", match("same", F.col("dice"), 1, "license", "first", lo=1, hi=1, first=1, last=1).alias("m"))
    settled = whole.unionByName(cut).groupBy("doc_id").agg(F.collect_set("m").alias("m")).select("doc_id", F.explode(_settled(F.col("m"))).alias("m"))
    return settled.select("doc_id", "m.unit", "m.license", (-F.col("m.less")).alias("dice"))


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = KNOWN, percent: int = PERCENT) -> DataFrame:
    """``doc_id, licenses, n_matches, best_dice`` for each row of ``docs``: see ``scan``.

    ``licenses`` are names in order, joined by commas; ``n_matches`` counts matches; a document without a
    match has an empty list, 0 and 0.0.  Rows repeated under one doc_id are one document; rows without doc_id have no match.
    """
    found = scan(docs, templates, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.count("*").alias("n_matches"), F.round(F.max("dice"), 6).alias("best_dice")
    )
    ids = docs.select(F.col("doc_id").cast("long"))
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"))


def _values() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, _pairs(text)))}])" for name, text in TEMPLATES)


ORACLE = rf"""
WITH t(license, pairs) AS (VALUES {_values()}),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM documents
      UNION ALL SELECT doc_id, text, 0 FROM documents WHERE contains(text, chr(10))),
w AS (SELECT doc_id, unit, string_split(trim(regexp_replace(translate(line, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
b AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
c AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(own, pairs)) / (len(own) + len(pairs)) AS dice FROM b, t
      WHERE 200 * least(len(own), len(pairs)) >= {PERCENT} * (len(own) + len(pairs)) AND 200 * len(list_intersect(own, pairs)) >= {PERCENT} * (len(own) + len(pairs))
      QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1),
g AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n_matches, round(max(dice), 6) AS best_dice FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0) AS n_matches, coalesce(best_dice, 0.0) AS best_dice FROM documents LEFT JOIN g USING (doc_id)
"""
