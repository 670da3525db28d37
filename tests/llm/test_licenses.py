"""License scans: the query's SQL, and edge cases."""

import random

import duckdb
from pyspark.sql import functions as F

from alertloom.llm import licenses


def test_given_documents(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(licenses.ORACLE)
    names = [c[0] for c in cursor.description]
    got = licenses.licenses(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(cursor.fetchall())
    assert any(r.licenses for r in got)


def test_edge_cases(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction."
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (4, "RELEASED -- under the mit license\nall rights reserved"), (5, notice), (6, "word " * 200_000), (7, "released under the license"), (None, "Released under the MIT License."), (8, "Licensed under the Apache License, Version 2.0."), (8, "Licensed under the Apache License, Version 2.0.")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, unit int, license string")
    got = sorted(((r.doc_id, r.licenses, r.n_matches) for r in licenses.licenses(docs).collect()), key=str)
    want = [(1, "", 0), (2, "", 0), (3, "MIT", 1), (4, "MIT,Proprietary", 2), (5, "MIT", 1), (6, "", 0), (7, "", 0), (None, "", 0), (8, "Apache-2.0", 1), (8, "Apache-2.0", 1)]
    assert got == sorted(want, key=str)
    assert licenses.licenses(docs.limit(0)).count() == 0


def test_notices_inside_lines_and_over_line_breaks(spark):
    mit = "Intro.\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction.\nThe story begins here and has nothing to do with it at all, for many words more than the notice itself has."
    rows = [
        (1, "Copyright 2020 Foo. Released under the MIT License."),
        (2, "Copyright (c) 2024 Acme. All rights reserved."),
        (3, mit),
        (4, "A story of many words.\nThis work is licensed under the GNU General Public License,\nversion 3. And now the story goes on with many more words."),
        (5, "Foo is released under the MIT License. Bar is licensed under CC BY 4.0, baz is released under the MIT License as well."),
        (6, "The license of the software is not known, and rights are all reserved."),
    ]
    got = {r.doc_id: (r.licenses, r.n_matches) for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("Proprietary", 1), 3: ("MIT", 1), 4: ("GPL-3.0", 1), 5: ("CC-BY-4.0,MIT", 3), 6: ("", 0)}


def test_whole_license_texts(spark):
    bsd = "Copyright (c) 2021, Foo\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    name = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    end = "\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    isc = "Copyright 2020 Foo\n\nPermission to use, copy, modify, and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"."
    agpl = "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\n  The GNU Affero General Public License is a free, copyleft license for\nsoftware and other kinds of works, specifically designed to ensure\ncooperation with the community in the case of network server software."
    free = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n\nFor more information see the site."
    gpl2 = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\nIt comes without any warranty."
    rows = [(1, bsd + end), (2, bsd + name + end), (3, isc), (4, agpl), (5, free), (6, gpl2), (7, "Text: licensed under CC BY-ND 4.0."), (8, "A note released under CC0 1.0 Universal.")]
    got = [r.licenses for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["BSD-2-Clause", "BSD-3-Clause", "ISC", "AGPL-3.0", "Unlicense", "GPL-2.0", "CC-BY-ND-4.0", "CC0-1.0"]


def test_every_whole_text_holds_a_keyword():
    pairs = [licenses._pairs(text) for _, text in licenses.KNOWN]
    words = set(licenses.keywords(pairs, licenses.PERCENT))
    for own in pairs:
        assert sum(bool(set(p.split()) & words) for p in own) > len(own) - -(-licenses.PERCENT * len(own) // (200 - licenses.PERCENT))


def test_every_match_holds_a_keyword():
    pairs = [licenses._pairs(text) for _, text in licenses.TEMPLATES]
    words = set(licenses.keywords(pairs, licenses.PERCENT))
    assert len(words) < 25
    for own in pairs:
        least = -(-licenses.PERCENT * len(own) // (200 - licenses.PERCENT))
        # The match that holds the fewest keywords leaves out as many bigrams with one as it may.
        assert sum(bool(set(p.split()) & words) for p in own) > len(own) - least


def best_windows(text, templates, percent):
    """The highest coefficient of any window with each template, where it is high enough."""
    own = list(map(" ".join, zip(licenses._words(text), licenses._words(text)[1:])))
    out = {}
    for k, template in enumerate(templates):
        pairs, span = set(licenses._pairs(template)), (len(licenses._words(template)) - 1) * (200 - percent) // percent
        for lo in range(len(own)):
            seen = set()
            for pair in own[lo : lo + span]:
                seen.add(pair)
                if 200 * len(seen & pairs) >= percent * (len(seen) + len(pairs)):
                    out[k] = max(out.get(k, 0), 2 * len(seen & pairs) / (len(seen) + len(pairs)))
    return out


def test_windows_equal_all_windows(spark):
    rng = random.Random(9)
    templates = [t for _, t in licenses.KNOWN if len(t) < 260]
    filler = "the work file is here and rights to use of software are not known version public license".split()
    docs = []
    for i in range(60):
        words = [rng.choice(filler) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            told = licenses._words(rng.choice(templates))
            told = [w for w in told if rng.random() > 0.04]
            for _ in range(rng.randrange(3)):
                told.insert(rng.randrange(len(told) + 1), rng.choice(filler))
            at = rng.randrange(len(words) + 1)
            words[at:at] = told
        docs.append((i, "".join(w + rng.choice([" ", " ", ", ", "\n"]) for w in words)))
    # A very long text with a notice at its end.
    docs.append((60, "a word of the file\n" * 60_000 + "Released under\nthe MIT License."))
    short = tuple((str(k), t) for k, t in enumerate(templates))
    known = [(name, licenses._pairs(t), len(licenses._words(t)) - 1) for name, t in short]
    need, span = (lambda n: -(-80 * n // 120)), (lambda n: n * 120 // 80)
    listed = F.array(*(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, pairs)).alias("pairs"), F.lit(need(len(pairs))).alias("need"), F.lit(span(n)).alias("span")) for name, pairs, n in known))
    every = F.array(*(F.lit(p) for p in sorted({p for _, pairs, _ in known for p in pairs})))
    found = licenses._windows(spark.createDataFrame(docs, "doc_id long, text string"), listed, every, 80)
    got = {(r.doc_id, int(r.license)): round(r.dice, 9) for r in found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice")).collect()}
    want = {(i, k): round(d, 9) for i, text in docs[:60] for k, d in best_windows(text, templates, 80).items()}
    assert {k: v for k, v in got.items() if k[0] < 60} == want and len(want) > 40
    mit = templates.index("Released under the MIT License.")
    assert got[60, mit] == 1.0
    assert [r.licenses for r in licenses.licenses(spark.createDataFrame(docs[60:], "doc_id long, text string")).collect()] == ["MIT"]
