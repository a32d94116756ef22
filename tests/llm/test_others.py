"""Search, mixing, licences, byte-level BPE and the pipeline."""

from __future__ import annotations

import math
import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderweave.llm import byte_bpe, collision_search, exact_search, licenses, mixing, registry, vectors
from tests.llm import brute


def vector_rows(n=400, dim=8, seed=0):
    rng = np.random.RandomState(seed)
    rows = [(i, [float(x) for x in rng.randn(dim)], "clash", 1) for i in range(n)]
    rows[7] = (7, rows[100][1], "copy", 1)
    rows += [(500, None, "", 1), (501, [0.0] * dim, "", 1), (502, [float("nan")] * dim, "", 1), (503, [None] + [1.0] * (dim - 1), "", 1), (504, [1.0] * (dim + 1), "", 1), (None, [1.0] * dim, "", 1), (550, [math.inf] * dim, "", 1)]
    return rows


def clean(rows, zero=True):
    return [(i, v) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


@pytest.mark.parametrize("shard", [50, 2048])
def test_exact_search(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors.dealt, "__defaults__", (shard, 3))
    rows = vector_rows()
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>, score string, dim int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_search.top_k(df).collect()}
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e in clean(rows)]
    want = set()
    for q, e in v:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in v if i != q and len(f) == len(e))
            want |= {(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:5])}
    assert got == want


def test_collision_search(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "SHARD", 120)
    rows = vector_rows(600)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, dim int")
    got = collision_search.nearest(df).collect()
    v = {i: np.array([np.float32(x) for x in e], float) for i, e in clean(rows, zero=False)}
    hits = total = 0
    for q in v:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:10]
            own = [r for r in got if r.query_id == q]
            assert [r["rank"] for r in sorted(own, key=lambda r: (r.score, r.vec_id))] == list(range(1, len(own) + 1))
            assert all(abs(r.score - float(np.sqrt(((v[q] - v[r.vec_id]) ** 2).sum()))) < 1e-12 for r in own)
            hits, total = hits + len({r.vec_id for r in own} & {i for _, i in near}), total + len(near)
    assert hits >= 0.9 * total


def test_scores_beyond_64_bits(spark):
    """Large components are multiplied exactly; what 64 bits can't hold is given as the nearest that they can."""
    rows = [(0, [3e12, 1.0]), (1, [2e12, 5.0]), (2, [1.0, 1.0]), (3, [-4e12, 0.0])]
    got = [(r["rank"], r.vec_id, r.score) for r in exact_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert sorted(got) == [(1, 1, 2**63 - 1), (2, 2, 256 * 3 * 10**12 * 256 + 65536), (3, 3, -(2**63) + 1)]


def test_distances_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [1.0, 1e200]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in collision_search.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 0.0), (0, 2, 1, float("inf")), (0, 3, 2, float("inf"))]


def test_shards_follow_from_the_rows_alone(spark):
    df = vectors.vectors(spark.range(9000).selectExpr("id as vec_id", "array(cast(id as double), 1.0D) as embedding"), "vec_id", "embedding")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in ("3", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.add(vectors.dealt(df, 100)[2:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {(5, 1)}


def test_empty_searches(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_search.top_k(none).count() == collision_search.nearest(none).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert exact_search.top_k(one).count() == collision_search.nearest(one).count() == 0


def mixed_rows():
    rng = random.Random(1)
    sizes = {"a": 40, "b": 300, "c": 60, None: 20, "dé": 5}
    return [(k, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 80))), s, "clash") for k, s in enumerate(x for x, n in sizes.items() for _ in range(n))] + [(9000, None, "a", ""), (9001, "", "zero", ""), (9002, "one two", "b", ""), (9002, "one two", "b", "")]


def test_mixing(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(5)).collect()
    pick = lambda rs: sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rs)
    assert pick(got) == pick(again) and len(got) == len(rows)
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len(brute.WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in full)) / max(1, sum(weight[s] for s in order if s not in full))
        over = {s for s in order if s not in full and level * weight[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * size[s] if s in full else level * weight[s] for s in order}
    source = {k: s for k, _, s, _ in rows}
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 40) for s in order)


def test_apportionment_is_sainte_lague(spark):
    claims = {"a": 53, "b": 24, "c": 23, "d": 0, "e": 7}
    cells = spark.createDataFrame([(1, k, v, 11) for k, v in claims.items()], "g int, k string, claim long, seats long")
    got = {r.k: r.won for r in mixing.apportioned(cells, "g", ["k"], "claim", "seats", "won").collect()}
    quotients = sorted((-v / (2 * s + 1), k) for k, v in claims.items() for s in range(11) if v)[:11]
    assert got == {k: sum(x == k for _, x in quotients) for k in claims}


def test_mixing_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mixing.mix_sources(spark.createDataFrame([(1, None, None)], schema)).collect()] == [0]


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."
    texts = ["Words.\nReleased under the MIT License.", "no stop\nLicensed under CC BY-NC 4.0.\nmore", mit, "This work is licensed under the GNU General Public License, version 3. Released under the MIT License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", None, "", "a license", "SPDX-License-Identifier: Apache-2.0", "x " * 50000 + "\nReleased under the MIT License."]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: (r.identifiers, r.licenses, r.license) for r in licenses.scan(df).collect()}
    assert got == {0: ("MITref", "MIT", "MIT"), 1: ("CCBYNC4ref", "CC-BY-NC-4.0", "CC-BY-NC-4.0"), 2: ("MITgrant,MITnotice", "MIT", "MIT"), 3: ("GPL3ref,MITref", "GPL-3.0-only,MIT", "GPL-3.0-only"), 4: ("BSDgrant", "", "unknown"), 5: ("", "", None), 6: ("", "", None), 7: ("", "", None), 8: ("Apache2ref", "Apache-2.0", "Apache-2.0"), 9: ("MITref", "MIT", "MIT")}
    assert all(any(h in s for h in licenses.hints(licenses.SENTENCES)) for s in licenses.SENTENCES)
    own = licenses.scan(df.limit(0).union(spark.createDataFrame([(1, "Take it! Or don't.", "")], df.schema)), sentences={"take it": "Take"}, rules=[("Mine", ["Take"], [])]).collect()
    assert [(r.identifiers, r.license) for r in own] == [("Take", "Mine")]
    assert licenses.scan(df.where("false")).count() == 0 and [r.license for r in licenses.scan(df.where("doc_id = 0"), sentences={}, rules=[]).collect()] == [None]
    assert {n for _, must, never in licenses.RULES for n in must + never} <= set(licenses.SENTENCES.values())


def test_queries_have_their_names():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_key", F.lit("clash")).withColumn("score", F.lit(1))
    kept, columns = docs, docs.columns
    sizes = []
    for name, stage in cp.STAGES:
        stage(spark, kept, sf).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        sizes.append(kept.count())
        if name != "tokens":
            assert kept.columns == columns
    read = lambda n: [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / n)).select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = {i for i, _ in read("quality")}
    assert sum(1 for i, q in labels.items() if q == 1 and i not in first) <= 2 and sum(1 for i, q in labels.items() if q == 0 and i in first) <= 2
    assert {i for i, _ in read("near_duplicates")} == {i for i, _, _, keep in brute.near_dedup(read("quality"), 5, 80) if keep}
    plain = {i: (w, gone) for i, w, gone, _ in brute.substring_dedup(read("near_duplicates"))}
    after = dict(read("substrings"))
    assert all(len(brute.WORD.findall(after[i] or "")) == w - gone for i, (w, gone) in plain.items())
    words, mixed = {i: len(brute.WORD.findall(t or "")) for i, t in after.items()}, {}
    for i, t in read("mixture"):
        mixed[i] = mixed.get(i, 0) + len(brute.WORD.findall(t))
    plan = {r.doc_id: r.taken for r in mixing.mix_sources(spark.read.parquet(str(tmp_path / "substrings"))).collect()}
    assert {i: n for i, n in plan.items() if n} == mixed and all(n <= 3 * words[i] for i, n in mixed.items())
    tokens = spark.read.parquet(str(tmp_path / "tokens"))
    _, ids = brute.encoded("", byte_bpe.RANKS, byte_bpe.PATTERN)
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in tokens.collect()) == sorted((i, ids(t)) for i, t in read("mixture"))


def test_pipeline_with_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, a very long text, clashing names, and no rows at all."""
    import corpus_pipeline as cp

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    one = text(60)
    rows = [(k, text(80), "en", f"s{k % 3}", 1) for k in range(30)] + [(1000, one, "en", "s0", 1)] * 3 + [(1001, one, "en", "s1", 1), (3, text(50), None, None, None), (None, text(70), "en", "s1", 2), (None, None, None, None, None), (40, None, "en", "s0", 0), (41, "", None, "s0", 0), (42, " \n", "en", None, 3), (43, text(90_000), "en", "s2", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "clash", 1, "clash", True, 2) for r in rows], schema + ", block string, score int, row string, kept boolean, size int")
    labels = [(k, int(k % 2 == 0), 0) for k in range(30)] + [(None, 1, 1), (5, None, None)]
    folder = tmp_path / "sf"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    for name, start in (("some", docs), ("none", docs.where("false"))):
        at, columns = start, start.columns
        for k, (stage, f) in enumerate(cp.STAGES):
            f(spark, at, str(folder)).write.parquet(str(tmp_path / name / stage))
            at = spark.read.parquet(str(tmp_path / name / stage))
            assert at.columns == columns or k == len(cp.STAGES) - 1
            assert name == "none" or at.count() > 20, stage
        if name == "none":
            assert at.count() == 0
    near = spark.read.parquet(str(tmp_path / "some" / "near_duplicates"))
    kept = {r.doc_id for r in near.collect()}
    assert 1001 not in kept and {1000, 43} <= kept and near.where("doc_id is null").count() >= 1
    tokens = spark.read.parquet(str(tmp_path / "some" / "tokens")).collect()
    assert all(r.n_tokens > 0 and len(r.ids) == 4 * r.n_tokens for r in tokens)


MIT_TEXT = ["MIT License", "Copyright (c) 2020 Somebody", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."]
BSD_TEXT = ["Copyright (c) 2020, Somebody", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
BSD_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_ADVERT = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\nThis product includes software developed by Somebody."
APACHE_TEXT = ["Copyright 2020 Somebody", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS."]
GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GPL_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
LESSER = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
FSF = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
NOTICES = [
    (MIT_TEXT, "MITgrant,MITnotice,MITwarranty", "MIT"),
    (["Copyright (c) 2020 Somebody", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."], "ISCgrant", "ISC"),
    (BSD_TEXT, "BSDgrant,BSDsource,BSDbinary", "BSD-2-Clause"),
    ([*BSD_TEXT, BSD_ENDORSE], "BSDgrant,BSDsource,BSDbinary,BSDendorse", "BSD-3-Clause"),
    ([*BSD_TEXT, BSD_ADVERT, BSD_ENDORSE.replace("3.", "4.")], "BSDgrant,BSDsource,BSDbinary,BSDadvert,BSDendorse", "BSD-4-Clause"),
    ([x.replace("1. ", "(1) ").replace("2. ", "b) ") if x[1:3] == ". " else x for x in BSD_TEXT], "BSDgrant,BSDsource,BSDbinary", "BSD-2-Clause"),
    (APACHE_TEXT, "Apache2head,Apache2copy", "Apache-2.0"),
    (["Copyright (C) 2020 Somebody", GPL.format(";", 2), GPL_WARRANTY], "GPL2plus,GPLwarranty", "GPL-2.0-or-later"),
    (["Copyright (C) <year>  <name of author>", GPL.format(":", 3), GPL_WARRANTY], "GPL3plus,GPLwarranty", "GPL-3.0-or-later"),
    (["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."], "MPL2ref", "MPL-2.0"),
    (["This is free and unencumbered software released into the public domain.", "Anyone is free to copy it."], "Unlicense", "Unlicense"),
    *(([f"This work is licensed under the GNU General Public License, version {v}."], f"GPL{v}ref", f"GPL-{v}.0-only") for v in (2, 3)),
    *(([f"Licensed under {x}."], y, z) for x, y, z in (("CC BY 4.0", "CCBY4ref", "CC-BY-4.0"), ("CC BY-SA 4.0", "CCBYSA4ref", "CC-BY-SA-4.0"), ("CC BY-NC 4.0", "CCBYNC4ref", "CC-BY-NC-4.0"), ("CC BY-ND 4.0", "CCBYND4ref", "CC-BY-ND-4.0"), ("CC0 1.0", "CC0ref", "CC0-1.0"), ("the Apache License, Version 2.0", "Apache2ref", "Apache-2.0"), ("the MIT License", "MITref", "MIT"))),
    *(([f"SPDX-License-Identifier: {x}", "int main() {}"], y, z) for x, y, z in (("MIT", "MITref", "MIT"), ("BSD-2-Clause", "BSD2ref", "BSD-2-Clause"), ("BSD-3-Clause", "BSD3ref", "BSD-3-Clause"), ("Apache-2.0", "Apache2ref", "Apache-2.0"), ("GPL-2.0-only", "GPL2ref", "GPL-2.0-only"), ("GPL-3.0-only", "GPL3ref", "GPL-3.0-only"), ("MPL-2.0", "MPL2ref", "MPL-2.0"))),
    (["All rights reserved under copyright law."], "Reserved", "all-rights-reserved"),
    *(([f"SPDX-License-Identifier: {x}", "int main() {}"], y, z) for x, y, z in (("ISC", "ISCref", "ISC"), ("0BSD", "0BSDref", "0BSD"), ("GPL-2.0-or-later", "GPL2plus", "GPL-2.0-or-later"), ("LGPL-2.1-only", "LGPL21ref", "LGPL-2.1-only"), ("LGPL-3.0-only", "LGPL3ref", "LGPL-3.0-only"), ("LGPL-3.0-or-later", "LGPL3plus", "LGPL-3.0-or-later"), ("AGPL-3.0-only", "AGPL3ref", "AGPL-3.0-only"), ("EPL-2.0", "EPL2ref", "EPL-2.0"), ("BSL-1.0", "BSL1ref", "BSL-1.0"), ("Zlib", "Zlibref", "Zlib"), ("MIT OR Apache-2.0", "MITorApache2", "MIT OR Apache-2.0"))),
    (["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."], "0BSDgrant", "0BSD"),
    ([LESSER.format("library", ";", "Lesser ", ";", "2.1"), "This library is distributed in the hope that it will be useful."], "LGPL21plus", "LGPL-2.1-or-later"),
    ([LESSER.format("program", ":", "Affero ", ",", "3")], "AGPL3plus", "AGPL-3.0-or-later"),
    (["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."], "GPL2ref", "GPL-2.0-only"),
    (["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"], "EPL2ref", "EPL-2.0"),
    (["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"], "BSL1ref", "BSL-1.0"),
    (["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"], "BSL1grant", "BSL-1.0"),
    (["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."], "Zlibwarranty,Zlibgrant,Zlibaltered", "Zlib"),
    ([*APACHE_TEXT[:3], "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."], "Apache2head,Apache2copy,Apache2warranty", "Apache-2.0"),
    (["\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."], "Apache2text", "Apache-2.0"),
    ([FSF, "The GNU General Public License is a free, copyleft license for software and other kinds of works.", GPL.format(":", 3)], "FSFcopy,GPL3preamble,GPL3plus", "GPL-3.0-only"),
    ([FSF, "This General Public License does not permit incorporating your program into proprietary programs."], "FSFcopy,GPL2text", "GPL-2.0-only"),
    ([FSF, "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."], "FSFcopy,AGPL3preamble", "AGPL-3.0-only"),
]


def test_published_notices(spark):
    """Each, wrapped at some widths or not at all, with and without blank lines, plain and commented."""
    rows, want = [], {}
    for paragraphs, found, license in NOTICES:
        for width in (40, 60, 72, 79, 10000):
            for blank in (True, False):
                lines = [line for p in paragraphs for line in [*(x for part in p.split("\n") for x in [part] * part.startswith("SPDX") or textwrap.wrap(part, width, break_on_hyphens=False, break_long_words=False)), *([""] if blank else [])]]
                for first, mark, last in (("", "", ""), ("/*", " * ", " */"), ("#", "# ", "#"), ("", "//", ""), ("--", "-- ", "--"), ("", ";; ", "")):
                    want[len(rows)] = (found, license)
                    rows.append((len(rows), "\n".join([first, *((mark + x).rstrip() for x in lines), last])))
    assert {y for _, found, _ in NOTICES for y in found.split(",")} == set(licenses.SENTENCES.values())
    got = {r.doc_id: (r.identifiers, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [(rows[k][1], got[k], want[k]) for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), len(rows), wrong[:3])
