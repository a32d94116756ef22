"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences: at blank lines, and after . ! ? before white space; marks of
comments at the start of lines don't count. What isn't known as a whole is cut further, step
by step, until it is: around copyright lines, titles, addresses and list numbers, then after
colons, then into lines, as notices often stand on lines of their own. Normalised
(lower case, runs of anything but letters, digits, + - and inner full stops as one space), a
sentence that is in `SENTENCES` becomes its identifier; others vanish. The identifiers of a
text, in order, are matched against `RULES`: a rule names a license, the identifiers that
must follow each other, others allowed in between, and those that must not occur. Rules are
ordered; a text's first license is the first rule that it matches, and all are listed.

All this happens within a row, so nothing is shuffled. Only sentences with a hint are
normalised: a few words are chosen from the table given, one of which is in each of its sentences.

Cases: null and empty texts have no identifiers and no license (null); a text with
identifiers but no matching rule has the license `unknown`; rows may repeat: a row for each row;
a very long text is read as a whole; an empty table gives none; other columns of the input
aren't read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised, and their identifiers.
SENTENCES: dict[str, str] = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "spdx-license-identifier mit": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITwarranty",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDendorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSDadvert",
    "spdx-license-identifier bsd-2-clause": "BSD2ref",
    "spdx-license-identifier bsd-3-clause": "BSD3ref",
    "licensed under the apache license version 2.0": "Apache2ref",
    "licensed under the apache license version 2.0 the license": "Apache2ref",
    "spdx-license-identifier apache-2.0": "Apache2ref",
    "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license": "Apache2head",
    "you may obtain a copy of the license at": "Apache2copy",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "spdx-license-identifier gpl-2.0-only": "GPL2ref",
    "spdx-license-identifier gpl-3.0-only": "GPL3ref",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLwarranty",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "MPL2ref",
    "spdx-license-identifier mpl-2.0": "MPL2ref",
    "licensed under cc by 4.0": "CCBY4ref",
    "licensed under cc by-sa 4.0": "CCBYSA4ref",
    "licensed under cc by-nc 4.0": "CCBYNC4ref",
    "licensed under cc by-nd 4.0": "CCBYND4ref",
    "licensed under cc0 1.0": "CC0ref",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved under copyright law": "Reserved",
    "spdx-license-identifier isc": "ISCref",
    "spdx-license-identifier 0bsd": "0BSDref",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted": "0BSDgrant",
    "spdx-license-identifier gpl-2.0-or-later": "GPL2plus",
    "spdx-license-identifier gpl-3.0-or-later": "GPL3plus",
    "spdx-license-identifier lgpl-2.1-only": "LGPL21ref",
    "spdx-license-identifier lgpl-2.1-or-later": "LGPL21plus",
    "spdx-license-identifier lgpl-3.0-only": "LGPL3ref",
    "spdx-license-identifier lgpl-3.0-or-later": "LGPL3plus",
    "spdx-license-identifier agpl-3.0-only": "AGPL3ref",
    "spdx-license-identifier agpl-3.0-or-later": "AGPL3plus",
    "spdx-license-identifier epl-2.0": "EPL2ref",
    "spdx-license-identifier bsl-1.0": "BSL1ref",
    "spdx-license-identifier zlib": "Zlibref",
    "spdx-license-identifier unlicense": "Unlicense",
    "spdx-license-identifier cc0-1.0": "CC0ref",
    "spdx-license-identifier mit or apache-2.0": "MITorApache2",
    "spdx-license-identifier apache-2.0 or mit": "MITorApache2",
    "this library is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "LGPL21plus",
    "this library is free software you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3plus",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3plus",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "GPL2ref",
    "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL2ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at": "EPL2ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which accompanies this distribution and is available at": "EPL2ref",
    "distributed under the boost software license version 1.0": "BSL1ref",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following": "BSL1grant",
    "this software is provided as-is without any express or implied warranty": "Zlibwarranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "Zlibgrant",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "Zlibaltered",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "Apache2warranty",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "FSFcopy",
    "this general public license does not permit incorporating your program into proprietary programs": "GPL2text",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "GPL3preamble",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "AGPL3preamble",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "Apache2text",
}

#: License, identifiers that follow each other, identifiers that must not occur.
RULES: list[tuple[str, list[str], list[str]]] = [
    ("AGPL-3.0-only", ["FSFcopy", "AGPL3preamble"], []),
    ("GPL-3.0-only", ["FSFcopy", "GPL3preamble"], []),
    ("GPL-2.0-only", ["FSFcopy", "GPL2text"], []),
    ("Apache-2.0", ["Apache2text"], []),
    ("MIT", ["MITgrant", "MITnotice", "MITwarranty"], []),
    ("MIT", ["MITgrant", "MITnotice"], ["MITwarranty"]),
    ("ISC", ["ISCgrant"], []),
    ("BSD-4-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDadvert"], []),
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"], ["BSDadvert"]),
    ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary"], ["BSDadvert", "BSDendorse"]),
    ("BSD-3-Clause", ["BSD3ref"], ["BSDgrant"]),
    ("BSD-2-Clause", ["BSD2ref"], ["BSDgrant"]),
    ("Apache-2.0", ["Apache2head", "Apache2copy"], []),
    ("Apache-2.0", ["Apache2head"], ["Apache2copy"]),
    ("Apache-2.0", ["Apache2ref"], ["Apache2head"]),
    ("GPL-3.0-or-later", ["GPL3plus"], []),
    ("GPL-2.0-or-later", ["GPL2plus"], []),
    ("GPL-3.0-only", ["GPL3ref"], []),
    ("GPL-2.0-only", ["GPL2ref"], []),
    ("MPL-2.0", ["MPL2ref"], []),
    ("MIT", ["MITref"], ["MITgrant"]),
    ("CC-BY-4.0", ["CCBY4ref"], []),
    ("CC-BY-SA-4.0", ["CCBYSA4ref"], []),
    ("CC-BY-NC-4.0", ["CCBYNC4ref"], []),
    ("CC-BY-ND-4.0", ["CCBYND4ref"], []),
    ("CC0-1.0", ["CC0ref"], []),
    ("Unlicense", ["Unlicense"], []),
    ("all-rights-reserved", ["Reserved"], []),
    ("ISC", ["ISCref"], ["ISCgrant"]),
    ("0BSD", ["0BSDgrant"], []),
    ("0BSD", ["0BSDref"], ["0BSDgrant"]),
    ("MIT OR Apache-2.0", ["MITorApache2"], []),
    ("AGPL-3.0-or-later", ["AGPL3plus"], []),
    ("AGPL-3.0-only", ["AGPL3ref"], []),
    ("LGPL-3.0-or-later", ["LGPL3plus"], []),
    ("LGPL-3.0-only", ["LGPL3ref"], []),
    ("LGPL-2.1-or-later", ["LGPL21plus"], []),
    ("LGPL-2.1-only", ["LGPL21ref"], []),
    ("EPL-2.0", ["EPL2ref"], []),
    ("BSL-1.0", ["BSL1grant"], []),
    ("BSL-1.0", ["BSL1ref"], ["BSL1grant"]),
    ("Zlib", ["Zlibwarranty", "Zlibgrant", "Zlibaltered"], []),
    ("Zlib", ["Zlibgrant"], ["Zlibaltered"]),
    ("Zlib", ["Zlibref"], ["Zlibgrant"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For both dialects of regular expressions.
_END = r"([.!?])[ \t\r\n]+|\n[ \t\r]*\n"
_OTHER = r"[^a-z0-9.+/-]+|[.]+([^a-z0-9]|$)"
_EDGES = r"^[ ./+-]+|[ ./+-]+$"
#: For Spark only: marks of comments, the stop of "v. 2.0" (no end of a sentence), and where unknown sentences are cut further.
_COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|--+|;+)[ \t]*"
_VERSION = r"(?i)\bv\.[ \t\r\n]*(?=[0-9])"
_ALONE = r"(?:copyright[ \t]+(?:\(c\)|\u00a9|[0-9]{4}|[<\[])|\(c\)|\u00a9|all rights reserved|spdx-license-identifier)[^\n]*"
_TITLE = r"[a-z0-9 .,\"-]{0,60}licen[cs]e[ \t]*(?:(?:version[ \t]+|v)?[0-9.]+)?[ \t]*(?:\([^)\n]*\))?[ \t\r]*"
_NUMBER = r"[ \t]*\(?(?:[0-9]{1,2}[.)]|[a-z]\))(?=[ \t\r\n]|$)"
_PIECE = rf"(?i)(?<=\n|^)[ \t]*{_ALONE}\n|\n(?=[ \t]*{_ALONE})|^{_TITLE}\n|\n(?={_NUMBER})|\s+(?=<?https?://)|<?https?://\S+\s+"
_PART = r"(?i)(?<!identifier):[ \t\r\n]+"


def _normal(sentence: Column) -> Column:
    low = F.translate(sentence, UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(low, _OTHER, " "), " +", " "), _EDGES, "")


def hints(sentences: dict[str, str]) -> list[str]:
    """Words of which each sentence has one: again and again the word that most of those without one have, longer ones first."""
    rest, out = {frozenset(k.split(" ")) for k in sentences}, []
    while rest:
        found = Counter(w for words in rest for w in words if w)
        if not found:
            break
        out.append(max(found, key=lambda w: (len(w) > 4, found[w], len(w), w)))
        rest = {words for words in rest if out[-1] not in words}
    return out


def _hinted(text: Column, sentences: dict[str, str]) -> Column:
    return text.rlike("(?i)" + "|".join(map(re.escape, hints(sentences)))) if sentences else F.lit(False)


def _must(names: list[str]) -> str:
    return "".join(f",{n}(,.*)?" for n in names) + ","


def _may_not(names: list[str]) -> str:
    return ",(" + "|".join(names) + "),"


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Array of the identifiers of a text's known sentences, in order."""
    if not sentences:
        return F.array().cast("array<string>")
    known = F.create_map(*(x for k, v in sentences.items() for x in (F.lit(re.sub(_VERSION, "v ", k)), F.array(F.lit(v)))))
    units = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _COMMENT, ""), _VERSION, "v "), _END, "$1\u0001"), "\u0001")

    # A sentence is looked up whole and, if unknown, in ever smaller divisions.
    def looked_up(s: Column, *cuts: Callable[[Column], Column]) -> Column:
        found = F.try_element_at(known, _normal(F.regexp_replace(s, rf"(?i)^\s*{_NUMBER}", "")))
        return F.coalesce(found, over(cuts[0](s), *cuts[1:]) if cuts else F.array().cast("array<string>"))

    def over(divided: Column, *cuts: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(F.filter(divided, lambda s: _hinted(s, sentences)), lambda s: looked_up(s, *cuts)))

    pieces = lambda s: F.split(F.regexp_replace(s, _PIECE, "$0\u0001"), "\u0001")
    found = over(units, pieces, lambda s: F.split(s, _PART), lambda s: F.split(s, "\n"))
    return F.coalesce(found, F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list = RULES) -> DataFrame:
    """Columns id_col, n_sentences (known ones), identifiers and licenses (joined by commas), license (the first). A row for each row of docs."""
    text = F.col(text_col).cast("string")
    maybe = F.when(_hinted(text, sentences), text)
    rows = docs.select(F.col(id_col).alias("id"), identifiers(maybe, sentences).alias("found"))
    rows = rows.select("id", F.size("found").cast("long").alias("n"), F.array_join("found", ",").alias("found"))
    seq = F.concat(F.lit(","), F.regexp_replace("found", ",", ",,"), F.lit(","))
    named = F.array_compact(F.array(*(F.when(seq.rlike(_must(must)) & (~seq.rlike(_may_not(never)) if never else F.lit(True)), F.lit(name)) for name, must, never in rules)))
    rows = rows.withColumn("named", F.when(F.col("n") > 0, named))
    first = F.when(F.col("n") > 0, F.coalesce(F.get("named", F.lit(0)), F.lit("unknown")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_sentences"), F.col("found").alias("identifiers"), F.coalesce(F.array_join("named", ","), F.lit("")).alias("licenses"), first.alias("license"))


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    pairs = ", ".join(f"({text(k)}, {text(v)})" for k, v in SENTENCES.items())
    cases = ", ".join(f"CASE WHEN regexp_matches(seq, {text(_must(must))})" + (f" AND NOT regexp_matches(seq, {text(_may_not(never))})" if never else "") + f" THEN {text(name)} END" for name, must, never in RULES)

    def normal(x: str) -> str:
        return f"regexp_replace(regexp_replace(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), {text(_OTHER)}, ' ', 'g'), ' +', ' ', 'g'), {text(_EDGES)}, '', 'g')"

    return f"""
WITH known(sentence, name) AS (VALUES {pairs}),
units AS (SELECT doc_id, rid, i, u FROM (SELECT doc_id, rid, unnest(us) AS u, unnest(range(len(us))) AS i FROM
  (SELECT doc_id, row_number() OVER () AS rid, string_split(regexp_replace(text, {text(_END)}, '\\1' || chr(1), 'g'), chr(1)) AS us FROM documents WHERE text IS NOT NULL))),
whole AS (SELECT rid, i, u, k.name FROM units LEFT JOIN known k ON k.sentence = {normal("u")}),
lines AS (SELECT rid, i, unnest(ls) AS l, unnest(range(len(ls))) AS j FROM (SELECT rid, i, string_split(u, chr(10)) AS ls FROM whole WHERE name IS NULL AND contains(u, chr(10)))),
hits AS (SELECT rid, i, 0 AS j, name FROM whole WHERE name IS NOT NULL UNION ALL SELECT rid, i, j, k.name FROM lines JOIN known k ON k.sentence = {normal("l")}),
seqs AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY i, j) AS ids FROM hits GROUP BY rid),
docs AS (SELECT doc_id, row_number() OVER () AS rid FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL),
marked AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, ',' || replace(coalesce(ids, ''), ',', ',,') || ',' AS seq FROM docs LEFT JOIN seqs USING (rid)),
named AS (SELECT doc_id, n, ids, list_filter([{cases}], lambda x: x IS NOT NULL) AS ls FROM marked)
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS identifiers, coalesce(CASE WHEN n > 0 THEN array_to_string(ls, ',') END, '') AS licenses,
  CASE WHEN n > 0 THEN coalesce(ls[1], 'unknown') END AS license FROM named
"""


SQL = _sql()
