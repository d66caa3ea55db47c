"""License scans (operator 9) by sentence rules.

A text is cut at line feeds and after . ! ? with white space, comment and list marks are left out, and what is left is lower-cased and
reduced to its letters and digits. Pieces that follow each other and together are the longest known sentence are one sentence, however
its lines are broken. Normalised sentences that are known have an identifier. A rule is an order of identifiers that stands for a licence; it
matches where they follow each other with at most GAP other sentences in between. Longer rules are tried first, and a sentence
counts for one match only.

Nulls and edge cases: a null or empty text has no sentences and no match; rows that repeat are scanned each; a null doc_id is kept;
an empty table gives no row. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common

GAP = 1
CUT = re.compile(r"\n+|(?<=[.!?])\s+|(?<=following conditions:)\s+|(?<=conditions are met:)\s+", re.IGNORECASE)
#: What a line or a piece may begin with: a comment mark, then a list mark.
MARKS = re.compile(r"^\s*(?:(?:dnl|rem|REM)\s+)?[^\w(]*(?:(?:\(?\d{1,2}[.)]|\(?(?:[a-h]|[ivx]{1,4})\))(?:\s+|$))?")
ALNUM = re.compile(r"[^\W_]+")
# Names of licences by SPDX identifier.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "ISC": ["ISC License", "ISC"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
THINGS = ["", "This work is", "This software is", "This program is", "This project is", "This file is", "This code is", "This document is", "It is"]
VERBS = ["licensed", "released", "distributed", "available", "published", "provided", "made available"]
JOINS = ["under", "under the", "under the terms of", "under the terms of the"]
# Sentences of licence texts and headers.
BODIES = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache.comply": "you may not use this file except in compliance with the License.",
    "apache.obtain": "You may obtain a copy of the License at",
    "apache.basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gnu.free2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gnu.free3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gnu.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd.redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gnu.lesser2": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "gnu.lesser3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gnu.affero3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "reserved": "All rights reserved.",
}
#: (rule, licence, identifiers in order); longer first.
ORDERS = [
    ("mit.text", "MIT", ["mit.grant", "mit.notice", "mit.warranty"]),
    ("bsd3.text", "BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("bsd2.text", "BSD-2-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary"]),
    ("apache2.header", "Apache-2.0", ["notice.Apache-2.0", "apache.comply", "apache.obtain"]),
    ("apache2.basis", "Apache-2.0", ["notice.Apache-2.0", "apache.basis"]),
    ("gpl3.header", "GPL-3.0", ["gnu.free3", "gnu.hope"]),
    ("gpl2.header", "GPL-2.0", ["gnu.free2", "gnu.hope"]),
    ("apache2.header", "Apache-2.0", ["apache.licensed", "apache.obtain"]),
    ("apache2.grant", "Apache-2.0", ["apache.licensed"]),
    ("lgpl2.grant", "LGPL-2.1", ["gnu.lesser2"]),
    ("lgpl3.grant", "LGPL-3.0", ["gnu.lesser3"]),
    ("agpl3.grant", "AGPL-3.0", ["gnu.affero3"]),
    ("mpl2.grant", "MPL-2.0", ["mpl.terms"]),
    ("gpl3.grant", "GPL-3.0", ["gnu.free3"]),
    ("gpl2.grant", "GPL-2.0", ["gnu.free2"]),
    ("mit.grant", "MIT", ["mit.grant"]),
    ("isc.grant", "ISC", ["isc.grant"]),
    *((f"notice.{x}", x, [f"notice.{x}"]) for x in NAMES),
]


def normalised(sentence: str) -> str:
    return " ".join(ALNUM.findall(sentence.lower()))


def sentences(text: str | None) -> list[str]:
    """Pieces, with those joined that together are a known sentence; the longest counts."""
    pieces = [s for s in (normalised(MARKS.sub("", p, count=1)) for p in CUT.split(text)) if s] if text else []
    known, begun = known_sentences(), _begun()
    out, at = [], 0
    while at < len(pieces):
        whole, end, joined = pieces[at], at + 1, pieces[at]
        for k in range(at + 1, len(pieces)):
            if joined not in begun:
                break
            joined = f"{joined} {pieces[k]}"
            if joined in known:
                whole, end = joined, k + 1
        out.append(whole)
        at = end
    return out


@cache
def known_sentences() -> dict[str, str]:
    """Normalised sentence to identifier: licence texts, and notices built as thing, verb, joining words and name."""
    found = {normalised(s): k for k, s in BODIES.items()}
    for licence, names in NAMES.items():
        for thing, verb, join, name in product(THINGS, VERBS, JOINS, names):
            found.setdefault(normalised(f"{thing} {verb} {join} {name}"), f"notice.{licence}")
        for name in names:
            found.setdefault(normalised(f"SPDX-License-Identifier: {name}"), f"notice.{licence}")
            found.setdefault(normalised(f"License: {name}"), f"notice.{licence}")
    for name in NAMES["Apache-2.0"]:
        for thing, verb, join in product(THINGS, VERBS, JOINS):
            notice = f'{thing} {verb} {join} {name} (the "License")'
            found.setdefault(normalised(notice), "notice.Apache-2.0")
            found.setdefault(normalised(f"{notice}; {BODIES['apache.comply']}"), "apache.licensed")
    for scheme in ("http", "https"):
        found.setdefault(normalised(f"{BODIES['apache.obtain']} {scheme}://www.apache.org/licenses/LICENSE-2.0"), "apache.obtain")
    return found


@cache
def _begun() -> set[str]:
    """What known sentences begin with, cut between words."""
    begun = set()
    for sentence in known_sentences():
        words = sentence.split(" ")
        begun.update(" ".join(words[:n]) for n in range(1, len(words)))
    return begun


def match(identifiers: list[str | None], rules: list[tuple[str, str, list[str]]] = ORDERS, gap: int = GAP) -> list[tuple[str, str, int, int]]:
    """(rule, licence, first and last sentence) of each match, in order of sentences."""
    used: set[int] = set()
    places: dict[str, list[int]] = {}
    for i, x in enumerate(identifiers):
        if x:
            places.setdefault(x, []).append(i)
    found = []
    for rule, licence, order in sorted(rules, key=lambda r: -len(r[2])):
        for first in places.get(order[0], []):
            if first in used:
                continue
            path = [first]
            for want in order[1:]:
                after = next((i for i in range(path[-1] + 1, min(len(identifiers), path[-1] + 2 + gap)) if identifiers[i] == want and i not in used), None)
                if after is None:
                    break
                path.append(after)
            if len(path) == len(order):
                used.update(path)
                found.append((rule, licence, path[0], path[-1]))
    return sorted(found, key=lambda m: (m[2], m[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = known_sentences()
    for batch in batches:
        out = []
        for _, texts in common.texts_of(batch.column(1)):
            for text in texts:
                ids = [known.get(s) for s in sentences(text)]
                hits = match(ids) if any(ids) else []
                out.append((len(ids), sum(x is not None for x in ids), ",".join(sorted({m[1] for m in hits})), ";".join(f"{r}@{a}-{b}" for r, _, a, b in hits)))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_sentences", "n_recognised", "licenses", "matches"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_recognised, licenses (SPDX, sorted, joined by commas), matches (rule@first-last;...) of each row."""
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, n_sentences long, n_recognised long, licenses string, matches string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
