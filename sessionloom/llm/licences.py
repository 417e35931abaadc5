"""Operator 3: licence recognition by sentences and ordered rules.

A text is cut into sentences, which are normalised (lower case, letters, digits and dots within
numbers, single spaces) and looked up among known licence sentences. A known sentence may run over several lines, with
comment marks before them: its words must begin where a line or sentence begins and end where one ends. A slot, <...>, in a known sentence
stands for up to SLOT words, such as the name of a holder. What is left of the text is a sequence of
sentence identifiers; a rule names a licence and an ordered sequence of identifiers, and holds where that
sequence occurs in the text's, other known sentences and at most `gap` unknown ones between its parts (an unknown one ends at
its mark or at a blank line). Longer rules come first, and
a sentence used by one rule is not used by a later one.

One pass without a shuffle; sentences and rules are fixed values. Nulls and empty texts have no licence.
Whole texts are read, sentence by sentence. Rows are judged each by its own text; further columns are passed on.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare

# Sentences of public licence notices, by identifier.
SENTENCES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-grant": 'Licensed under the Apache License, Version 2.0 (the "License").',
    "apache-2.0-grant-may": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2.0-may": "you may not use this file except in compliance with the License.",
    "apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-2.0-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-this": "This project is licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-program": "This program is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-author": "The name of <holder> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-adverts": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY <holder> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc0-1.0": "Licensed under CC0 1.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "gpl-2.0-only-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-3.0-only-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "lgpl-2.1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0-library": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-2.0-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "epl-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "boost-short": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "apache-2.0-title": "Apache License Version 2.0, January 2004",
    "apache-2.0-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "gpl-3.0-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2.0-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl-3.0-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl-2.0-title": "Mozilla Public License Version 2.0",
    "copying": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "all-rights": "All rights reserved.",
}

# Identifiers that a file may name.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense WTFPL Zlib".split()

# A licence and the sentences that name it, in their order.
RULES = [
    ("Apache-2.0", ("apache-2.0-grant-may", "apache-2.0-copy", "apache-2.0-as-is", "apache-2.0-see")),
    ("Apache-2.0", ("apache-2.0-grant", "apache-2.0-may")),
    ("Apache-2.0", ("apache-2.0-grant-may",)),
    ("Apache-2.0", ("apache-2.0-short",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-this",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2.0-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-2.0-free",)),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("AGPL-3.0", ("agpl-3.0-title", "copying")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free",)),
    ("LGPL-2.1", ("lgpl-2.1-title", "copying")),
    ("LGPL-3.0-or-later", ("lgpl-3.0-free",)),
    ("LGPL-3.0-or-later", ("lgpl-3.0-library",)),
    ("LGPL-3.0", ("lgpl-3.0-title", "copying")),
    ("GPL-2.0-only", ("gpl-2.0-only-free",)),
    ("GPL-3.0-only", ("gpl-3.0-only-free",)),
    ("GPL-3.0", ("gpl-3.0-title", "copying")),
    ("GPL-2.0", ("gpl-2.0-title", "copying")),
    ("Apache-2.0", ("apache-2.0-title", "apache-2.0-terms")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant",)),
    ("MIT-0", ("mit-0-grant",)),
    ("EPL-2.0", ("epl-2.0",)),
    ("EPL-2.0", ("epl-2.0-v",)),
    ("EPL-1.0", ("epl-1.0",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-short",)),
    ("WTFPL", ("wtfpl",)),
    ("MPL-2.0", ("mpl-2.0", "mpl-2.0-copy")),
    ("MPL-2.0", ("mpl-2.0", "mpl-2.0-copy-https")),
    ("MPL-2.0", ("mpl-2.0-title",)),
    ("GPL-3.0", ("gpl-3.0-work",)),
    ("GPL-3.0", ("gpl-3.0-program",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name-author")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-adverts", "bsd-name")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-adverts", "bsd-name-author")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("cc-by-4.0",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.0",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0",)),
    ("CC0-1.0", ("cc0-1.0",)),
    ("MPL-2.0", ("mpl-2.0",)),
    ("Unlicense", ("unlicense",)),
]

SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in SPDX}
RULES += [(x, (f"spdx-{x.lower()}",)) for x in SPDX]

#: Words that a slot of a known sentence stands for, at most.
SLOT = 20

LICENCES = "array<struct<licence:string,first:int,last:int>>"

_BREAK = re.compile(r"(?<=[.!?:;])([\"')\]]*\s+)|\n+")
_SLOT = re.compile(r"<\w+>")
_DROP = re.compile(r"[^0-9a-z.]+|\.(?![0-9])")


def normalise(sentence: str) -> str:
    return _DROP.sub(" ", sentence.lower()).strip()


class Rules:
    """Sentences and rules, ready to be looked up."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, gap: int = 3):
        self.gap, self.rules = gap, sorted(rules, key=lambda r: -len(r[1]))
        self.known, self.slotted = {}, {}
        for name, s in sentences.items():
            parts = [normalise(x) for x in _SLOT.split(s)]
            if len(parts) == 1:
                self.known[parts[0]] = name
            else:
                pattern = rf" (?:[^ ]+ ){{1,{SLOT}}}?".join(map(re.escape, parts))
                self.slotted.setdefault(parts[0].split(" ", 1)[0], []).append((parts[0], re.compile(pattern), name))
        # by first word, the longest first: a sentence is put together from the pieces that it was cut into
        self.starts: dict[str, list[str]] = {}
        for n in sorted(self.known, key=len, reverse=True):
            self.starts.setdefault(n.split(" ", 1)[0], []).append(n)
        self.most = 2 * max(map(len, sentences.values()))

    def sentences(self, text: str | None) -> list[tuple[int, str]]:
        """(number of the sentence, identifier) of the known sentences of a text."""
        text = text or ""
        cut, line, at = [], True, 0  # (normalised piece, is it a blank line, does a sentence end after it)
        for m in [*_BREAK.finditer(text), None]:
            piece, gap = text[at : m.start() if m else len(text)], m.group() if m else "\n"
            n = normalise(piece) if len(piece) < self.most else None
            cut.append((n, n == "" and line and "\n" in gap, m is None or m.group(1) is not None or len(gap) > 1))
            line, at = "\n" in gap, m.end() if m else at
        out, number, within, k = [], -1, False, 0
        while k < len(cut):
            n, blank, last = cut[k]
            name, end = self._longest(cut, k) if n else (None, k)
            if name:
                number, within, k = number + 1, False, end
                out.append((number, name))
                continue
            if n != "":
                number, within = number + (not within), not last
            elif blank:
                within = False
            k += 1
        return out

    def _longest(self, cut: list, k: int) -> tuple[str | None, int]:
        """The longest known sentence that the pieces from k on make up, and the piece after it."""
        first = cut[k][0]
        for head, pattern, name in self.slotted.get(first.split(" ", 1)[0], ()):
            if head.startswith(first) or first.startswith(head):
                if end := self._filled(cut, k, pattern):
                    return name, end
        for known in self.starts.get(first.split(" ", 1)[0], ()):
            size, end = 0, k
            while end < len(cut) and (n := cut[end][0]) is not None:
                if n:
                    if not known.startswith(n, size):
                        break
                    size += len(n)
                    if size == len(known):
                        return self.known[known], end + 1
                    if known[size] != " ":
                        break
                    size += 1
                end += 1
        return None, k

    def _filled(self, cut: list, k: int, pattern: re.Pattern) -> int:
        """The piece after those from k on that fill a pattern with slots; 0 if none do."""
        text = ""
        for end in range(k, len(cut)):
            n = cut[end][0]
            if n is None or len(text) > self.most:
                break
            if n:
                text = f"{text} {n}" if text else n
                if pattern.fullmatch(text):
                    return end + 1
        return 0

    def licences(self, text: str | None) -> list[tuple[str, int, int]]:
        """(licence, number of its first sentence, of its last) in the text, in order."""
        found = self.sentences(text)
        used, out = [False] * len(found), []
        for licence, wanted in self.rules if found else ():
            for start in range(len(found)):
                if used[start] or found[start][1] != wanted[0]:
                    continue
                picked = [start]
                for name in wanted[1:]:
                    step = next((k for k in range(picked[-1] + 1, len(found)) if not used[k] and found[k][1] == name), None)
                    between = 0 if step is None else found[step][0] - found[picked[-1]][0] - (step - picked[-1])
                    if step is None or between > self.gap:
                        break
                    picked.append(step)
                if len(picked) == len(wanted):
                    for k in picked:
                        used[k] = True
                    out.append((licence, found[picked[0]][0], found[picked[-1]][0]))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, rules: Rules | None = None, to: str = "licences") -> DataFrame:
    """docs with the licences of each text and the sentences that they stand in; a column of that name is replaced."""
    prepare(docs.sparkSession)
    rules, docs = rules or Rules(), docs.drop(to)

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("licence", "first", "last"), x, strict=True)) for x in rules.licences(t)] for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int32()), ("last", pa.int32())])))], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T._parse_datatype_string(LICENCES))]))


def licensed(docs: DataFrame) -> DataFrame:
    """doc_id, licences (distinct, in order of name), n_found of every row of docs (doc_id, text)."""
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return found.select("doc_id", F.array_sort(F.array_distinct("licences.licence")).alias("licences"), F.size("licences").cast("long").alias("n_found"))
