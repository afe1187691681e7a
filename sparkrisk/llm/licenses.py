"""Licence recognition by sentences and ordered rules (operator 6).

Texts are cut into units (sentences, and lines, since headers are wrapped). A normalised run of whole units
that equals a known licence sentence becomes that sentence's identifier: a word trie is walked from every
unit's start, so a unit that begins no known sentence costs a few steps. A document is then its sequence of
identifiers, and licence rules are ordered identifier sequences that must follow each other with at most
``GAP`` unknown units between. Longer rules go before shorter ones, and a sentence serves one match only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Unknown units allowed between two sentences of a rule (numbering, a notice, a blank).
GAP = 3

#: Known licence sentences by identifier, from the licences' published texts and notices.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is '
                    'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 'associated documentation files (the "Software"), to deal in the Software without restriction, including '
                 "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                 "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
                 "following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                "portions of the Software",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
                    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                 "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                 "option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
               "the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                  "following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                  "following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                 "products derived from this software without specific prior written permission",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Fixed values: (rule, licence, sentences in their order).
RULES = (
    ("apache-2.0-header", "Apache-2.0", ("apache-header", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("apache-2.0-notice", "Apache-2.0", ("apache-notice",)),
    ("mit-text", "MIT", ("mit-grant", "mit-keep", "mit-warranty")),
    ("mit-notice", "MIT", ("mit-notice",)),
    ("mit-licensed", "MIT", ("mit-licensed",)),
    ("gpl-3.0-header", "GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("gpl-2.0-header", "GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("gpl-3.0-notice", "GPL-3.0-only", ("gpl3-notice",)),
    ("gpl-3.0-licensed", "GPL-3.0-only", ("gpl3-licensed",)),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("cc-by-4.0-notice", "CC-BY-4.0", ("cc-by-notice",)),
    ("cc-by-4.0-work", "CC-BY-4.0", ("cc-by-work",)),
    ("cc-by-sa-4.0-work", "CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("bsd-3-clause-text", "BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-clause-text", "BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("mpl-2.0-notice", "MPL-2.0", ("mpl-notice",)),
)

_UNIT_END = re.compile(r"\n|(?<=[.!?;:])\s+")
_WORD = re.compile(r"[^\W_]+")
_END = ""  # key of a sentence's identifier in the trie; no word is empty

MATCH = "array<struct<license:string,rule:string,first_unit:int,last_unit:int,sentences:int>>"


def normal_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


class Scanner:
    """Word trie of the known sentences, and the rules by their first sentence, longest first."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES, gap: int = GAP):
        self.trie: dict = {}
        self.gap = gap
        for key, sentence in sentences.items():
            node = self.trie
            for word in normal_words(sentence):
                node = node.setdefault(word, {})
            node[_END] = key
        self.rules: dict[str, list[tuple]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r[2]), r[0])):
            self.rules.setdefault(rule[2][0], []).append(rule)

    def identifiers(self, text: str) -> list[tuple[int, int, str]]:
        """(first unit, last unit, sentence) of every longest run of whole units that is a known sentence."""
        units = [u for u in _UNIT_END.split(text) if u]
        words: dict[int, list[str]] = {}  # of units that a sentence may reach
        out, at = [], 0
        while at < len(units):
            found, node, k = None, self.trie, at
            while k < len(units):
                if k not in words:
                    words[k] = normal_words(units[k])
                for word in words[k]:
                    node = node.get(word)
                    if node is None:
                        break
                if node is None or (k == at and not words[k]):
                    break
                if _END in node:
                    found = k, node[_END]
                k += 1
            words.pop(at, None)
            if found:
                out.append((at, found[0], found[1]))
                at = found[0]
            at += 1
        return out

    def matches(self, text: str) -> list[tuple[str, str, int, int, int]]:
        """(licence, rule, first unit, last unit, sentences) of every rule met, in order."""
        ids = self.identifiers(text)
        out, at = [], 0
        while at < len(ids):
            step = 1
            for name, licence, wanted in self.rules.get(ids[at][2], ()):
                run = ids[at:at + len(wanted)]
                if tuple(r[2] for r in run) == wanted and all(b[0] - a[1] - 1 <= self.gap for a, b in zip(run, run[1:])):
                    out.append((licence, name, run[0][0], run[-1][1], len(run)))
                    step = len(run)
                    break
            at += step
        return out


def found_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES,
                   rules=RULES, gap: int = GAP) -> DataFrame:
    """One row per input row and rule met: id, license, rule, first_unit, last_unit, sentences.

    NULL, empty and unlicensed texts give no row; repeated rows are reported each; a licence found twice in a
    text gives two rows, in place order. Only the named columns are read, so others cannot clash; an empty
    table gives an empty result. Row-wise: no shuffle; the rules are a parameter of the task.
    """

    @F.arrow_udf(MATCH)
    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(sentences, rules, gap)
        names = ("license", "rule", "first_unit", "last_unit", "sentences")
        kind = pa.list_(pa.struct([("license", pa.string()), ("rule", pa.string()), ("first_unit", pa.int32()),
                                   ("last_unit", pa.int32()), ("sentences", pa.int32())]))
        for texts in it:
            yield pa.array([[dict(zip(names, m)) for m in scanner.matches(t or "")]
                            for part in chunks(texts) for t in part.to_pylist()], kind)

    return docs.select(F.col(id_col), F.explode(scan(F.col(text_col))).alias("m")).select(F.col(id_col), "m.*")
