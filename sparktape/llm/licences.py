"""License scans with a generalised suffix automaton of licence templates.

All templates go into one automaton over their words; every state knows where in which templates its longest string ends.
Files are streamed through it: for each word the longest suffix read so far that occurs in a template (matching
statistics). Maximal matches of ``LEAST`` words or more are chained per template, in the same order in text and template
with gaps of ``GAP`` words at most, into spans; a span that covers ``COVER`` of its template's words labels the text. Beside
it stand the base phrases, found wherever their words stand consecutively.

The automaton holds the templates only, so its size is fixed; it is broadcast, and files are read whole, one Arrow batch at
a time, without a shuffle. Words are hashed with array operations, and only texts where ``LEAST`` consecutive words occur
in a template are streamed; no other text can have a match.

The default templates are notices and main clauses of the common licences, not their full texts; ``scanner`` takes any others.

Null texts are empty; texts without words have no places and no labels. Repeated rows are scanned one by one. Other columns
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.llm.words import NOT_ALNUM, Piece, carried, pieces, returning, runs, texts_of

LEAST = 4
GAP = 8
COVER = 0.8
SCORE_OF_PHRASE = 0.5

# Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licences and of the notices that name them, by label.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions",
    ),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software",
    ),
    ("apache", "licensed under the Apache License, Version 2.0"),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "licensed under the GNU General Public License, version 2"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
        " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at",
    ),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    (
        "mit",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"
        " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    (
        "apache",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,"
        " worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly"
        " display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form",
    ),
    (
        "apache",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,"
        " worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made,"
        " use, offer to sell, sell, import, and otherwise transfer the Work",
    ),
    (
        "apache",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in"
        " Source or Object form, provided that You meet the following conditions",
    ),
    (
        "gpl",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and"
        " other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public"
        " License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software"
        " for all its users",
    ),
    (
        "gpl",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public"
        " License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users",
    ),
    (
        "gpl",
        "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you"
        " have the freedom to distribute copies of free software",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as"
        " published by the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission",
    ),
    (
        "bsd",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT'
        " LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
        " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    (
        "isc",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES'
        " OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES",
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and"
        " redistribute it freely, subject to the following restrictions",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or"
        " distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial",
    ),
    (
        "mpl",
        'Covered Software is provided under this License on an "as is" basis, without warranty of any kind, either expressed, implied, or'
        " statutory",
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying"
        ' documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ),
]


def words_of(text: str | None) -> list[bytes]:
    piece = next(pieces(pa.array([text], pa.string()), NOT_ALNUM, fold=True))
    raw = piece.data.tobytes()
    return [raw[a:b] for a, b in zip(piece.starts.tolist(), piece.ends.tolist())]


@dataclass
class Automaton:
    """Generalised suffix automaton: one state for each set of places where strings of words end."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    length: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, last: int, word: bytes, target: int) -> int:
        """A copy of ``target`` for its strings that ``last`` and one word make, at which these now end."""
        copy = self._state(self.length[last] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while last >= 0 and self.step[last].get(word) == target:
            self.step[last][word] = copy
            last = self.link[last]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        target = self.step[last].get(word)
        if target is not None:  # an earlier template has this string
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.step[last][word]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        return new

    @classmethod
    def of(cls, templates: list[list[bytes]]) -> Automaton:
        own = cls()
        for number, words in enumerate(templates):
            last = 0
            for place, word in enumerate(words):
                last = own._extend(last, word)
                own.ends[last].append((number, place))
        for state in sorted(range(1, len(own.length)), key=own.length.__getitem__, reverse=True):
            own.ends[own.link[state]] += own.ends[state]  # where a string ends, its suffixes end
        own.ends[0] = []
        return own

    def matches(self, words: list[bytes], least: int = LEAST) -> Iterator[tuple[int, int, int]]:
        """(last place, length, state) of the maximal matches of at least ``least`` words."""
        state = size = 0
        for place, word in enumerate(words):
            before = (place - 1, size, state)
            while state and word not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.step[state]:
                state, size = self.step[state][word], size + 1
            if size <= before[1] and before[1] >= least:
                yield before
        if size >= least:
            yield len(words) - 1, size, state


@dataclass
class Scanner:
    labels: list[str]
    sizes: list[int]
    automaton: Automaton
    grams: np.ndarray  # hashes of all runs of LEAST words in templates, sorted
    phrases: list[tuple[str, int, int]]  # label, hash, words


def scanner(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Scanner:
    words = [words_of(text) for _, text in templates]
    piece = list(pieces(pa.array([text for _, text in templates], pa.string()), NOT_ALNUM, fold=True))
    grams = np.unique(np.concatenate([runs(p.hashes(), p.bounds, LEAST)[0] for p in piece]))
    of_phrases = []
    for phrase, label in phrases.items():
        (own,) = pieces(pa.array([phrase], pa.string()), NOT_ALNUM, fold=True)
        of_phrases.append((label, int(runs(own.hashes(), own.bounds, len(own.starts))[0][0]), len(own.starts)))
    return Scanner([label for label, _ in templates], [len(w) for w in words], Automaton.of(words), grams, of_phrases)


def spans(own: Scanner, words: list[bytes], cover: float = COVER) -> list[tuple[str, float, int, int]]:
    """(label, share of the template covered, first word, last word) of the chains that cover enough of their template."""
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for last, size, state in own.automaton.matches(words):
        for number, end in own.automaton.ends[state]:
            by_template.setdefault(number, []).append((last - size + 1, end - size + 1, size))
    found = []
    for number, parts in by_template.items():
        parts.sort()
        open_chains: list[list[int]] = []  # first word, last word, last template word, template words covered
        closed: list[list[int]] = []
        for start, place, size in parts:
            closed += [c for c in open_chains if start - c[1] - 1 > GAP]
            open_chains = [c for c in open_chains if start - c[1] - 1 <= GAP]
            best = None
            for chain in open_chains:
                apart, ahead = start - chain[1] - 1, place - chain[2] - 1
                overlap = max(0, -apart, -ahead)
                if apart <= GAP and ahead <= GAP and size > overlap and (best is None or chain[3] - overlap > best[0][3] - best[1]):
                    best = (chain, overlap)
            if best:
                chain, overlap = best
                open_chains.append([chain[0], start + size - 1, place + size - 1, chain[3] + size - overlap])
            else:
                open_chains.append([start, start + size - 1, place + size - 1, size])
        for first, last, _, covered in closed + open_chains:
            if covered >= cover * own.sizes[number]:
                found.append((own.labels[number], min(1.0, covered / own.sizes[number]), first, last))
    return sorted(set(found))


def _found(piece: Piece, own: Scanner) -> Iterator[tuple[int, int, int | None, int | None, list[str], list]]:
    hashes = piece.hashes()
    total = piece.last - piece.first
    places, first, last = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max), np.full(total, -1)
    base: dict[int, set[str]] = {}
    for size in {n for _, _, n in own.phrases}:
        at, bounds = runs(hashes, piece.bounds, size)
        for label, wanted, n in own.phrases:
            if n == size:
                hits = np.flatnonzero(at == np.uint64(wanted))
                row = np.searchsorted(bounds, hits, "right") - 1
                np.add.at(places, row, 1)
                np.minimum.at(first, row, hits - bounds[row])
                np.maximum.at(last, row, hits - bounds[row])
                for r in row.tolist():
                    base.setdefault(r, set()).add(label)
    grams, bounds = runs(hashes, piece.bounds, LEAST)
    near = np.zeros(1 << 16, bool)
    near[(own.grams & np.uint64(0xFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(near[(grams & np.uint64(0xFFFF)).astype(np.int64)])
    some = some[np.isin(grams[some], own.grams)]
    streamed = set((np.searchsorted(bounds, some, "right") - 1).tolist())
    counts = piece.counts.tolist()
    for row in range(total):
        chains = []
        if row in streamed:
            raw = piece.data[piece.offsets[row] : piece.offsets[row + 1]].tobytes()
            a, b, shift = piece.bounds[row], piece.bounds[row + 1], piece.offsets[row]
            words = [raw[x:y] for x, y in zip((piece.starts[a:b] - shift).tolist(), (piece.ends[a:b] - shift).tolist())]
            chains = spans(own, words)
        some_place = places[row] > 0
        yield counts[row], int(places[row]), int(first[row]) if some_place else None, int(last[row]) if some_place else None, sorted(base.get(row, ())), chains


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "spans array<struct<label: string, cover: double, first_word: long, last_word: long>>"
)


def scanned(docs: DataFrame, text: str = "text", own: Scanner | None = None, carry: list[str] | None = None) -> DataFrame:
    """(doc, SCHEMA): the carried columns of every row, all by default, its base phrases and template spans."""
    sent = docs.sparkSession.sparkContext.broadcast(own or scanner())
    rows = docs.select(*carried(docs, text, docs.columns if carry is None else carry))
    kinds = [pa.int64()] * 4 + [
        pa.list_(pa.string()),
        pa.list_(pa.struct([("label", pa.string()), ("cover", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])),
    ]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "spans"]

    def of(batches):
        for batch in batches:
            found = [f for piece in pieces(texts_of(batch, text), NOT_ALNUM, fold=True) for f in _found(piece, sent.value)]
            columns = list(zip(*found)) if found else [[]] * len(names)
            columns[-1] = [[dict(zip(("label", "cover", "first_word", "last_word"), s)) for s in row] for row in columns[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc", *names])

    return rows.mapInArrow(of, returning(rows, SCHEMA))


def op10(spark, sf_dir: str) -> DataFrame:
    """Licence phrases and template labels of all documents."""
    rows = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    cover = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return rows.select(
        "doc.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(cover, F.when(F.col("n_base") > 0, SCORE_OF_PHRASE).otherwise(0.0)).alias("score"),
    )
