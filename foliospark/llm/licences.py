"""Licence scan: matching statistics against a generalised suffix automaton of licence texts.

Template words form one small automaton (its texts are constants of this module, so
its size is fixed).  A text's words stream through it; matches of ``MIN_MATCH`` words
or more are chained, per template and in template order, into covered spans: of all
chains that advance in text and template, with no more than ``MAX_GAP`` words skipped,
the one that covers most words counts.  Phrases are templates too, and count wherever
they stand whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .runtime import by_pack, text_bytes, tune
from .vocabulary import Vocabulary, folded_words, runs

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_ENDORSEMENT = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_HOLDERS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MERCHANTABILITY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

# Public licence texts (of the long ones the notice that files carry), each paragraph a
# template of its own, so that a file with only one of them gets the label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", _REDISTRIBUTE),
    ("bsd-3-clause", _NO_ENDORSEMENT),
    ("bsd", _HOLDERS),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program " + _MERCHANTABILITY + " See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This library " + _MERCHANTABILITY + " See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form"),
]

#: Shortest match that a chain is made of, and the part of a template that a chain must cover for its label.
MIN_MATCH = 3
MIN_COVER = 0.6
#: Words that a chain may skip in the text between two matches.
MAX_GAP = 4


@dataclass
class LicenceIndex:
    vocabulary: Vocabulary
    automaton: SuffixAutomaton
    labels: list[str]
    sizes: list[int]
    phrases: dict[int, list[int]]
    starts: dict[int, list[tuple[int, int]]]
    pairs: np.ndarray

    @classmethod
    def build(cls) -> LicenceIndex:
        texts = [*TEMPLATES, *((label, phrase) for phrase, label in PHRASES.items())]
        words = [folded_words(t.encode()) for _, t in texts]
        vocabulary = Vocabulary(words)
        sequences = [vocabulary.number(w) for w in words]
        automaton = SuffixAutomaton()
        for s in sequences:
            automaton.add(s)
        phrases: dict[int, list[int]] = {}
        starts: dict[int, list[tuple[int, int]]] = {}
        pairs = np.zeros((len(vocabulary), len(vocabulary)), dtype=bool)
        for k, s in enumerate(sequences):
            v = 0
            for at, symbol in enumerate(s):
                v = automaton.next[v][symbol]
                u = v
                while u > 0:  # where in the templates the words of this state end
                    starts.setdefault(u, []).append((k, at + 1))
                    u = automaton.link[u]
                if at:
                    pairs[s[at - 1], symbol] = True
            if k >= len(TEMPLATES):
                phrases.setdefault(v, []).append(k)
        return cls(vocabulary, automaton, [label for label, _ in texts], [len(s) for s in sequences], phrases, starts, pairs)


def _scan(index: LicenceIndex, ids: np.ndarray, edges: np.ndarray, n: int):
    """Per text: places of phrases (start, label), and the covered words of each template."""
    places: dict[int, list[tuple[int, str]]] = {}
    chains: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
    auto = index.automaton
    for start, end in runs(index.pairs[ids[:-1], ids[1:]], MIN_MATCH - 1) if len(ids) > 1 else ():
        end += 1
        doc = int(np.searchsorted(edges, start, "right")) - 1
        states, lengths = auto.walk(ids[start:end].tolist())
        for j, (v, length) in enumerate(zip(states, lengths, strict=True)):
            at = start + j + 1 - int(edges[doc])
            last = j + 1 == len(states) or lengths[j + 1] <= length
            if last and length >= MIN_MATCH:
                for k, stop in index.starts[v]:
                    chains.setdefault(doc, {}).setdefault(k, []).append((at - length, at, stop))
            while v > 0:
                for k in index.phrases.get(v, ()):
                    if index.sizes[k] <= length:
                        places.setdefault(doc, []).append((at - index.sizes[k], index.labels[k]))
                v = auto.link[v]
    return places, chains


def _best_chain(matches: list[tuple[int, int, int]], size: int) -> tuple[float, int, int]:
    """Largest part of a template that a chain covers, and the chain's first and past-the-last word in the text.

    A match is (first word, past the last, past the last in the template).  Weighted
    chaining: a match follows any other that ends before it in the template and at most
    ``MAX_GAP`` words before it in the text; what overlaps counts once.
    """
    best = (0, 0, 0)
    near: list[tuple[int, int, int, int]] = []  # end, end in the template, covered words, first word of the chain
    for a, b, to in sorted(set(matches), key=lambda m: (m[1], m[0])):
        covered, first = b - a, a
        near = [m for m in near if m[0] + MAX_GAP + size >= a]
        for end, stop, held, begun in near:
            fresh = min(b - max(a, end), to - max(to - (b - a), stop))
            if end < b and stop < to and a - end <= MAX_GAP and held + fresh > covered:
                covered, first = held + fresh, begun
        near.append((b, to, covered, first))
        best = max(best, (covered, first, b), key=lambda m: m[0])
    return min(1.0, best[0] / size), best[1], best[2]


def _work(index: LicenceIndex, blobs: list[bytes]) -> dict[str, list]:
    ids, edges = index.vocabulary.pack(blobs)
    n = len(blobs)
    places, chains = _scan(index, ids, edges, n)
    out: dict[str, list] = {"n_words": np.diff(edges) - 1, "n_base": [0] * n, "first_word": [None] * n, "last_word": [None] * n, "base_labels": [""] * n, "labels": [""] * n, "score": [0.0] * n, "spans": [[] for _ in range(n)]}
    for d in places.keys() | chains.keys():
        own = places.get(d, [])
        base = {label for _, label in own}
        cover = {k: _best_chain(m, index.sizes[k]) for k, m in chains.get(d, {}).items() if k < len(TEMPLATES)}
        held = sorted((first, end, index.labels[k]) for k, (c, first, end) in cover.items() if c >= MIN_COVER)
        if own:
            out["n_base"][d] = len(own)
            out["first_word"][d], out["last_word"][d] = min(own)[0], max(own)[0]
        out["base_labels"][d] = ",".join(sorted(base))
        out["labels"][d] = ",".join(sorted(base | {label for *_, label in held}))
        out["score"][d] = 1.0 if own else max((c for c, *_ in cover.values()), default=0.0)
        out["spans"][d] = [f"{label}:{a}:{b}" for a, b, label in held]
    return out


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrase places, labels and the best covered part of a template, per input row; a narrow pass.

    ``spans`` has the covered template spans as label:first word:past the last.
    ``score`` is 1 where a phrase stands, else the largest covered part of a template.
    A very long text is a pack of its own: some 30 bytes a word.

    Null texts are empty: no words, no labels, score 0.  Null ids stay null, repeated
    rows give repeated rows, other columns are not read, empty tables give no rows.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(LicenceIndex.build())
    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", "array<string>")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([("id", pa.int64()), *((n, kinds[k]) for n, k in fields)])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    made = rows.mapInArrow(by_pack(lambda blobs: _work(shared.value, blobs), schema), "id long, " + ", ".join(f"{n} {k}" for n, k in fields))
    return made.withColumnRenamed("id", id_col)
