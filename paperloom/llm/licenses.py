"""Licence scan by a positional index of rare tokens.

Each licence template is a list of words: the whole text of a short licence, the notice of a long one, or a line that names
one. Document frequencies of all template words over all documents give their IDF, and the index keeps, for each
template, the postings (template, position) of its highest-IDF words. A file's words are looked up; a word at place p with a posting at q
votes for the template starting at p - q. Votes of a template whose starts differ by a few words meet by relative position in one
cluster, so that words put in or taken out do not part them. A cluster with enough distinct rare words is aligned: the longest chain
of postings of all the template's words that rises in both texts, gaps allowed. The template counts if enough of its words are in
the chain and its mandatory key phrases stand whole in the stretch from the chain's first word to its last.

Base phrases are counted everywhere in the whole text, apart from the index.

Defined cases: a null text counts as empty; a text without a word has no place and score 0; of placements of one template that
overlap the one with more words stays, in a tie the earlier; placements of different templates don't exclude each other; words of equal
IDF are indexed in alphabetical order; repeated rows, and rows that repeat an id, give a result each; rows without an id keep a null id; an empty
table gives no rows; other input columns, whatever their names, are ignored; the time for a text grows with its length, however often it repeats itself.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import small

#: Phrase -> label, fixed by the contract of the query.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# --- fixed values: public licence texts and notices ---
#: Label -> (text, mandatory key phrases).
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    "apache-2.0-notice": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("in compliance with the license", "as is basis"),
    ),
    "mit": ("Released under the MIT License", ("mit license",)),
    "mit-text": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge",),
    ),
    "gpl-3.0": ("Licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    "gpl-notice": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
        by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        ("terms of the gnu general public license",),
    ),
    "lgpl-notice": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
        ("terms of the gnu lesser general public license",),
    ),
    "agpl-notice": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
        ("terms of the gnu affero general public license",),
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    "cc-by-text": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    "cc0-text": (
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work""",
        ("waived all copyright and related or neighboring rights",),
    ),
    "bsd-2-clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
        ("redistribution and use in source and binary forms",),
    ),
    "bsd-3-clause": (
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission.""",
        ("may be used to endorse or promote products derived from this software",),
    ),
    "isc-text": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.""",
        ("with or without fee is hereby granted",),
    ),
    "zlib-text": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
        be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
        the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        ("permission is granted to anyone to use this software for any purpose",),
    ),
    "mpl-2.0-notice": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("mozilla public license v 2 0",),
    ),
    "bsl-1.0-notice": (
        """Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at
        http://www.boost.org/LICENSE_1_0.txt""",
        ("boost software license version 1 0",),
    ),
    "unlicense-text": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
        ("unencumbered software released into the public domain",),
    ),
    "all-rights-reserved": ("All rights reserved", ("all rights reserved",)),
}
# --- end of fixed values ---

RARE = 12  # words of a template that the index keeps at most, and at most half of its distinct words, or three
COVERAGE = 0.7  # share of a template's words that must be in the chain
DRIFT = 8  # words by which starts within a cluster may differ from one to the next, and at most a quarter of the template

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, last_word: long, coverage: double>>"
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z; a word is a run of ASCII letters and digits and of any other characters beyond ASCII."""
    return text.translate(_TABLE).split()


@cache
def template_words() -> dict[str, list[bytes]]:
    return {label: words_of(text.encode()) for label, (text, _) in TEMPLATES.items()}


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    total = 0
    for batch in batches:
        for text in batch.column(0):
            seen.update(vocabulary.intersection(words_of(text.as_buffer().to_pybytes())))
            total += 1
    names = [*(w.decode() for w in seen), None]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*seen.values(), total], pa.int64())], names=["word", "n"])


def document_frequencies(docs: DataFrame, text_column: str = "text") -> tuple[dict[bytes, int], int]:
    """(documents with each template word, documents), over all documents; at most one row for each template word."""
    vocabulary = frozenset(w for words in template_words().values() for w in words)
    texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    counts = texts.mapInArrow(partial(_frequencies, vocabulary=vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    total = found.pop(None, 0)
    return {w.encode(): n for w, n in found.items()}, total


def build_index(frequencies: dict[bytes, int], total: int, rare: int = RARE) -> dict[bytes, list[tuple[str, int]]]:
    """Word -> postings (template, position) of the highest-IDF words of each template."""
    idf = lambda w: math.log((total + 1) / (frequencies.get(w, 0) + 1))
    index: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
    for label, words in template_words().items():
        own = set(words)
        best = sorted(own, key=lambda w: (-idf(w), w))[: min(rare, max(3, len(own) // 2))]
        for word in best:
            index[word] += [(label, k) for k, w in enumerate(words) if w == word]
    return dict(index)


def _chain(places: dict[bytes, list[int]], words: list[bytes]) -> tuple[int, int]:
    """(length, index of the last word) of a longest common subsequence with a template, whose words' positions are given.

    Each word brings its positions from the greatest down, and a position takes its place among the least ends of the
    rising chains so far. Of the longest chains one that ends first is taken.
    """
    ends: list[int] = []
    last = -1
    for k, word in enumerate(words):
        for at in reversed(places.get(word, ())):
            size = bisect_left(ends, at)
            if size == len(ends):
                ends.append(at)
                last = k
            else:
                ends[size] = at
    return len(ends), last


def longest_chain(places: dict[bytes, list[int]], words: list[bytes], lo: int, hi: int) -> tuple[int, int, int]:
    """(length, first place, last place) of a longest chain from lo to below hi that ends first and, so ended, starts last."""
    size, last = _chain(places, words[lo:hi])
    if not size:
        return 0, lo, lo
    mirrored = {w: [-k for k in reversed(own)] for w, own in places.items()}
    _, first = _chain(mirrored, words[lo : lo + last + 1][::-1])
    return size, lo + last - first, lo + last


def _clusters(starts: list[tuple[int, bytes]], size: int, needed: int) -> Iterator[tuple[int, int]]:
    """(least, greatest start) of runs of sorted starts in which `needed` distinct rare words stand within a drift.

    Starts of one placement differ by as much as words were put in or taken out; runs are shorter than half a template,
    so that no run joins two placements.
    """
    drift = min(DRIFT, size // 4)
    count: Counter = Counter()
    low = 0
    run: list[int] | None = None
    for start, word in starts:
        count[word] += 1
        while start - starts[low][0] > drift:
            old = starts[low][1]
            count[old] -= 1
            if not count[old]:
                del count[old]
            low += 1
        if len(count) < needed:
            continue
        first = starts[low][0]
        if run and first <= run[1] and start - run[0] <= max(drift, size // 2 - 1):
            run[1] = start
        else:
            if run:
                yield run[0], run[1]
            run = [max(first, run[1] + 1) if run else first, start]
    if run:
        yield run[0], run[1]


def match_templates(words: list[bytes], index: dict[bytes, list[tuple[str, int]]], found: set[bytes], coverage: float) -> list[tuple[str, int, int, float]]:
    """Accepted placements (label, first word, last word, coverage); overlapping ones of a label keep the best."""
    votes: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
    for place, word in enumerate(words):
        if word in found:
            for label, k in index[word]:
                votes[label].append((place - k, word))
    out: list[tuple[str, int, int, float]] = []
    for label, starts in votes.items():
        own, places = template_words()[label], _positions()[label]
        rare = len({w for w, posts in index.items() if any(p[0] == label for p in posts)})
        needed = min(rare, 3, max(2, rare // 3))
        kept: list[tuple[str, int, int, float]] = []
        drift = min(DRIFT, len(own) // 4)
        for first, last in _clusters(sorted(starts), len(own), needed):
            size, lo, hi = longest_chain(places, words, max(0, first - drift), min(len(words), last + len(own) + drift))
            share = size / len(own)
            if share < coverage:
                continue
            stretch = b" " + b" ".join(words[lo : hi + 1]) + b" "
            if all(b" " + phrase.encode() + b" " in stretch for phrase in TEMPLATES[label][1]):
                here = (label, lo, hi, share)
                if kept and lo <= kept[-1][2]:
                    if share > kept[-1][3]:
                        kept[-1] = here
                else:
                    kept.append(here)
        out += kept
    return sorted(out)


@cache
def _positions() -> dict[str, dict[bytes, list[int]]]:
    """For each template the positions of each of its words, ascending."""
    out: dict[str, dict[bytes, list[int]]] = {}
    for label, words in template_words().items():
        own: dict[bytes, list[int]] = defaultdict(list)
        for k, word in enumerate(words):
            own[word].append(k)
        out[label] = dict(own)
    return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place of a base phrase."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE_PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at, before, word = line.find(sought), 0, 0
        while at >= 0:
            word += line.count(b" ", before, at)
            before = at
            out.append((word, label))
            at = line.find(sought, at + 1)
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch], index: dict, coverage: float) -> Iterator[pa.RecordBatch]:
    rare = frozenset(index)
    triggers = frozenset(p.split()[0].encode() for p in BASE_PHRASES)
    fields = [c.split(" ")[0] for c in SCHEMA.split(", spans")[0].split(", ")] + ["spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("coverage", pa.float64())]))
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), span]
    for batch in small(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_buffer().to_pybytes())
            found = rare.intersection(words)
            base = base_places(words) if triggers.intersection(words) else []
            spans = match_templates(words, index, found, coverage) if found else []
            labels = sorted({x for _, x in base})
            both = sorted({*labels, *(s[0] for s in spans)})
            score = max([0.0, *(s[3] for s in spans), *(1.0 for _ in base[:1])])
            rows.append(
                (doc_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(labels), ",".join(both), score,
                 [dict(zip(("label", "first_word", "last_word", "coverage"), s, strict=True)) for s in spans])
            )
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=fields)


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE, rare: int = RARE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: places of base phrases, labels, best coverage, and the spans of accepted templates."""
    index = build_index(*document_frequencies(docs, text_column), rare)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(partial(_scan, index=index, coverage=coverage), SCHEMA)
