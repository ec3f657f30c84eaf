r"""License scans with a generalised suffix automaton over the words of license templates.

The automaton knows every run of words of every template. A text is streamed through it, which gives for each word the length of
the longest run ending there that some template has (matching statistics). Where such a run of at least SEED words cannot be
continued it is a match, at every place of a template where the run stands. Matches of one template that follow one another in text
and template, with at most GAP words between, are chained: each continues the chain before it that covers most. Of the chains of
one template those that cover most are taken first, and others where they leave the text free; a chain that covers enough of its
template is a span and names the template's license. So a license that stands twice is two spans.

Templates are a parameter: pairs of label and text, or a table of them with columns label and text (MOST_WORDS words at most, which
the automaton of every task holds).

Beside these spans the base rule holds: the places where the words of a phrase stand consecutively.

Nulls, ties and the like: a null text is empty; words are runs of ASCII digits and letters (lower-cased) and all beyond ASCII; an
empty table gives an empty result; templates without words and rows of them with nulls name nothing. Only doc_id and text are read,
whatever other columns are called; memory holds one text, of any length, at a time.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, GAP = 4, 30
#: Words that all templates together may have.
MOST_WORDS = 1_000_000
#: Share of a template that a span must cover; templates of up to SHORT words must be nearly whole.
COVER, SHORT, COVER_SHORT = 0.35, 12, 0.8
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:long>>"

# The phrases of the base rule, and the wording of well-known licenses and of the notices that name them.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and "
        "must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
)

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 32 for b in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


class SuffixAutomaton:
    """Of several token lists. ends[state]: (list, place) of each end of the state's runs; only of states with runs of SEED tokens or more."""

    def __init__(self, lists: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for name, tokens in enumerate(lists):
            last = 0
            for place, token in enumerate(tokens):
                last = self._add(last, token)
                self.ends[last].add((name, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= SEED:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place of the last word, length, state) of each run that cannot be continued."""
        state = length = 0
        for place, token in enumerate(tokens):
            before = state, length
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(token, 0)
            length = length + 1 if state else 0
            if length <= before[1] >= SEED:
                yield place - 1, before[1], before[0]
        if length >= SEED:
            yield len(tokens) - 1, length, state


@cache
def _model(templates: tuple[tuple[str, str], ...]) -> tuple[dict[bytes, int], list[str], list[int], SuffixAutomaton]:
    lists = [words(text.encode()) for _, text in templates]
    ids = {w: i for i, w in enumerate(sorted({w for x in lists for w in x}))}
    return ids, [label for label, _ in templates], [len(x) for x in lists], SuffixAutomaton([[ids[w] for w in x] for x in lists])


class _Chains:
    """The chains of one template, over the matches that come in the order of the text."""

    def __init__(self):
        self.done: list[tuple[int, int, int]] = []
        self.open: list[tuple[int, int, int, int]] = []

    def add(self, first: int, last: int, places: list[int]) -> None:
        length = last - first + 1
        self.open = [c for c in self.open if first - c[1] <= GAP]
        new = []
        for place in places:
            start = place - length + 1
            before = max((c for c in self.open if c[2] < start and c[1] < first), key=lambda c: (c[3], c[1], c[0]), default=None)
            new.append((before[0] if before else first, last, place, length + (before[3] if before else 0)))
        self.open += new
        self.done += {(a, b, covered) for a, b, _, covered in new}

    def taken(self, least: float) -> list[tuple[int, int, int]]:
        """(first, last, covered) of chains that cover `least` words, those that cover most first, without any that overlaps one taken."""
        firsts: list[int] = []
        out: list[tuple[int, int, int]] = []
        for a, b, covered in sorted((c for c in self.done if c[2] >= least), key=lambda c: (-c[2], c[1] - c[0], c[0])):
            i = bisect.bisect_left(firsts, a)
            if (i == 0 or out[i - 1][1] < a) and (i == len(out) or b < out[i][0]):
                firsts.insert(i, a)
                out.insert(i, (a, b, covered))
        return out


Span = tuple[str, int, int, int, float]


def spans(text: list[bytes], templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[Span]:
    """(label, first word, last word, words covered, share of the template covered) of the spans that name a license; those of one label do not overlap."""
    return disjoint(template_spans(text, templates))


def disjoint(found: list[Span]) -> list[Span]:
    """For each label the spans that cover most words (of equal ones, the largest share of their template), without any that overlaps one taken: templates of a license have wording in common."""
    taken: dict[str, list[Span]] = defaultdict(list)
    for one in sorted(found, key=lambda x: (-x[3], -x[4], x[2] - x[1], x[1])):
        others = taken[one[0]]
        i = bisect.bisect_left(others, one[1], key=lambda x: x[1])
        if (i == 0 or others[i - 1][2] < one[1]) and (i == len(others) or one[2] < others[i][1]):
            others.insert(i, one)
    return sorted((x for own in taken.values() for x in own), key=lambda x: (x[1], x[0], x[2]))


def template_spans(text: list[bytes], templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[Span]:
    """The same of each template by itself."""
    ids, labels, sizes, automaton = _model(templates)
    known = np.fromiter((ids.get(w, -1) for w in text), np.int32, len(text))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
    chains: dict[int, _Chains] = defaultdict(_Chains)
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - begin < SEED:
            continue
        for last, length, state in automaton.matches(known[begin:end].tolist()):
            places: dict[int, list[int]] = defaultdict(list)
            for name, place in sorted(automaton.ends[state]):
                places[name].append(place)
            for name, at in places.items():
                chains[name].add(begin + last - length + 1, begin + last, at)
    out = []
    for name, found in chains.items():
        least = sizes[name] * (COVER_SHORT if sizes[name] <= SHORT else COVER)
        out += [(labels[name], a, b, covered, min(1.0, covered / sizes[name])) for a, b, covered in found.taken(least)]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def base_places(text: list[bytes]) -> list[tuple[int, str]]:
    """(place of the first word, label) wherever the words of a phrase stand consecutively."""
    out = []
    for phrase, label in PHRASES:
        parts = phrase.encode().split()
        at = -1
        while True:
            try:
                at = text.index(parts[-1], at + 1)
            except ValueError:
                break
            first = at - len(parts) + 1
            if first >= 0 and text[first : at + 1] == parts:
                out.append((first, label))
    return out


def _scan(batches: Iterator[pa.RecordBatch], templates: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64())])
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(struct))]
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = words(value.as_buffer().to_pybytes()) if value.is_valid else []
            base, found = base_places(text), template_spans(text, templates)
            firsts, named = [p for p, _ in base], {label for _, label in base}
            score = max([0.5 * bool(base), *(x[4] for x in found)])
            rows.append((len(text), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(named)), ",".join(sorted(named | {x[0] for x in found})), score, [dict(zip(("label", "first", "last", "covered"), x[:4], strict=True)) for x in disjoint(found)]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], ["doc_id", *(n for n, _ in fields)])


def scan(docs: DataFrame, templates: DataFrame | tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row for each of docs: counts and places of the base rule, all labels, the best share of a template covered, and the spans."""
    if isinstance(templates, DataFrame):
        own = templates.select("label", "text").dropna().distinct()
        # As many rows as there can be words come to the driver.
        templates = tuple(sorted((r.label, r.text) for r in own.where(F.length("text") > 0).limit(MOST_WORDS + 1).collect()))
    if sum(len(words(text.encode())) for _, text in templates) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _scan(batches, templates), RESULT)
