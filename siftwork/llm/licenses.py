"""License scans: templates with optional and replaceable regions, compiled into automata over words.

A template is license wording with <<beginOptional>>...<<endOptional>> around words that may be absent (regions nest)
and <<var;words=a-b>> where any a to b words may stand. Its automaton accepts a run of words whose mandatory wording
matches exactly. A text is searched for a template's longest mandatory phrase, and the automaton runs from each place
before it where a match can begin; texts without the phrase cost one substring search. Places are counted forward, so a
text costs its length once, however often a phrase stands in it.

A null text is empty: no words, null places, empty labels, score 0. Rows repeat as they come; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from siftwork.llm._shared import buffer_of, mapped, only

#: Phrases of whole words and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=2-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<var;words=0-1>> Redistributions of source code must retain the <<beginOptional>>above<<endOptional>> copyright notice, this list of conditions and the following disclaimer.
<<var;words=0-1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """<<var;words=0-1>> Neither the name of <<var;words=1-12>> nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>copyright holders and<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;words=2-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=2-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""

#: Whole public licenses, the notices by which files refer to longer ones, and usual references, with labels. Fixed values.
TEMPLATES = {
    "mit": f"""<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;words=1-16>><<endOptional>> Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. {_WARRANTY}""",
    "bsd-2-clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",
    "isc": """Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1-10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1-10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<var;words=0-1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<var;words=0-1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<var;words=0-1>> This notice may not be removed or altered from any source distribution""",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;words=1-4>> except in compliance with the License. You may obtain a copy of the License at <<beginOptional>>http <<endOptional>><<beginOptional>>https <<endOptional>><<beginOptional>>www <<endOptional>>apache org licenses LICENSE-2.0 <<beginOptional>>txt <<endOptional>><<beginOptional>>html <<endOptional>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License""",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<beginOptional>>http <<endOptional>><<beginOptional>>https <<endOptional>><<beginOptional>>www <<endOptional>>mozilla org MPL 2.0""",
    "gpl-notice": """<<var;words=1-4>> is free software <<beginOptional>>you can redistribute it and/or modify it<<endOptional>> under the terms of the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License as published by the Free Software Foundation, <<beginOptional>>either<<endOptional>> version <<var;words=1-2>> <<beginOptional>>of the License<<endOptional>>""",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction',
    "mit-notice": "<<var;words=1-1>> under the <<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>(Expat)<<endOptional>> License",
    "apache-2.0": "Licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>Version<<endOptional>> 2.0",
    "gnu-gpl": "under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License <<beginOptional>>as published by the Free Software Foundation <<beginOptional>>either<<endOptional>> <<endOptional>> version <<var;words=1-1>>",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC <<var;words=0-1>> 4.0",
    "cc-by-4.0": "licensed under <<beginOptional>>a<<endOptional>> CC BY 4.0",
    "creative-commons": "licensed under a Creative Commons Attribution <<var;words=0-4>> <<beginOptional>>4.0 International<<endOptional>> License",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "spdx-tag": "SPDX-License-Identifier <<var;words=1-1>>",
}

_WORD_BYTE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_list(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTE).split()


def parse(template: str) -> list:
    """A sequence of words (bytes), ("optional", sequence) and ("var", least, most)."""
    stack: list[list] = [[]]
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<beginOptional>>":
            stack.append([])
        elif part == "<<endOptional>>":
            region = stack.pop()
            stack[-1].append(("optional", region))
        elif m := re.fullmatch(r"<<var;words=(\d+)-(\d+)>>", part):
            stack[-1].append(("var", int(m[1]), int(m[2])))
        else:
            stack[-1] += word_list(part)
    if len(stack) != 1:
        raise ValueError(f"regions don't close: {template}")
    return stack[0]


class Automaton:
    """States are numbered; a state has moves on one word, on any word, and free ones."""

    def __init__(self, template: str):
        self.on: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        tree = parse(template)
        self.end = self._build(tree, 0)
        self.phrase, self.before = self._anchor(tree)

    def _state(self) -> int:
        self.on.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.on) - 1

    def _build(self, tree: list, at: int) -> int:
        for x in tree:
            if isinstance(x, bytes):
                nxt = self._state()
                self.on[at][x] = nxt
            elif x[0] == "optional":
                entry, nxt = self._state(), self._state()
                self.free[at] += [entry, nxt]
                self.free[self._build(x[1], entry)].append(nxt)
            else:
                nxt = self._state()
                for k in range(x[2]):
                    if k >= x[1]:
                        self.free[at].append(nxt)
                    step = self._state()
                    self.any[at] = step
                    at = step
                self.free[at].append(nxt)
            at = nxt
        return at

    @staticmethod
    def _anchor(tree: list) -> tuple[bytes, tuple[int, int]]:
        """The longest run of mandatory words, and how few and many words can stand before it."""

        def span(x) -> tuple[int, int]:
            return (1, 1) if isinstance(x, bytes) else (0, sum(span(y)[1] for y in x[1])) if x[0] == "optional" else (x[1], x[2])

        best, k = (0, 0, 0), 0
        while k < len(tree):
            j = k
            while j < len(tree) and isinstance(tree[j], bytes):
                j += 1
            best = max(best, (j - k, -k, j))
            k = max(j, k + 1)
        n, k, j = best[0], -best[1], best[2]
        if not n:
            raise ValueError("a template needs a mandatory word")
        return b" ".join(tree[k:j]), (sum(span(x)[0] for x in tree[:k]), sum(span(x)[1] for x in tree[:k]))

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run from start."""
        states, end = self._closed({0}), None
        for k in range(start, len(words) + 1):
            if self.end in states:
                end = k
            if not states or k == len(words):
                break
            w = words[k]
            states = self._closed({t for s in states for t in (self.on[s].get(w), self.any[s]) if t is not None})
        return end

    def places(self, joined: bytes, words: list[bytes]) -> list[tuple[int, int]]:
        """All (start, end) in words; joined has the words between single spaces."""
        out: dict[int, int | None] = {}
        for k in starts_of(joined, self.phrase):
            for s in range(max(0, k - self.before[1]), k - self.before[0] + 1):
                if s not in out:
                    out[s] = self.match(words, s)
        return sorted((s, e) for s, e in out.items() if e is not None)


def starts_of(joined: bytes, phrase: bytes) -> Iterator[int]:
    """The numbers of the words at which a phrase stands; joined has the words between single spaces."""
    needle, at, k = b" " + phrase + b" ", 0, 0
    i = joined.find(needle)
    while i >= 0:
        k += joined.count(b" ", at, i)
        yield k
        at = i
        i = joined.find(needle, i + 1)


@cache
def automata() -> dict[str, Automaton]:
    return {k: Automaton(v) for k, v in TEMPLATES.items()}


def phrase_places(joined: bytes) -> list[tuple[int, str]]:
    """Where the base phrases stand: first word and label."""
    if b" license " not in joined:
        return []
    return [(k, label) for phrase, label in PHRASES.items() for k in starts_of(joined, phrase.encode())]


def scan_text(text: bytes) -> tuple:
    """n_words, n_base, first, last, base labels, labels, score, template places."""
    words = text.translate(_WORD_BYTE).split()
    joined = b" " + b" ".join(words) + b" "
    base = phrase_places(joined)
    found = [(s, e, k) for k, a in automata().items() for s, e in a.places(joined, words)]
    labels = {label for _, label in base}
    starts = [s for s, _ in base]
    score = 1.0 if found else 0.5 if base else 0.0
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {k for _, _, k in found})), score, sorted(found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df, as query op2 asks, and places: the templates' (label, start, end), words from 0, end exclusive.

    score: 1 where a template is accepted, 0.5 where only a base phrase stands, else 0.
    """
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = buffer_of(b.column(1))
        whole = raw.tobytes()
        rows = [scan_text(whole[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        n, m, first, last, base, labels, score, places = zip(*rows, strict=True) if rows else [()] * 8
        cols = [pa.array(x, t) for x, t in ((n, pa.int64()), (m, pa.int64()), (first, pa.int64()), (last, pa.int64()), (base, pa.string()), (labels, pa.string()), (score, pa.float64()))]
        spots = pa.array([[{"label": k, "start": s, "end": e} for s, e, k in x] for x in places], place)
        return pa.RecordBatch.from_arrays([b.column(0), *cols, spots], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    source = only(df, id_col, text_col, text=text_col)
    kind = source.schema[0].dataType.simpleString()
    return mapped(source, run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, start: int, end: int>>").withColumnRenamed("id", id_col)


def digest(df: DataFrame) -> DataFrame:
    """The columns of query op2."""
    return scan(df).drop("places")


def template_regex(template: str) -> str:
    """The same language as a regex over words, each followed by one space; for checks by another engine."""

    def of(tree: list) -> str:
        out = ""
        for x in tree:
            out += re.escape(x.decode()) + " " if isinstance(x, bytes) else f"(?:{of(x[1])})?" if x[0] == "optional" else f"(?:[^ ]+ ){{{x[1]},{x[2]}}}"
        return out

    return of(parse(template))
