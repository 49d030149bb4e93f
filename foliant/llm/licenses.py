"""Licence scan: Dice coefficient over word bigrams against templates.

Whole texts, paragraphs, lines and runs of words are normalised and compared
with licence templates. A coefficient of at least t is possible only if the smaller set has
at least t / (2 - t) of the larger one's size, so templates outside those
bounds are not looked at. A run begins and ends anywhere, so a licence inside a
longer text, also between comment marks, is compared at its own extent; only
templates that share at least that part of their bigrams with the text are
looked for.

Templates are the full texts in ``licence_texts`` and the texts and notices
listed here. A notice that names a version stands for that version alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of the full texts, as published, one file each.
FULL_TEXTS = ("Apache-2.0", "AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
#: Licence ids with their texts or customary notices.
TEMPLATES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Proprietary", "All rights reserved."),
)
#: What stands before "general" in the name of a licence of that family.
FAMILY = ("gnu", "affero", "lesser", "library")
_TOKEN = re.compile(r"[^\W_]+")
_NOTICE = re.compile(r"^[^\w\n(©]*(?:copyright|\(c\)|©).*$", re.IGNORECASE | re.MULTILINE)
_PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")


def every_template() -> tuple[tuple[str, str], ...]:
    """The listed templates and the full texts as they are published."""
    folder = Path(__file__).parent / "licence_texts"
    return (*TEMPLATES, *((name, (folder / f"{name}.txt").read_text(encoding="utf-8")) for name in FULL_TEXTS))


def _words(text: str) -> list[str]:
    return ["license" + w[7:] if w.startswith("licence") else w for w in _TOKEN.findall(text.lower())]


def normalise(text: str) -> list[str]:
    """Words in lower case, without copyright lines and punctuation, with one spelling of licence."""
    return _words(_NOTICE.sub(" ", text))


def spans(text: str) -> list[tuple[int, int]]:
    """Where the words of a text stand in it."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return [m.span() for m in _TOKEN.finditer(lowered)]
    at = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(at[m.start()], at[m.end() - 1] + 1) for m in _TOKEN.finditer(lowered)]


FAMILIES = frozenset((w, "general") for w in FAMILY)


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(words, words[1:], strict=False))


class Templates:
    #: A notice has fewer bigrams than this; its version and its family must agree.
    NOTICE = 60
    #: A template of fewer bigrams counts only in a text that no other fits, and as a clause of its own or behind a copyright mark.
    WEAK = 3
    #: Of a run that is near enough already, the best one's coefficient is told within this.
    CLOSE = 0.005

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        self.sets = [(name, bigrams(normalise(text))) for name, text in templates]
        self.sets = [x for x in self.sets if x[1]]
        # The words before and in a version, and those that tell the family.
        self.version = [{g for g in s if g[1].isdigit()} if len(s) < self.NOTICE else set() for _, s in self.sets]
        self.family = [s & FAMILIES if len(s) < self.NOTICE else None for _, s in self.sets]
        self.of: dict[tuple[str, str], list[int]] = {}
        for i, (_, s) in enumerate(self.sets):
            for g in s:
                self.of.setdefault(g, []).append(i)
        ratio = least / (2 - least)
        self.low = min((len(s) for _, s in self.sets), default=1) * ratio
        self.high = max((len(s) for _, s in self.sets), default=0) / ratio
        self.ratio = ratio
        self.grams = frozenset(self.of)

    def agrees(self, i: int, own: frozenset | set) -> bool:
        """Whether a notice's version and family are those of the bigrams found; a full text may name other licences."""
        return self.version[i] <= own and (self.family[i] is None or self.family[i] == own & FAMILIES)

    def runs(self, text: str) -> Iterator[tuple[int, float, int, int]]:
        """The best run of words for each template that has one: template, coefficient, start and end."""
        words = _words(text)
        shared = Counter(i for g in self.grams.intersection(zip(words, words[1:], strict=False)) for i in self.of[g])
        some = [i for i, k in shared.items() if k >= self.ratio * len(self.sets[i][1]) - 1e-9]
        if not some:
            return
        number: dict[tuple[str, str], int] = {}
        ids = np.array([number.setdefault(g, len(number)) for g in zip(words, words[1:], strict=False)])
        at = spans(text)
        for i in sorted(some):
            own = np.zeros(len(number), bool)
            own[[number[g] for g in self.sets[i][1] if g in number]] = True
            dice, a, b = self.best_run(ids, own, len(self.sets[i][1]))
            if dice >= self.least and self.agrees(i, set(zip(words[a : b + 1], words[a + 1 : b + 2], strict=False))):
                yield i, dice, at[a][0], at[b + 1][1]

    def best_run(self, ids: np.ndarray, own: np.ndarray, size: int) -> tuple[float, int, int]:
        """Coefficient, first and last bigram of the best run for a template of so many bigrams; ``own`` marks those it has.

        A run that begins or ends with a bigram that is not the template's, or
        whose first one comes again in it, is no better than the shorter run,
        so no such run is tried. The smaller set has at least ``ratio`` of the
        larger one's size, and a run has no more bigrams than that allows. A
        run has no more of the template than there is behind its start.

        Nor are starts tried that can be no better. A run from k bigrams
        further on has at most k fewer in all and no more of the template, so
        its coefficient is at most 1 + k / size times that of the run from here
        to the same end. If that one has more bigrams than are allowed, it has
        at most k more of the template than the longest that was tried; if it
        ends behind all that were tried, it has at most k fewer bigrams than
        the longest, and no more of the template than there is. So steps grow
        with the distance from a good start. Once a run is near enough, others are
        sought only if they are nearer by ``CLOSE``, which matters for texts
        that repeat a long template many times; for notices that is no bigram.
        """
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        alike = ids[order][1:] == ids[order][:-1]
        before, after = np.full(n, -1), np.full(n, n)
        before[order[1:][alike]] = order[:-1][alike]
        after[order[:-1][alike]] = order[1:][alike]
        mine = own[ids]
        ahead = np.cumsum((mine & (after == n))[::-1])[::-1]
        best, first, last = 0.0, 0, 0
        most = size / self.ratio + 1e-9
        starts, at = np.flatnonzero(mine), 0
        while at < len(starts):
            a = starts[at]
            if 2 * ahead[a] / (ahead[a] + size) <= best:
                break
            end, width = int(after[a]), int(2 * most) + 64
            while True:
                stop = min(n, a + width)
                fresh = before[a:stop] < a
                seen = np.cumsum(fresh)
                if stop >= end or seen[-1] > most:
                    break
                width *= 2
            held = np.cumsum(fresh & mine[a:stop])
            dice = np.where(fresh & mine[a:stop] & (seen <= most), 2 * held / (seen + size), 0.0)
            b = int(dice[: end - a].argmax())
            if dice[b] > best:
                best, first, last = float(dice[b]), int(a), int(a) + b
            # Below the least a run is not told, so nothing below it is sought either.
            target = best + self.CLOSE if best >= self.least else self.least
            counted = int(np.searchsorted(seen, most, "right")) - 1
            k = size * (target / max(float(dice.max()), 1e-9) - 1)
            if counted < len(seen) - 1:
                k = min(k, (target * (most + size) - 2 * held[counted]) / (2 + target))
            elif stop < n:
                k = min(k, seen[-1] + size - 2 * ahead[a] / target)
            at = max(at + 1, int(np.searchsorted(starts, a + int(max(0.0, k - 1e-6)), "right")))
        held = set(ids[first : last + 1][mine[first : last + 1]].tolist())  # more of these leave the coefficient as it is
        while last + 1 < n and int(ids[last + 1]) in held:
            last += 1
        while first and int(ids[first - 1]) in held:
            first -= 1
        return best, first, last

    def best(self, text: str) -> tuple[int, float] | None:
        """The template nearest to a whole text, and the coefficient."""
        own = bigrams(normalise(text))
        n = len(own)
        if not self.low <= n <= self.high:
            return None
        shared = Counter(i for g in own & self.of.keys() for i in self.of[g])
        some = ((k, i, len(self.sets[i][1])) for i, k in shared.items())
        got = [(2 * k / (n + m), -i) for k, i, m in some if self.ratio * max(n, m) <= min(n, m) + 1e-9 and self.agrees(i, own)]
        top = max(got, default=(0.0, 0))
        return (-top[1], top[0]) if top[0] >= self.least else None

    def found(self, text: str) -> list[tuple[str, float, str, int, int]]:
        """Licence, coefficient, unit, start and end of what a text holds.

        Where licences overlap, the one nearer to its template stands, or of
        equals the one that has more of it; no other is found in its words.
        """
        width = {"text": 0, "paragraph": 1, "line": 2, "run": 3}
        hits: dict[int, tuple] = {}
        for unit, i, j in units(text):
            if hit := self.best(text[i:j]):
                hits[hit[0]] = min(hits.get(hit[0], (0.0, 9, 0, 0, "")), (-hit[1], width[unit], i, j, unit))
        for k, dice, i, j in self.runs(text):
            hits[k] = min(hits.get(k, (0.0, 9, 0, 0, "")), (-dice, width["run"], i, j, "run"))
        out: dict[str, tuple[str, float, str, int, int]] = {}
        taken: list[tuple[int, int]] = []

        def alone(i: int, j: int) -> bool:
            """Whether the words are a clause of their own, or stand behind a copyright mark and its holder, and end there."""
            before, behind = text[text.rfind("\n", 0, i) + 1 : i], text[j : (text.find("\n", j) + 1 or len(text) + 1) - 1]
            ends = not _TOKEN.search(behind) or behind.lstrip()[0] in ".;!?"
            return ends and (not _TOKEN.search(before) or before.rstrip()[-1] in ".:;,!?" or bool(_NOTICE.match(before)))

        weak = lambda k: len(self.sets[k][1]) < self.WEAK
        for k, (dice, _, i, j, unit) in sorted(hits.items(), key=lambda h: (weak(h[0]), h[1][0], -len(self.sets[h[0]][1]), h[1][1:], h[0])):
            if (weak(k) and (out or not alone(i, j))) or any(i < b and a < j for a, b in taken):
                continue
            taken.append((i, j))
            name = self.sets[k][0]
            out.setdefault(name, (name, -dice, unit, i, j))
        return sorted(out.values())


def units(text: str) -> Iterator[tuple[str, int, int]]:
    """The whole text, its paragraphs and its lines."""
    yield "text", 0, len(text)
    for m in _PARAGRAPH.finditer(text):
        if m.end() - m.start() < len(text):
            yield "paragraph", m.start(), m.end()
        at = m.start()
        for line in m[0].split("\n"):
            if len(line) < m.end() - m.start():
                yield "line", at, at + len(line)
            at += len(line) + 1


def scan_licenses(docs: DataFrame, least: float = 0.8, templates: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """``(doc_id, license, dice, unit, start, end)``: the best unit of each licence found in a text.

    Units are the whole text, its paragraphs (between blank lines) and its
    lines, each read whole and without copyright lines, and runs of words
    wherever they begin and end; spans are in code points. Null, empty and
    one-word texts match nothing. Of equal units the widest, then the first,
    wins; of equal templates the first listed. Where licences overlap, the
    nearest one stands. A template of one or two bigrams counts only where no
    other licence is found. Repeated rows give one row each. Ids are read as
    longs. Other columns are not read. ``templates`` defaults to all there are.
    """
    known = docs.sparkSession.sparkContext.broadcast(Templates(templates or every_template(), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "license", "dice", "unit", "start", "end"]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                out += [(doc_id, *hit) for hit in known.value.found(text)] if text else []
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, dice double, unit string, start long, end long")
