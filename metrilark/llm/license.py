"""Licence scans by Dice coefficient over word bigrams (operator 10).

Texts are normalised to lower-case words. A licence text is looked for in runs of
consecutive words, for notices stand within documents and within lines. A run is compared with a
template by the Dice coefficient of their sets of word bigrams. Two sets reach a
coefficient t only if the smaller has at least t / (2 - t) of the larger's size, which
bounds the runs to compare: only runs of as many bigrams as that are taken, only in texts
that have enough of the template's bigrams at all, and of these only runs whose first and last
bigrams are the template's, as any other run scores less than the shorter one within it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import bounded

LEAST = 0.85
SCHEMA = "doc_id long, license string, dice double, first_line int, last_line int"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""

#: name -> texts: short notices and licence texts.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GPL.replace("GNU General", "GNU Affero General")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE],
    "BSD-2-Clause": [_BSD, _BSD + "\n" + _BSD_END, "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": [_BSD + "\n" + _BSD_3, _BSD + "\n" + _BSD_3 + "\n" + _BSD_END, "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GPL.replace("version 3", "version 2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GPL],
    "ISC": [_ISC, _ISC + "\n" + _ISC_END, "Released under the ISC License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _GPL.replace("GNU General", "GNU Lesser General")],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT, _MIT + "\n" + _MIT_END],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": [_UNLICENSE],
    "Zlib": [_ZLIB],
}


def bigrams(words: list[str]) -> frozenset:
    """Adjacent pairs; a single word is a pair with nothing."""
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w, "") for w in words)


def tokens(text: str) -> list[str]:
    """The words of a text in lower case."""
    return B.WORD.findall(text.lower())


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass
class Templates:
    names: list[str]
    sets: list[frozenset]
    low: list[int]
    high: list[int]
    hashes: np.ndarray  # of all bigrams, sorted
    enough: int  # distinct bigrams of templates without which no run reaches the coefficient

    @classmethod
    def of(cls, texts: dict[str, list[str]], least: float) -> Templates:
        pairs = [(n, bigrams(tokens(t))) for n in sorted(texts) for t in texts[n]]
        sets = [s for _, s in pairs]
        hashes = np.unique(np.array([_pair_hash(a, b) for s in sets for a, b in s], np.uint64))
        low = [int(np.ceil(least / (2 - least) * len(s) - 1e-9)) for s in sets]
        enough = min(int(np.ceil(least * (a + len(s)) / 2 - 1e-9)) for a, s in zip(low, sets))
        return cls([n for n, _ in pairs], sets, low, [int((2 - least) / least * len(s) + 1e-9) for s in sets], hashes, enough)

    def suspicious(self, column: pa.Array) -> np.ndarray:
        """Rows that have enough bigrams of templates."""
        hashes, rows = B.word_hashes(column)
        if len(hashes) < 2:
            return np.zeros(0, np.int64)
        pair = B.mix(hashes[:-1] * np.uint64(3) + hashes[1:], 1)
        at = np.searchsorted(self.hashes, pair)
        hit = (self.hashes[np.minimum(at, len(self.hashes) - 1)] == pair) & (rows[:-1] == rows[1:])
        distinct = np.unique(rows[:-1][hit] * len(self.hashes) + at[hit]) // len(self.hashes)
        row, count = np.unique(distinct, return_counts=True)
        return row[count >= self.enough]

    def scan(self, text: str, least: float) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, last line) of the best runs that don't overlap; ties go to the shorter, then the earlier, then by name."""
        words, line = [], []
        for k, row in enumerate(text.split("\n")):
            more = tokens(row)
            words += more
            line += [k] * len(more)
        pairs = list(zip(words, words[1:]))
        places: dict[tuple[str, str], list[int]] = {}
        for i, pair in enumerate(pairs):
            places.setdefault(pair, []).append(i)
        found: list[tuple[str, float, int, int]] = []
        for name, wanted, low, high in zip(self.names, self.sets, self.low, self.high):
            shared = [p for p in wanted if p in places]
            if len(shared) < np.ceil(least * (low + len(wanted)) / 2 - 1e-9):
                continue  # no run has enough of its bigrams
            ends = sorted(i for p in shared for i in places[p])
            for k, first in enumerate(ends):
                seen: set = set()
                hits: set = set()
                at = first
                for last in ends[k:]:
                    seen.update(pairs[at : last + 1])
                    if len(seen) > high:  # runs only grow
                        break
                    at = last + 1
                    hits.add(pairs[last])
                    score = 2 * len(hits) / (len(seen) + len(wanted))
                    if score >= least and len(seen) >= low:
                        found.append((name, score, first, last + 1))
        taken: list[tuple[str, float, int, int]] = []
        for run in sorted(found, key=lambda r: (-r[1], r[3] - r[2], r[2], r[0])):
            if all(run[3] < t[2] or run[2] > t[3] for t in taken):
                taken.append(run)
        return [(name, score, line[first], line[last]) for name, score, first, last in sorted(taken, key=lambda x: x[2])]


def _pair_hash(a: str, b: str) -> np.uint64:
    x, y = np.array([B.hash_text(a)], np.uint64), np.array([B.hash_text(b) if b else 0], np.uint64)
    return B.mix(x * np.uint64(3) + y, 1)[0]


def licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """``doc_id, license, dice, first_line, last_line`` (from 0) of the licence texts in ``docs(doc_id, text, ...)``.

    Runs of words that reach ``least`` with a template are taken by falling
    coefficient, without those that overlap one taken before; ties go to the shorter
    run, then to the earlier, then to the first licence by name. Null, empty and wordless texts
    have none. Of a long text only the places with bigrams of a template that it has enough of are compared. Repeated rows report theirs once each, with their doc_id or null. Other
    columns are ignored. An empty table gives an empty result.
    """
    wanted = Templates.of(templates or TEMPLATES, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in B.pieces(batches):
            at = wanted.suspicious(piece.column("text"))
            texts = piece.column("text").take(pa.array(at)).to_pylist()
            found = [(k, *f) for k, text in zip(at, texts) for f in wanted.scan(text, least)]
            row, name, score, first, last = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row, pa.int64())), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["doc_id", "license", "dice", "first_line", "last_line"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
