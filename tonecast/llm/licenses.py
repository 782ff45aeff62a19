"""Licence notices in texts: Dice coefficient of word bigrams between windows of a text and licence templates.

Both sides are normalised to lower-cased words of letters and digits, line feeds count as any other gap. A window is a
run of words that begins and ends with a bigram of the template. Its coefficient is twice the bigrams it has in common
with the template over the bigrams of both, each counted as often as it occurs. Sizes bound the search: for a
coefficient of ``dice`` a window has at most (2 - dice) / dice times the template's bigrams, and at least
dice / (2 - dice) of the template's bigrams occur in it, so only places with that many hits within that reach are
looked at. Of each place the best window is taken (the shorter of equals); windows that reach ``dice`` are reported
unless a better one shares a word with them. Better is, in this order: larger coefficient, more words, first template
by name and place in the table, first start.

Edge cases: a null or empty text, or one of a single word, has no window; a text of any length is searched whole, and
windows end at its ends; repeated rows are treated row by row; an empty table gives no row; extra columns pass
through, but a column named ``licenses`` is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tonecast.llm import arrowtext

DICE = 0.8
# fixed values: public licence notices by SPDX name
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain "
                     "the above copyright notice, this list of conditions and the following disclaimer. 2. "
                     "Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided "
                     "with the distribution. 3. Neither the name of the copyright holder nor the names of its "
                     "contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
                     "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
                     "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
                     "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                     "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
                     "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
                     "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
                     "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
                     "THE POSSIBILITY OF SUCH DAMAGE."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 2 of the License, "
                "or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
                "(at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
            "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
            "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
            "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
            "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-2.1": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 2.1 of the License, or "
        "(at your option) any later version."],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not "
        "be removed or altered from any source distribution."],
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
SPAN_SQL = "array<struct<name: string, start: int, end: int, dice: double>>"
SPAN_TYPE = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("dice", pa.float64())]))
ROWS = 4_096  # places whose windows are counted at once; layout only


def bigrams(text: str) -> Counter[tuple[str, str]]:
    words = _WORD.findall(text.translate(_LOWER))
    return Counter(zip(words, words[1:], strict=False))


def ordered(templates: dict[str, list[str]]) -> list[tuple[str, Counter[tuple[str, str]]]]:
    """Name and bigrams of every template that has any, in the order that settles ties."""
    table = [(name, bigrams(t)) for name in sorted(templates) for t in templates[name]]
    return [(name, own) for name, own in table if own]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], dice: float):
        self.dice = dice
        self.names, tables = zip(*ordered(templates), strict=True) if ordered(templates) else ((), ())
        self.words = pa.array(sorted({w for t in tables for pair in t for w in pair}), pa.large_string())
        place = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.counts = [{place[a] * len(place) + place[b]: n for (a, b), n in t.items()} for t in tables]
        self.known = np.array(sorted({k for t in self.counts for k in t}), np.int64)
        self.often = np.zeros((len(tables), len(self.known)), np.int64)  # of each bigram in each template
        for row, t in zip(self.often, self.counts, strict=True):
            row[np.searchsorted(self.known, np.array(list(t), np.int64))] = list(t.values())

    def hits(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words before each text; places (words of all texts in a row) and numbers of the templates' bigrams."""
        codes, words, counts = arrowtext.word_codes(arrowtext.folded(text, arrowtext.ALNUM))
        before = np.concatenate([[0], np.cumsum(counts)])
        if len(codes) < 2 or not len(self.known):
            return before, np.zeros(0, np.int64), np.zeros(0, np.int64)
        coded = pc.fill_null(pc.index_in(words, value_set=self.words.cast(words.type)), -1)
        word = coded.to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        inside = np.ones(len(codes) - 1, bool)
        ends = before[1:-1]
        inside[ends[(ends > 0) & (ends < len(codes))] - 1] = False
        at = np.flatnonzero(inside & (word[:-1] >= 0) & (word[1:] >= 0))
        pair = word[at] * len(self.words) + word[at + 1]
        number = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        same = self.known[number] == pair
        return before, at[same], number[same]

    def windows(self, before: np.ndarray, at: np.ndarray, number: np.ndarray) -> list[tuple[float, int, int, int]]:
        """Coefficient, minus the words, template and first word of the best window of every place that has one."""
        out = []
        for t, often in enumerate(self.often):
            own = often[number] > 0
            place, often = at[own], often[number[own]]
            size = int(self.often[t].sum())
            reach = int(size * (2 - self.dice) / self.dice + 1e-9)
            least = max(1, int(np.ceil(size * self.dice / (2 - self.dice) - 1e-9)))
            if len(place) < least:
                continue
            order = np.lexsort((place, number[own]))
            back = np.arange(len(place)) - often[order]  # the occurrence of the bigram that this one pushes out
            fits = (back >= 0) & (number[own][order][np.maximum(back, 0)] == number[own][order])
            pushed = np.full(len(place), -1, np.int64)
            pushed[order] = np.where(fits, place[order][np.maximum(back, 0)], -1)
            owner = np.searchsorted(before, place, side="right")
            last = np.minimum(np.arange(len(place)) + least - 1, len(place) - 1)
            start = np.flatnonzero((np.arange(len(place)) + least <= len(place)) & (owner[last] == owner)
                                   & (place[last] - place < reach))
            for k in range(0, len(start), ROWS):
                first = start[k:k + ROWS]
                index = first[:, None] + np.arange(reach)
                valid = index < len(place)
                index[~valid] = 0
                long = np.where(valid, place[index] - place[first][:, None] + 1, 1)
                valid &= (owner[index] == owner[first][:, None]) & (long <= reach)
                common = np.cumsum(valid & (pushed[index] < place[first][:, None]), axis=1)
                value = np.where(valid, 2 * common / (long + size), 0.0)
                best = value.argmax(axis=1)  # the first of equals
                rows = np.flatnonzero(value[np.arange(len(first)), best] >= self.dice)
                out += [(value[r, best[r]].item(), -long[r, best[r]].item() - 1, t, place[first[r]].item())
                        for r in rows.tolist()]
        return out

    def notices(self, text: pa.Array) -> list[list[tuple[str, int, int, float]]]:
        """Per text: name, first word, word behind the last one and coefficient of the windows that no better one meets."""
        before, at, number = self.hits(text)
        found: list[list[tuple[str, int, int, float]]] = [[] for _ in range(len(text))]
        kept = unmet(self.windows(before, at, number))
        for value, words, t, a in sorted(kept, key=lambda x: (x[3], x[2])):
            row = int(np.searchsorted(before, a, side="right")) - 1
            found[row].append((self.names[t], a - int(before[row]), a - int(before[row]) - words, value))
        return found


def unmet(windows: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """The windows that share no word with a better one; a window is met by neighbours by start only."""
    rank = sorted(windows, key=lambda x: (-x[0], *x[1:]))
    order = sorted(range(len(rank)), key=lambda i: rank[i][3])
    starts = [rank[i][3] for i in order]
    ends = [a - n for _, n, _, a in rank]
    longest = max((-n for _, n, _, _ in rank), default=0)
    out = []
    for i, (_, _, _, a) in enumerate(rank):
        near = order[bisect_left(starts, a - longest + 1):bisect_right(starts, ends[i] - 1)]
        if not any(j < i and ends[j] > a for j in near):
            out.append(rank[i])
    return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, dice: float = DICE, text: str = "text") -> DataFrame:
    """Add ``licenses``: name, code points (end exclusive) and coefficient of every notice found, by place."""
    table = TEMPLATES if templates is None else templates
    plain = docs.drop("licenses")
    names = plain.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields] + [f"licenses {SPAN_SQL}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table, dice)
        for rows, texts in arrowtext.text_slices(batches, text):
            spans = []
            for r, notices in enumerate(scanner.notices(texts)):
                bounds = [m.span() for m in _WORD.finditer(texts[r].as_py().translate(_LOWER))] if notices else []
                spans.append([{"name": name, "start": bounds[a][0], "end": bounds[b - 1][1], "dice": value}
                              for name, a, b, value in notices])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(spans, SPAN_TYPE)], [*names, "licenses"])
    return plain.mapInArrow(run, schema)
