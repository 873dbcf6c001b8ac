"""License scans: winnowed fingerprints of templates in an inverted index, and single words of short ones, pick
candidates, and banded alignment of word sequences reports how much of a template a text holds and where.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.batches import add_columns

# Public notices by SPDX identifier, in their published wording; several wordings may share one.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
]
# End of fixed values.

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class LicensePolicy:
    """k: words of a fingerprinted gram. window: grams of which winnowing keeps one, so any shared run of
    k + window - 1 words is found. band: how far an alignment may leave its diagonal, in words. min_coverage: the
    least share of a template's words that must match. short: templates of up to so many words are also found by
    single words, whatever stands between them. max_index: most fingerprints of all templates, checked."""

    k: int = 4
    window: int = 2
    band: int = 6
    min_coverage: float = 0.8
    max_index: int = 1_000_000
    short: int = 12


def words_with_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def winnow(words: list[str], k: int, window: int) -> list[tuple[tuple, int]]:
    """(gram, place) of the smallest hash of each window, the rightmost of equals; a short text keeps its one gram."""
    grams = [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    codes = [hash_of(g) for g in grams]
    kept = {max(range(i, min(i + window, len(grams))), key=lambda j: (-codes[j], j)) for i in range(max(1, len(grams) - window + 1))}
    return [(grams[i], i) for i in sorted(kept)]


def hash_of(gram: tuple) -> int:
    """A hash that is the same in every process."""
    h = 1469598103934665603
    for b in " ".join(gram).encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def align(a: list[str], b: list[str], shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first and last place in ``b`` that match, end exclusive) of the best alignment of template
    ``a`` with ``b`` in which a's word i meets b's words from i + shift - band to i + shift + band.

    Words match or are skipped on either side; of alignments with as many matches, the shortest in ``b``, the first of
    equals.
    """
    best: dict[int, tuple[int, int]] = {}
    zero, top = (0, 0), (0, 0, 0)
    for i, w in enumerate(a):
        row: dict[int, tuple[int, int]] = {}
        left = zero
        for j in range(max(0, i + shift - band), min(len(b), i + shift + band + 1)):
            cell = max(best.get(j, zero), left)
            if b[j] == w:
                n, start = best.get(j - 1, zero)
                met = (n + 1, start if n else j)
                cell = max(cell, met)
                top = max(top, (met[0], met[1] - j - 1, -met[1]))
            row[j] = left = cell
        best = row
    n, span, start = top
    return n, -start, -start - span


class TemplateIndex:
    def __init__(self, templates: list[tuple[str, str]], policy: LicensePolicy) -> None:
        self.policy, self.templates = policy, []
        self.index: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for n, (name, text) in enumerate(templates):
            words = words_with_spans(text)[0]
            if not words:
                raise ValueError(f"template {name} has no words")
            self.templates.append((name, words))
            for gram, place in winnow(words, policy.k, policy.window):
                self.index[gram].append((n, place))
        self.bags = [Counter(words) for _, words in self.templates]
        self.anchors: dict[str, list[tuple[int, int]]] = defaultdict(list)
        #: By short template, the words that only its license has, where they are few: its name.
        self.names: dict[int, set[str]] = {}
        owners, uses = defaultdict(set), Counter()
        for name, words in self.templates:
            uses.update(words)
            for w in words:
                owners[w].add(name)
        for n, (_, words) in enumerate(self.templates):
            if len(words) <= policy.short:
                self._anchor(n, words, [i for i, w in enumerate(words) if len(owners[w]) == 1], uses)
        if sum(map(len, self.index.values())) + sum(map(len, self.anchors.values())) > policy.max_index:
            raise ValueError("the templates' index exceeds max_index")
        self.first = {g[0] for g in self.index}
        self.sizes = sorted({len(g) for g in self.index})

    def _anchor(self, n: int, words: list[str], own: list[int], uses: Counter) -> None:
        """Of more words than a match may lack, one is matched; so is each word of the name, as no other license may
        pass for this one."""
        rare = lambda i: (uses[words[i]], -len(words[i]), i)
        if own and 3 * len(own) <= len(words):
            self.names[n] = {words[i] for i in own}
            one = words[min(own, key=rare)]
            places = [i for i in own if words[i] == one]
        else:
            least = sum(k < self.policy.min_coverage * len(words) for k in range(len(words) + 1))
            places = sorted(range(len(words)), key=rare)[: len(words) - least + 1]
        for i in places:
            self.anchors[words[i]].append((n, i))

    def _may(self, n: int, words: list[str], low: int, high: int) -> bool:
        """Whether a window holds enough of the template's words, in any order."""
        least, have = self.policy.min_coverage * len(self.templates[n][1]), 0
        room = dict(self.bags[n])
        for w in words[low:high]:
            left = room.get(w, 0)
            if left:
                room[w] = left - 1
                have += 1
        return have >= least

    def _search(self, n: int, words: list[str], low: int, high: int, shift: int, band: int, named: bool) -> list[tuple[int, int, int]]:
        """(matched words, first and last word, end exclusive) of the template's matches within a window, in order."""
        template, out = self.templates[n][1], []
        if high - low < self.policy.min_coverage * len(template):
            return out
        matched, a, b = align(template, words[low:high], shift - low, band)
        if matched < self.policy.min_coverage * len(template):
            return out
        a, b = low + a, low + b
        if not named or self.names.get(n, set()) <= set(words[a:b]):
            out.append((matched, a, b))
        return [*self._search(n, words, low, a, shift, band, named), *out, *self._search(n, words, b if out else a + 1, high, shift, band, named)]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(name, coverage, start, end) of each match, in code points, by start. Of matches that overlap, those with
        more matched words stay."""
        p = self.policy
        words, spans = words_with_spans(text)
        hits: dict[int, set[int]] = defaultdict(set)
        grams: dict[int, set[int]] = defaultdict(set)
        for i, w in enumerate(words):
            for n, place in self.anchors.get(w, ()):
                hits[n].add(i - place)
            if w in self.first:
                for size in self.sizes:
                    if i + size <= len(words):
                        for n, place in self.index.get(tuple(words[i : i + size]), ()):
                            hits[n].add(i - place)
                            grams[n].add(i - place)
        found = []
        for n, shifts in hits.items():
            name, template = self.templates[n]
            # Neighbouring starts of a long template are one search with a band over all of them, so that a text full of
            # its words takes no more searches than it has bands; two copies can't start so near each other. Short ones
            # are looked for from each start.
            near = p.band if p.min_coverage * len(template) > 3 * p.band else 0
            block: list[int] = []
            for s in [*sorted(shifts), None]:
                if block and (s is None or s - block[0] > near):
                    # Any alignment that meets one of the starts within its own band lies in this one.
                    band, middle = (2 if near else 1) * p.band + (block[-1] - block[0] + 1) // 2, (block[0] + block[-1]) // 2
                    low, high = max(0, middle - band), min(len(words), middle + len(template) + band + 1)
                    if self._may(n, words, low, high):
                        named = not any(x in grams[n] for x in block)
                        found += [(matched, name, matched / len(template), spans[a][0], spans[b - 1][1]) for matched, a, b in self._search(n, words, low, high, middle, band, named)]
                    block = []
                block.append(s)
        out: list[tuple[int, int, str, float]] = []
        for _, name, coverage, a, b in sorted(found, key=lambda x: (-x[0], -x[2], x[3], x[1])):
            at = bisect(out, (a,))
            if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or b <= out[at][0]):
                out.insert(at, (a, b, name, coverage))
        return [(name, coverage, a, b) for a, b, name, coverage in out]


_MATCH = T.StructType(
    [T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, policy: LicensePolicy = LicensePolicy()) -> DataFrame:
    """``docs`` with licenses: an array of (license, coverage, start, end), code points, end exclusive, by start.

    ``templates``: (name, text), by default :data:`TEMPLATES`; their index is small, checked and goes to every task.
    Null or empty text: an empty array. Empty table: no rows. Repeated rows are scanned alike. A column named
    licenses is replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates or TEMPLATES, policy))

    def make(texts: list) -> list[pa.Array]:
        index = shared.value
        rows = [index.scan(t) if t else [] for t in texts]
        return [pa.array([[dict(zip(("license", "coverage", "start", "end"), x, strict=True)) for x in r] for r in rows], _ARROW)]

    return add_columns(docs, text, [T.StructField("licenses", T.ArrayType(_MATCH))], make)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = scan_licenses(docs).drop("text")
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], F.round(x["coverage"], 4), x["start"], x["end"])), ",")
    return rows.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), spans.alias("spans"))


QUERIES = {"op2_licenses": op2_licenses}
ORACLES: dict = {}
