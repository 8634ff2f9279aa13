"""License scans: winnowed fingerprints find candidates, banded alignment reports what matches.

Words are runs of letters and digits, A-Z in lower case. An inverted index holds the winnowed K-word
fingerprints of the templates with their places; the templates are the query set, so the index is
bounded by them and goes to every task. A text's own winnowed fingerprints look up (template, place)
hits, which are chained: within a chain both places rise and consecutive hits lie at most ``gap`` words
out of step, so a template is followed over words put in or left out. Between two hits the words are
aligned inside the band of their shifts, SLACK words wider; before the first and after the last one the
alignment runs on while it gains. Any run of K + WINDOW - 1 equal words is a hit.

Of templates whose spans overlap the one with the most words matched, less those missing, is reported;
a template's ``needs`` (a version, a restriction) must be among the words of the span.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.llm._words import blocks, mix, tidy, words

K, WINDOW, SLACK, GAP = 3, 2, 2, 100
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Template:
    """A license's name, a text it is recognised by, and words without which the text is another license's."""

    name: str
    text: str
    needs: tuple[str, ...] = ()


# License texts and the notices that licenses recommend.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_REST = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_CC = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}


def _creative_commons() -> list[Template]:
    out = []
    for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        terms = code.split("-")
        long = [_CC[t] for t in terms]
        out += [Template(f"CC-{code}-4.0", f"Licensed under CC {code} 4.0.", (*terms, "4")), Template(f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {'-'.join(long)} 4.0 International License.", (*long, "4"))]
    return out


TEMPLATES: tuple[Template, ...] = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2")), Template("Apache-2.0", _APACHE, ("apache", "2")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("3",)), Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("2",)),
    Template("GPL-3.0", _GNU, ("3",)), Template("GPL-2.0", _GNU.replace("version 3", "version 2"), ("2",)),
    Template("LGPL-3.0", _GNU.replace("General", "Lesser General"), ("lesser", "3")), Template("AGPL-3.0", _GNU.replace("General", "Affero General"), ("affero", "3")),
    Template("MIT", "Released under the MIT License.", ("mit",)), Template("MIT", _MIT_GRANT + _MIT_REST), Template("MIT", _MIT_GRANT),
    Template("BSD-3-Clause", _BSD_START + _BSD_TWO + _BSD_THIRD + _BSD_END, ("endorse",)), Template("BSD-2-Clause", _BSD_START + _BSD_TWO + _BSD_END), Template("BSD", _BSD_START),
    Template("ISC", _ISC), Template("Zlib", _ZLIB), Template("MPL-2.0", _MPL, ("mozilla", "2")),
    Template("MPL-2.0", _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla", "2")),
    *_creative_commons(),
)


def read_templates(spark: SparkSession, folder: str, most_bytes: int = 20_000_000) -> list[Template]:
    """Whole license texts from the text files of a folder, named by their file names; together they have ``most_bytes`` at most, since every task gets them."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value")
    total = files.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if total > most_bytes:
        raise ValueError(f"templates of {total} bytes; at most {most_bytes} go to every task")
    return [Template(r["name"], r["value"]) for r in files.orderBy("name").collect()]


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), letters=_LETTERS).hashes()


def grams(h: np.ndarray) -> np.ndarray:
    """Hash of each run of K words."""
    n = max(0, len(h) - K + 1)
    out = np.zeros(n, np.uint64)
    for j in range(K):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def winnow(g: np.ndarray) -> np.ndarray:
    """Places of the least gram of each window of WINDOW; all places of shorter runs."""
    if len(g) <= WINDOW:
        return np.arange(len(g))
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    return np.unique(np.arange(len(view)) + view.argmin(1))


@dataclass
class Index:
    """Templates' words, and their fingerprints in ascending order with (template, place)."""

    names: list[str]
    texts: list[np.ndarray]
    needs: list[np.ndarray]
    gram: np.ndarray
    template: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, templates: Sequence[Template]) -> Index:
        texts = [_hashes(t.text) for t in templates]
        rows = [(int(g[p]), i, p) for i, g in enumerate(map(grams, texts)) for p in winnow(g).tolist()]
        rows.sort()
        return cls([t.name for t in templates], texts, [_hashes(" ".join(t.needs)) for t in templates], *(np.array([r[j] for r in rows], k) for j, k in ((0, np.uint64), (1, np.int64), (2, np.int64))))


def banded(a: np.ndarray, b: np.ndarray, low: int, high: int) -> int:
    """The most words of ``a`` that have equals in ``b`` in the same order, each shifted (place in b minus place in a) by low..high."""
    if not len(a) or not len(b):
        return 0
    width = high - low + 1
    last = np.zeros(width + 1, np.int64)  # at shift low + d; one more at the end
    for i in range(len(a)):
        j = np.arange(i + low, i + high + 1)
        inside = (j >= 0) & (j < len(b))
        same = np.zeros(width, np.int64)
        same[inside] = b[j[inside]] == a[i]
        # From one word of a to the next the same place of b is one shift lower.
        last[:width] = np.maximum.accumulate(np.maximum(last[1:], last[:width] + same))
        last[width] = 0
    return int(last.max())


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(equal words, words of b) of the best alignment from the start of both on: equal words gain 1, others cost 1; SLACK words out of step at most."""
    width, none = 2 * SLACK + 1, -(10**9)
    score = [0 if d == SLACK else -abs(d - SLACK) if d > SLACK else none for d in range(width)]
    equal = [0] * width
    best, found = 0, (0, 0)
    for i in range(len(a)):
        new, more = [none] * width, [0] * width
        for d in range(width):
            j = i + d - SLACK
            if 0 <= j < len(b):
                same = bool(a[i] == b[j])
                new[d], more[d] = score[d] + (1 if same else -1), equal[d] + same
            if d + 1 < width and score[d + 1] - 1 > new[d]:
                new[d], more[d] = score[d + 1] - 1, equal[d + 1]
            if d and new[d - 1] - 1 > new[d]:
                new[d], more[d] = new[d - 1] - 1, more[d - 1]
            if new[d] > best:
                best, found = new[d], (more[d], j + 1)
        score, equal = new, more
        if max(score) + len(a) - 1 - i <= best:  # nothing left can gain
            break
    return found


def aligned(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]]) -> tuple[int, int, int]:
    """(equal words, first, last + 1 in b) of template ``a`` in text ``b`` along a chain of hits (place in a, place in b)."""
    q, p = chain[0]
    head, back = extend(a[:q][::-1], b[max(0, p - q - SLACK) : p][::-1])
    equal, at_a, at_b = head, q, p
    for q, p in chain:
        skip = max(0, at_a - q, at_b - p)  # words of this hit that earlier ones have already
        if skip < K:
            q, p = q + skip, p + skip
            shift = (q - at_a) - (p - at_b)
            equal += banded(a[at_a:q], b[at_b:p], min(0, -shift) - SLACK, max(0, -shift) + SLACK) + K - skip
            at_a, at_b = q + K - skip, p + K - skip
    tail, on = extend(a[at_a:], b[at_b : at_b + len(a) - at_a + SLACK])
    return equal + tail, chain[0][1] - back, at_b + on


def chains(hits: list[tuple[int, int]], length: int, gap: int) -> list[list[tuple[int, int]]]:
    """Hits (place in the template, place in the text) of one template dealt to occurrences; each joins the open one it is least out of step with."""
    done: list[list[tuple[int, int]]] = []
    open_: list[list[tuple[int, int]]] = []
    for q, p in sorted(hits, key=lambda x: (x[1], x[0])):
        still = [c for c in open_ if p - c[-1][1] <= length + gap]
        done += [c for c in open_ if p - c[-1][1] > length + gap]
        open_ = still
        off = [(abs((p - c[-1][1]) - (q - c[-1][0])), i) for i, c in enumerate(open_) if p > c[-1][1] and q > c[-1][0]]
        if off and min(off)[0] <= gap:
            open_[min(off)[1]].append((q, p))
        else:
            open_.append([(q, p)])
    return done + open_


def matches(h: np.ndarray, index: Index, least: float, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """(template, equal words, first word, last word + 1) of a text given by its words' hashes, in text order."""
    g = grams(h)
    at = winnow(g)
    left, right = np.searchsorted(index.gram, g[at], "left"), np.searchsorted(index.gram, g[at], "right")
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i in np.flatnonzero(right > left).tolist():
        for k in range(left[i], right[i]):
            hits[int(index.template[k])].append((int(index.place[k]), int(at[i])))
    found = []
    for t, some in hits.items():
        a = index.texts[t]
        for chain in chains(some, len(a), gap):
            equal, first, last = aligned(a, h, chain)
            if equal >= least * len(a) and np.isin(index.needs[t], h[first:last]).all():
                found.append((t, equal, first, last))
    # Spans that are taken do not overlap, so only the two beside a new one can.
    taken: list[tuple[int, int, int, int]] = []
    for row in sorted(found, key=lambda r: (len(index.texts[r[0]]) - 2 * r[1], r[2], r[0])):
        i = bisect_right(taken, row[2], key=lambda r: r[2])
        if (i == 0 or taken[i - 1][3] <= row[2]) and (i == len(taken) or row[3] <= taken[i][2]):
            taken.insert(i, row)
    return taken


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, least: float = 0.8, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each template found in a row: ``doc_id, license, matched_words, template_words, coverage, start_char, end_char, span``.

    A template is found where at least ``least`` of its words are aligned, with at most ``gap`` words put in
    or left out at one place; the span is counted in code points and ``span`` is its text. Spans of a row do
    not overlap. Null and empty texts give no row, repeated rows and rows without an id give theirs each.
    Templates of under K words are never found. Other columns are not read.
    """
    index = Index.of(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            for a, b, data, offsets in blocks(batch.column(1)):
                w = words(data, offsets, letters=_LETTERS)
                h = w.hashes()
                # Texts without any template fingerprint are passed over at once.
                all_grams = grams(h)
                near = np.flatnonzero(np.isin(all_grams, index.gram)) if len(all_grams) else np.zeros(0, np.int64)
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if len(near) else np.zeros(0, np.int64)  # code points before each byte
                for d in np.unique(np.searchsorted(w.bounds, near, "right") - 1).tolist():
                    p, q = int(w.bounds[d]), int(w.bounds[d + 1])
                    for t, equal, first, last in matches(h[p:q], index, least, gap):
                        s, e = int(w.start[p + first]), int(w.end[p + last - 1])
                        begin = int(points[s] - points[offsets[d]])
                        span = data[s:e].tobytes().decode("utf-8", "replace")
                        n = len(index.texts[t])
                        rows.append((ids[a + d].as_py(), index.names[t], equal, n, equal / n, begin, begin + len(span), span))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "matched_words", "template_words", "coverage", "start_char", "end_char", "span"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda it: tidy(run(it)), "doc_id long, license string, matched_words long, template_words long, coverage double, start_char long, end_char long, span string")
