"""Licence scans: word-bigram Dice coefficient of segments of a text against licence templates.

Segments are every line, every block of lines between blank lines and the
whole text. A segment can reach the threshold only with a size within bounds
that depend on the template's size, and only with enough bigrams of the
templates' own; both are checked on arrays before any set is built.

Passages are runs of words anywhere in a text, over lines and blocks: they
begin and end at bigrams of a template and are at most its size bound long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import load, text_of, without

THRESHOLD = 0.9
# The wording of public licences and of their usual notices.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES |= {
    "BSD-3-Clause": TEMPLATES["BSD-2-Clause"] + _BSD_3,
    "BSD warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "MIT warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "AGPL-3.0 header": TEMPLATES["GPL-3.0 header"].replace("GNU General", "GNU Affero General"),
    "LGPL-3.0 header": TEMPLATES["GPL-3.0 header"].replace("GNU General", "GNU Lesser General"),
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
}
#: Whole licences, a text file for each beside this module.
WHOLE = "licence_texts"


@lru_cache(maxsize=1)
def all_templates() -> dict[str, str]:
    """TEMPLATES and the whole licences: what a scan looks for unless it is told otherwise."""
    folder = resources.files(__package__).joinpath(WHOLE)
    return TEMPLATES | {f.name.removesuffix(".txt"): f.read_text() for f in folder.iterdir() if f.name.endswith(".txt")}

#: Normal form: A-Z lower-cased, letters, digits and bytes over 127 kept, all else a gap.
_NORMAL = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _NORMAL[_b] = _b + 32 if 65 <= _b <= 90 else _b
MATCH = "array<struct<line:int,kind:string,license:string,score:double>>"


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    normal = _NORMAL[data]
    start, end, row = K.words(normal, offs)
    return K.span_hash(K.prefix_sums(normal), start, end), start, row


def _bigrams(h: np.ndarray) -> np.ndarray:
    return K.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def _templates(texts: dict[str, str]) -> list[tuple[str, np.ndarray]]:
    out = []
    for name in sorted(texts):
        data = np.frombuffer(texts[name].encode(), np.uint8)
        out.append((name, np.unique(_bigrams(_words(data, np.array([0, len(data)]))[0]))))
    return out


def _best(segment: np.ndarray, templates: list[tuple[str, np.ndarray]], threshold: float) -> tuple[str, float] | None:
    """The template of the highest Dice coefficient at or over threshold; among equals the first by name."""
    own, found = np.unique(segment), None
    for name, bigrams in templates:
        n, m = len(own), len(bigrams)
        if 2 * min(n, m) < threshold * (n + m):  # size bound
            continue
        score = 2 * len(np.intersect1d(own, bigrams, assume_unique=True)) / (n + m)
        if score >= threshold and (found is None or score > found[1]):
            found = name, score
    return found


def _passages(bi: np.ndarray, templates: list[tuple[str, np.ndarray]], threshold: float) -> list[tuple[int, str, float]]:
    """(first bigram, template, score) of one text's passages. Of those that overlap, the one with most bigrams in common stays."""
    previous = np.full(len(bi), -1)  # where a bigram was before: it counts once in a passage
    order = np.argsort(bi, kind="stable")
    again = np.flatnonzero(bi[order[1:]] == bi[order[:-1]]) + 1
    previous[order[again]] = order[again - 1]
    found = []
    for name, bigrams in templates:
        m = len(bigrams)
        width = int(np.ceil(m * (2 - threshold) / threshold)) + m // 8 + 1  # the size bound, and room for bigrams that recur
        hit = bigrams[np.minimum(np.searchsorted(bigrams, bi), m - 1)] == bi
        sums = np.r_[0, np.cumsum(hit)]
        at = np.flatnonzero(hit)
        at = at[sums[np.minimum(at + width, len(bi))] - sums[at] >= threshold * m / (2 - threshold) - 1e-9]
        for i in at:
            new = previous[i : i + width] < i
            both = np.cumsum(new & hit[i : i + width])
            score = 2 * both / (np.cumsum(new) + m)
            j = int(np.argmax(score))
            if score[j] >= threshold:
                found.append((-int(both[j]), -float(score[j]), name, int(i), int(i) + j))
    taken = np.zeros(len(bi), bool)
    out = []
    for _, score, name, i, j in sorted(found):
        if not taken[i : j + 1].any():
            taken[i : j + 1] = True
            out.append((i, name, -score))
    return sorted(out)


def _scan(templates: list[tuple[str, np.ndarray]], threshold: float):
    known = np.unique(np.concatenate([b for _, b in templates]))
    sizes = [len(b) for _, b in templates]
    # A segment's distinct bigrams are known ones for threshold / 2 of its and the template's sizes together.
    least_hits = max(1, int(np.ceil(threshold * min(sizes) / 2)))

    def rows(data: np.ndarray, offs: np.ndarray) -> tuple[list[list[dict]], list[list[dict]]]:
        out: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
        passages: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
        h, start, row = _words(data, offs)
        if len(h) < 2:
            return out, passages
        bi = _bigrams(h)
        slot = np.minimum(np.searchsorted(known, bi), len(known) - 1)
        hit = np.r_[0, np.cumsum((known[slot] == bi) & (row[1:] == row[:-1]))]
        ls, le, lrow = K.lines(data, offs)
        lo, hi = np.searchsorted(start, ls), np.searchsorted(start, le)
        number = np.arange(len(lrow)) - np.searchsorted(lrow, lrow)
        full = np.flatnonzero(hi > lo)
        # Blocks of several lines, and whole texts of several blocks, as word ranges.
        new = np.r_[True, (np.diff(full) > 1) | (np.diff(lrow[full]) > 0)] if len(full) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(full)] - 1 if len(first) else first
        many = last > first
        text_lo, text_hi = np.searchsorted(row, np.arange(len(offs) - 1)), np.searchsorted(row, np.arange(len(offs) - 1), "right")
        blocks = np.bincount(lrow[full[first]], minlength=len(offs) - 1) if len(first) else np.zeros(len(offs) - 1, int)
        wide = np.flatnonzero(blocks > 1)
        kinds = (
            ("line", lrow[full], number[full], lo[full], hi[full]),
            ("block", lrow[full[first[many]]], number[full[first[many]]], lo[full[first[many]]], hi[full[last[many]]]),
            ("text", wide, np.zeros(len(wide), int), text_lo[wide], text_hi[wide]),
        )
        for kind, own, line, a, b in kinds:
            for i in np.flatnonzero((b - a > 1) & (hit[np.maximum(b - 1, a)] - hit[a] >= least_hits)):
                if found := _best(bi[a[i] : b[i] - 1], templates, threshold):
                    out[own[i]].append({"line": int(line[i]), "kind": kind, "license": found[0], "score": found[1]})
        for r in np.flatnonzero(text_hi - text_lo > 1):
            if hit[text_hi[r] - 1] - hit[text_lo[r]] < least_hits:
                continue
            for i, name, score in _passages(bi[text_lo[r] : text_hi[r] - 1], templates, threshold):
                line = np.count_nonzero(data[offs[r] : start[text_lo[r] + i]] == 10)
                passages[r].append({"line": int(line), "kind": "passage", "license": name, "score": score})
        return out, passages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("kind", pa.string()), ("license", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            both = [rows(data, offs) for _, _, data, offs in K.chunks(batch.column(batch.schema.get_field_index("__t")))]
            found, passages = ([m for part in both for m in part[k]] for k in (0, 1))
            rest = [c for c in batch.schema.names if c != "__t"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(found, kind), pa.array(passages, kind)], [*rest, "matches", "passages"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with matches: segments whose best template has a Dice coefficient of threshold or more.

    passages has the same of runs of words anywhere in the text, which may
    begin and end within lines; none overlap. line is the first line, from 0. Segments of fewer than two words
    match nothing; null and empty texts have none. Ties between templates go
    to the first by name. Rows are independent, so repeated rows, null ids and
    empty tables need no rule; texts of any length are taken whole. Columns
    named matches or passages are replaced, others kept.
    """
    docs = without(docs, ["matches", "passages", "__t"])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], f"matches {MATCH}", f"passages {MATCH}"])
    return docs.withColumn("__t", text_of()).mapInArrow(_scan(_templates(templates or all_templates()), threshold), schema)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    best = F.expr("array_sort(matches, (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.license < b.license then -1 when a.license > b.license then 1 else 0 end)[0]")
    docs = license_scan(docs).withColumn("n_matches", F.size("matches").cast("long")).withColumn("n_passages", F.size("passages").cast("long"))
    # Texts that no segment matches go by their passages.
    docs = docs.withColumn("licenses", F.array_sort(F.array_distinct(F.concat("matches.license", "passages.license"))))
    docs = docs.withColumn("matches", F.when(F.col("n_matches") > 0, F.col("matches")).otherwise(F.col("passages"))).withColumn("best", F.when(F.size("matches") > 0, best))
    return docs.select(
        "doc_id", "n_matches", F.col("best.license").alias("license"), F.col("best.score").alias("score"), F.col("best.line").cast("long").alias("first_line"), "n_passages", "licenses"
    )
