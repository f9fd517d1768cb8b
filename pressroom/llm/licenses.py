"""Licence scans by Dice similarity of word bigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import ALNUM, blocks, combine

# Texts of licences and of the notices that name them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
THRESHOLD = 0.85


class Templates:
    """Bigram sets of the templates, and one sorted list of all their bigrams."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        found = list(blocks(pa.array([t for _, t in templates], pa.string()), ALNUM, lower=True, target=1 << 62))
        block = found[0][2] if found else None
        self.names, self.sets, self.words, self.threshold = [], [], [], threshold
        if block is not None:
            h = block.hashes()
            first, bounds = block.windows(2)
            grams = combine(h, first, 2)
            for i, (name, _) in enumerate(templates):
                own = np.unique(grams[bounds[i] : bounds[i + 1]])
                if len(own):
                    self.names.append(name)
                    self.sets.append(own)
                    self.words.append(int(block.counts[i]))
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, dtype=np.uint64)


def scan(grams: np.ndarray, known: np.ndarray, t: Templates) -> list[tuple[str, float, int, int]]:
    """Best passages of a document's bigrams: (licence, Dice, first word, word after the last).

    Each start takes one pass over as many bigrams as a passage may have, so the work is in proportion to the text.

    A passage of n distinct bigrams can reach the threshold d with a template of m only if
    d / (2 - d) * m <= n <= (2 - d) / d * m and d * (m + n) / 2 are common.  So passages
    begin and end at a bigram of the template, have as many bigrams as it at most, or as that bound
    allows, and templates of which the document holds too few bigrams are skipped.
    """
    place = np.flatnonzero(known)
    found: list[tuple[str, float, int, int]] = []
    if not len(place):
        return found
    held = grams[place]
    # Where each bigram stood last: one is new to a passage if that is before its start.
    order = np.argsort(grams, kind="stable")
    before = np.full(len(grams), -1, dtype=np.int64)
    same = grams[order[1:]] == grams[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    for name, own in zip(t.names, t.sets):
        m, d = len(own), t.threshold
        at = place[np.isin(held, own)]
        least, most = d / (2 - d) * m, int((2 - d) / d * m) + 1
        if len(at) < least:
            continue
        inside = np.zeros(len(grams), dtype=bool)
        inside[at] = True
        enough = np.searchsorted(at, at + most) - np.arange(len(at)) >= least
        i = 0
        for i_start in np.flatnonzero(enough).tolist():
            if i_start < i:
                continue
            s = int(at[i_start])
            new = before[s : s + most] < s
            own_here = inside[s : s + most]
            score = 2 * np.cumsum(new & own_here) / (np.cumsum(new) + m)
            score[~own_here] = 0
            # The highest score; of several passages with it the longest.
            end = len(score) - 1 - int(score[::-1].argmax())
            if score[end] >= d:
                # A run that matched is used up; else the next bigram begins a passage.
                found.append((name, float(score[end]), s, s + end + 2))
                i = int(np.searchsorted(at, s + end + 1))
    # Where passages overlap, the likelier and then the longer one stays.
    kept: list[tuple[str, float, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[1], x[2] - x[3], x[0])):
        if all(x[3] <= y[2] or x[2] >= y[3] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


def _scan(templates: list[tuple[str, str]], threshold: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates, threshold)
        for batch in batches:
            counts: list[int] = []
            out = []
            for _, _, block in blocks(batch.column("text"), ALNUM, lower=True):
                counts += block.counts.tolist()
                first, bounds = block.windows(2)
                grams = combine(block.hashes(), first, 2)
                at = np.minimum(np.searchsorted(t.all, grams), max(0, len(t.all) - 1))
                known = t.all[at] == grams if len(t.all) else np.zeros(len(grams), dtype=bool)
                hits = np.concatenate(([0], np.cumsum(known)))
                for i in range(len(block.counts)):
                    a, b = bounds[i], bounds[i + 1]
                    rows = scan(grams[a:b], known[a:b], t) if hits[b] > hits[a] else []
                    out.append([{"license": n, "dice": s, "first": f, "last": l} for n, s, f, l in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(out, kind)], names=["doc_id", "n_words", "licenses"])

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, licenses, license, dice.

    Texts are normalised to words of letters and digits in lower case; passages are compared with the
    templates (name, text) by the Dice coefficient of their distinct word bigrams.  licenses lists the
    passages of threshold or more as (license, dice, first, last), words [first, last); license
    and dice are those of the likeliest, null without any.  Work is on one row at a time.

    Null or empty texts, and texts of one word, match nothing; templates of fewer than two words are left out.
    Ids may be null or repeated.  Templates are a list in the program, so their size is bounded by it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, licenses array<struct<license:string,dice:double,first:int,last:int>>"
    found = rows.mapInArrow(_scan(TEMPLATES if templates is None else templates, threshold), schema)
    best = F.array_max(F.transform("licenses", lambda x: F.struct(x["dice"].alias("dice"), (x["last"] - x["first"]).alias("n"), (-x["first"]).alias("at"), x["license"].alias("license"))))
    return found.withColumn("_best", best).select("doc_id", "n_words", "licenses", F.col("_best.license").alias("license"), F.col("_best.dice").alias("dice"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "license", F.round("dice", 6).alias("dice"), F.size("licenses").cast("long").alias("n_licenses"))
