"""License scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

A template of L words is compared with every run of L words of the text, across lines and paragraphs, so a licence is found
wherever it stands. A run can only reach the threshold if its number of distinct bigrams is within a factor of the
template's and it holds a bounded share of them: templates of which the whole text holds less are pruned, and texts without
any anchor are passed over, the anchors being words of which every match must hold one. Runs that overlap and match one
template are one finding, of the best run; a finding that overlaps one of a larger template gives way. It is one
projection: no row moves.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The notices and licence texts that are looked for.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "isc": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "bsd-3-clause": [
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
    ],
    "unlicense": [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "bsd": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License."],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
}
NOT_WORD = re.compile(r"[^a-z0-9.]+")
MATCHES = "array<struct<license:string,start:int,words:int,dice:double>>"


def words_of(text: str) -> list[str]:
    """Runs of a-z, 0-9 and dots in lower case, dots at their ends removed."""
    return [w for w in (x.strip(".") for x in NOT_WORD.sub(" ", text.lower()).split()) if w]


class Templates:
    """Templates with their words, distinct bigrams, bounds of sizes and anchors for a threshold."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.known = []
        for name, texts in NOTICES.items():
            for t in texts:
                words = words_of(t)
                self.known.append((name, len(words), set(zip(words, words[1:], strict=False))))
        self.ratio = threshold / (2 - threshold)
        self.bounds = [(math.ceil(len(g) * self.ratio - 1e-9), math.floor(len(g) / self.ratio + 1e-9)) for _, _, g in self.known]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, grams) in enumerate(self.known):
            for g in grams:
                self.holders.setdefault(g, []).append(k)
        self.anchors: list[str] = []
        # A match holds at least ratio of the bigrams: words in more than the rest of them cannot all be missing.
        for _, _, grams in self.known:
            rest = {g for g in grams if not set(g) & set(self.anchors)}
            while len(grams) - len(rest) <= (1 - self.ratio) * len(grams):
                count: dict[str, int] = {}
                for g in rest:
                    for w in set(g):
                        count[w] = count.get(w, 0) + 1
                self.anchors.append(max(count, key=lambda w: (min(len(w), 7), count[w], w)))
                rest = {g for g in rest if self.anchors[-1] not in g}

    def runs(self, k: int, n_words: int, before: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, int]:
        """The Dice coefficient of each run, by its first word, with template k, and the words of a run.

        ``before`` has the place of each bigram's last occurrence before (-1: none); ``hits`` the places of the template's
        bigrams. A bigram counts in the runs that hold it and not an earlier occurrence of it.
        """
        _, length, grams = self.known[k]
        length = min(length, n_words)
        starts = n_words - length + 1

        def distinct(places: np.ndarray) -> np.ndarray:
            low, high = np.maximum(before[places] + 1, places - length + 2), np.minimum(places, starts - 1)
            held = (low <= high) & (low < starts)
            change = np.bincount(low[held], minlength=starts + 1) - np.bincount(high[held] + 1, minlength=starts + 1)
            return np.cumsum(change)[:starts]

        size, shared = distinct(np.arange(len(before))), distinct(hits)
        least, most = self.bounds[k]
        return np.where((size >= least) & (size <= most), 2 * shared / (size + len(grams)), 0.0), length

    def matches(self, text: str) -> list[dict]:
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return []
        words = words_of(text)
        grams = list(zip(words, words[1:], strict=False))
        places: dict[int, list[int]] = {}
        for p, g in enumerate(grams):
            for k in self.holders.get(g, ()):
                places.setdefault(k, []).append(p)
        likely = [k for k, at in places.items() if len({grams[p] for p in at}) >= self.bounds[k][0]]
        if not likely:
            return []
        last: dict[tuple[str, str], int] = {}
        before = np.full(len(grams), -1, np.int64)
        for p, g in enumerate(grams):
            before[p] = last.get(g, -1)
            last[g] = p
        found = []
        for k in sorted(likely):
            dice, length = self.runs(k, len(words), before, np.array(places[k], np.int64))
            good = np.flatnonzero(dice >= self.threshold)
            for part in np.split(good, np.flatnonzero(np.diff(good) >= length) + 1) if len(good) else ():
                s = int(part[np.argmax(dice[part])])
                found.append({"license": self.known[k][0], "start": s, "words": length, "dice": float(dice[s]), "rank": (len(self.known[k][2]), float(dice[s]), -k)})
        meets = lambda x, y: x["start"] < y["start"] + y["words"] and y["start"] < x["start"] + x["words"]
        kept = [x for x in found if not any(y["rank"] > x["rank"] and meets(x, y) for y in found)]
        return sorted(({c: x[c] for c in ("license", "start", "words", "dice")} for x in kept), key=lambda x: (x["start"], x["license"]))


def matches(text: Column, threshold: float) -> Column:
    """The licences that a text holds, as an array of (license, start, words, dice); null counts as empty."""
    templates = Templates(threshold)

    @F.arrow_udf(MATCHES)
    def of(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("dice", pa.float64())]))
        return pa.array([templates.matches(t.as_py() or "") for t in texts], kind)

    return of(text.cast("string"))


def scan(documents: DataFrame, threshold: float = 0.85, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per licence found in a document: id, license, start (its first word, from 0), words and dice of the best run.

    Ties go to the earliest run and the first template. Null and empty texts match nothing; null ids are kept; repeated rows
    each give their rows; an empty table gives an empty result; other columns are left out.
    """
    rows = documents.select(documents[id].alias(id), F.inline(matches(documents[text], threshold)))
    return rows.withColumn("dice", F.round("dice", 6))
