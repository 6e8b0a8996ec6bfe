"""Licence scans: normalised passages compared with licence templates by the Dice coefficient over word bigrams.

A passage is a run of consecutive sentences. For each template two bounds prune: a
text must hold as many of the template's bigrams as the least match needs, and a run
must have a number of bigrams from which the threshold can be reached at all. What
is left is compared exactly. Runs start and end with sentences that hold a bigram of
the template; others only lower the coefficient.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.common import texts, utf8

THRESHOLD = 0.8

# Public licence texts and notices.
_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
TEMPLATES = {
    "AGPL-3.0": _GPL.format(*["Affero General Public License", "3"], "Affero General Public License"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_NAME + _BSD_END,
    "BSD-3-Clause line": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": _GPL.format("General Public License", "2", "General Public License"),
    "GPL-3.0": _GPL.format("General Public License", "3", "General Public License"),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": _GPL.format("Lesser General Public License", "3", "Lesser General Public License"),
    "MIT": _PERMIT,
    "MIT line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
    "all rights reserved": "All rights reserved.",
}
_WORD = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(rb"\n|(?<=[.!?;:]) ")


def normal_words(text: bytes) -> list[bytes]:
    """Lower-case words and version numbers, without punctuation."""
    return _WORD.findall(text.lower())


def bigrams(words: list[bytes]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    """Twice the shared bigrams, counted as often as both hold them, by all bigrams."""
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values())) if both else 0.0


@dataclass
class Match:
    license: str
    dice: float
    first: int
    last: int


class Scanner:
    """Templates with their bounds, and the words that matter as numbers."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = THRESHOLD):
        self.least = least
        self.grams = {name: bigrams(normal_words(t.encode())) for name, t in templates.items()}
        self.size = {name: sum(g.values()) for name, g in self.grams.items()}
        self.low = {name: -(-n * least // (2 - least)) for name, n in self.size.items()}
        self.high = {name: n * (2 - least) / least + 1e-9 for name, n in self.size.items()}
        words = sorted({w for g in self.grams.values() for pair in g for w in pair})
        self.number = {w: i for i, w in enumerate(words, 1)}
        self.count = len(words) + 1
        code = sorted({self.code(p) for g in self.grams.values() for p in g})
        self.codes = np.array(code)
        held = {name: {self.code(p) for p in g} for name, g in self.grams.items()}
        self.holds = np.array([[c in h for c in code] for h in held.values()])

    def code(self, pair: tuple[bytes, bytes]) -> int:
        return self.number[pair[0]] * self.count + self.number[pair[1]]

    def candidates(self, words: list[bytes]) -> list[str]:
        """Templates of which the words hold enough bigrams for a match of the least size."""
        get = self.number.get
        n = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if len(n) < 2:
            return []
        at = n[:-1] * self.count + n[1:]
        at = at[(n[:-1] > 0) & (n[1:] > 0)]
        if not len(at):
            return []
        place = np.minimum(np.searchsorted(self.codes, at), len(self.codes) - 1)
        place = place[self.codes[place] == at]
        hits = self.holds[:, place].sum(1)
        return [name for name, h in zip(self.grams, hits, strict=True) if h >= self.low[name] and h]

    def scan(self, text: bytes) -> list[Match]:
        """The best run of sentences of each template that reaches the threshold."""
        names = self.candidates(normal_words(text))
        if not names:
            return []
        parts = [normal_words(s) for s in _SENTENCE.split(text)]
        parts = [p for p in parts if p]
        out = []
        for name in names:
            want, found = self.grams[name], None
            pairs = [list(zip(a, a[1:], strict=False)) for a in parts]
            joins = [(a[-1], b[0]) for a, b in zip(parts, parts[1:], strict=False)]
            held = [any(p in want for p in ps) for ps in pairs]
            for i, j in enumerate(joins):
                if j in want:
                    held[i] = held[i + 1] = True
            for i in (i for i, h in enumerate(held) if h):
                run: Counter = Counter()
                n = both = 0
                for j in range(i, len(parts)):
                    for p in ([joins[j - 1]] if j > i else []) + pairs[j]:
                        n += 1
                        if p in want:
                            run[p] += 1
                            both += run[p] <= want[p]
                    if n > self.high[name]:
                        break
                    if held[j] and n >= self.low[name]:
                        d = 2 * both / (n + self.size[name])
                        if d >= self.least and (found is None or d > found.dice):
                            found = Match(name, d, i, j)
            if found:
                out.append(found)
        return sorted(out, key=lambda m: (-m.dice, m.license))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, first_sentence, last_sentence, n_licenses, licenses`` for each row of ``docs (doc_id, text)``.

    ``license`` is the template of the best coefficient (ties: by name) and null
    where none reaches the threshold; ``licenses`` are the names of all that do,
    sorted and joined by ``; ``. Sentences with words count from 0. A null or empty
    text has none; null ids and repeated rows are kept; a text of any length is
    scanned whole; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        scanner = Scanner(templates, least)
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b, rows = whole.slice(lo, 2000), []
                for d, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    m = scanner.scan(t)
                    best = (m[0].license, m[0].dice, m[0].first, m[0].last) if m else (None, 0.0, None, None)
                    rows.append((d, *best, len(m), "; ".join(sorted(x.license for x in m))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "license", "dice", "first_sentence", "last_sentence", "n_licenses", "licenses"])

    return texts(docs).mapInArrow(run, "doc_id long, license string, dice double, first_sentence int, last_sentence int, n_licenses int, licenses string")
