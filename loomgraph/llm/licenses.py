"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment measures them.

Templates are public license notices and grants. Their winnowed 3-word hashes are an inverted index (of fixed size,
sent to the executors). A text's 3-word hashes that are in the index vote for a template and a diagonal; around each
voted diagonal a banded word alignment finds how many template words match in order. A template is reported if the
matched share of its words, its coverage, is at least 0.8 somewhere, with the spans of all such places. Words that tell
a license from its kin (name, version) must be among them.

Winnowing keeps the least hash of each window, so any run of ``K + KEEP - 1`` template words in a text has an indexed
hash. Texts are compared by words without case and punctuation.

Defined cases: a null, empty or wordless text matches nothing and has no row; a template found at several places has one
row with several spans; overlapping places merge; repeated rows give repeated rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trimmed

K, KEEP, BAND, COVERAGE = 3, 2, 8, 0.8

# Wording of public license notices and grants, by license.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "EPL-1.0": (
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ),
}

# Words that tell a license from its kin. Where a template holds one of its license's phrases, a place
# must hold it too, in unbroken order.
TELLING: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license",),
    "Apache-2.0": ("apache license", "2.0"),
    "GPL-3.0": ("gnu general public license", "version 3"),
    "GPL-2.0": ("gnu general public license", "version 2"),
    "AGPL-3.0": ("gnu affero general public license", "version 3"),
    "LGPL": ("gnu lesser general public license",),
    "LGPL-3.0": ("gnu lesser general public license", "version 3"),
    "LGPL-2.1": ("gnu lesser general public license", "version 2.1"),
    "MPL-2.0": ("mozilla public license", "2.0"),
    "EPL-1.0": ("eclipse public license v1.0",),
    "EPL-2.0": ("eclipse public license", "2.0"),
    "BSL-1.0": ("boost software license", "1.0"),
    "CC0-1.0": ("cc0 1.0",),
    "CC-BY-4.0": ("cc by 4.0", "creative commons attribution 4.0"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "creative commons attribution-sharealike 4.0"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "creative commons attribution-noncommercial 4.0"),
    "CC-BY-ND-4.0": ("cc by-nd 4.0", "creative commons attribution-noderivatives 4.0"),
    "CC-BY-NC-SA-4.0": ("cc by-nc-sa 4.0", "creative commons attribution-noncommercial-sharealike 4.0"),
    "CC-BY-NC-ND-4.0": ("cc by-nc-nd 4.0", "creative commons attribution-noncommercial-noderivatives 4.0"),
}

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SAYS = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_EDGES = b".,;:!?\"'()[]{}<>*#-"


def plain(word: bytes) -> bytes:
    return word.lower().strip(_EDGES) or word


def phrased(words: list[bytes]) -> bytes:
    """Words with a blank at each side; marks of comments and lists between them don't count."""
    return b" " + b" ".join(plain(w) for w in words if _SAYS.search(w)) + b" "


def _keys(numbers: np.ndarray, k: int) -> np.ndarray:
    """A key for each k words whose numbers are all positive, else 0."""
    n = len(numbers) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = numbers[j : j + n]
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ part
        known &= part > 0
    key ^= key >> np.uint64(29)
    return np.where(known, key * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1), np.uint64(0))


def winnowed(keys: np.ndarray, keep: int) -> list[int]:
    """Places of the least key of each window of ``keep`` keys (the last of equal ones); all, if there are fewer."""
    if len(keys) <= keep:
        return [int(np.argmin(keys))] if len(keys) else []
    return sorted({at + keep - 1 - int(np.argmin(keys[at : at + keep][::-1])) for at in range(len(keys) - keep + 1)})


class Index:
    def __init__(self, templates: dict, k: int = K, keep: int = KEEP, telling: dict | None = None):
        self.k = k
        self.items = [(name, [plain(w) for w in _WORD.findall(text.encode())]) for name, texts in templates.items() for text in texts]
        said = {name: [b" " + p.encode() + b" " for p in phrases] for name, phrases in (telling or {}).items()}
        self.telling = [[p for p in said.get(name, ()) if p in phrased(words)] for name, words in self.items]
        self.vocabulary = {w for _, words in self.items for w in words}
        self.cache: dict[bytes, int] = {}
        places: dict[int, list] = {}
        self.numbers = []
        for t, (_, words) in enumerate(self.items):
            numbers = np.array([xxhash.xxh64_intdigest(w) | 1 for w in words], np.uint64)
            self.numbers.append(numbers)
            keys = _keys(numbers, min(k, len(words)))
            for at in winnowed(keys, keep):
                places.setdefault(int(keys[at]), []).append((t, at))
        self.lengths = sorted({min(k, len(n)) for n in self.numbers})  # those of templates of fewer words are shorter
        self.places, self.sorted = places, np.array(sorted(places), np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Word numbers: 0 for words of no template."""
        if len(self.cache) > 400_000:
            self.cache.clear()
        cache = self.cache
        for w in set(words):
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(p) | 1 if (p := plain(w)) in self.vocabulary else 0
        return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first word, word after the last) of the best in-order matching near a diagonal.

    ``diagonal`` is the place in the text of the template's first word; row i looks at places diagonal + i ± band.
    """
    width = 2 * band + 1

    def rank(x):
        """More matches, then closer together, then nearer to the diagonal."""
        return x[0], x[1] - x[2], -abs(x[1] - diagonal)

    best = [(0, -1, -1)] * (width + 1)  # by offset in the band: matches, first, last
    for i, w in enumerate(template):
        row = []
        for o in range(width):
            j = diagonal + i + o - band
            options = [best[o + 1] if o + 1 < len(best) else (0, -1, -1)]  # template word skipped
            if row:
                options.append(row[-1])  # text word skipped
            if 0 <= j < len(words) and words[j] == w:
                m, first, _ = best[o]
                options.append((m + 1, first if m else j, j))
            row.append(max(options, key=rank))
        best = [*row, (0, -1, -1)]
    m, first, last = max(best, key=rank)
    return m, first, last + 1


def scan(text: str | None, index: Index, band: int = BAND, least: float = COVERAGE) -> list[tuple]:
    """(license, coverage, matched words, spans of characters) for each license found, by name."""
    raw = (text or "").encode()
    words = raw.split()
    numbers = index.of(words)
    voted = set()
    for k in index.lengths:
        keys = _keys(numbers, k)
        at = np.minimum(np.searchsorted(index.sorted, keys), len(index.sorted) - 1)
        voted |= {(t, int(j) - i) for j in np.flatnonzero((keys > 0) & (index.sorted[at] == keys)) for t, i in index.places[int(keys[j])]}
    if not voted:
        return []
    places: list[tuple] = []
    done: dict[int, int] = {}
    for t, diagonal in sorted(voted):
        if t in done and diagonal - done[t] <= band // 2:
            continue  # within the band of a diagonal that has been aligned
        done[t] = diagonal
        m, first, stop = align(index.numbers[t], numbers, diagonal, band)
        if m >= least * len(index.numbers[t]) and all(p in phrased(words[first:stop]) for p in index.telling[t]):
            places.append((-m / len(index.numbers[t]), -m, index.items[t][0], first, stop))
    found: dict[str, tuple] = {}
    taken: list[tuple] = []
    for share, m, name, first, stop in sorted(places):  # words that a template covers better aren't another's
        if any(first < b and a < stop and other < (share, m) for a, b, other in taken):
            continue
        taken.append((first, stop, (share, m)))
        best, most, spans = found.get(name, (0.0, 0, []))
        found[name] = (max(best, -share), max(most, -m), [*spans, (first, stop)])
    if not found:
        return []
    bounds = [w.span() for w in _WORD.finditer(raw)]
    out = []
    for name, (share, most, spans) in sorted(found.items()):
        merged: list[list[int]] = []
        for first, stop in sorted(spans):
            if merged and first <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([first, stop])
        chars = [{"start": len(raw[: bounds[a][0]].decode()), "stop": len(raw[: bounds[b - 1][1]].decode())} for a, b in merged]
        out.append((name, share, most, chars))
    return out


@lru_cache(maxsize=1)
def standard_index() -> Index:
    return Index(TEMPLATES, telling=TELLING)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None, band: int = BAND, least: float = COVERAGE) -> DataFrame:
    """A row for each text and license found in it: id_col, license, coverage, matched_words, spans (array of start, stop)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *T.StructType.fromDDL("license string, coverage double, matched_words long, spans array<struct<start:bigint,stop:bigint>>").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        index = Index(templates) if templates is not None else standard_index()
        for batch in batches:
            rows = [(i, *r) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for r in scan(t.as_py(), index, band, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(trimmed(run), schema)
