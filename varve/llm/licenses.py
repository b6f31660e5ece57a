"""License scans: MinHash bands over overlapping text windows, verified by containment.

Words are runs of letters and digits, folded (ASCII marks, general punctuation,
the signs of the Latin-1 block and the trade mark separate them); five of them make a shingle (all
of them where there are fewer).  A template of ``n`` shingles belongs to the
window size ``W``, the largest power of two with ``2 W - 1 <= n``, and is
indexed at every offset; document windows of W shingles advance by half a
window, so a full copy of a template holds aligned windows.  Each window has 16
minima in 8 bands of 2: windows of similarity 0.8 share a band with probability
1 - (1 - 0.64)^8 = 0.9997.  A hit is verified at its alignment: the share of the
template's distinct shingles inside the passage, 0.8 or more.

Templates are a stated query set, in blocks of at most INDEX_BYTES of text whose
indexes are broadcast; documents are scanned whole, once for each block, without a
shuffle.

Edge cases: null, blank and wordless texts match nothing; a template without
words is refused; repeated documents are matched row by row; equal scores go to
the earliest passage.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.kernels import shingles, text_slices, word_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 8, 2
INDEX_BYTES = 4 << 20

#: Public license notices and headers.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "bsd-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "mit-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "lgpl-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)


def window_class(n: int) -> int:
    """Shingles in the windows of a template of ``n`` shingles."""
    size = 1
    while 4 * size - 1 <= n:
        size *= 2
    return size


def parse(buf: np.ndarray, offsets: np.ndarray) -> tuple:
    """(shingle hashes, shingles from each place to the end of its text, first words, byte starts, byte ends)."""
    plain = _PLAIN[buf]
    two, three = np.flatnonzero(buf[:-1] == 0xC2), np.flatnonzero(buf[:-2] == 0xE2)
    two = two[(buf[two + 1] >= 0xA0) & (buf[two + 1] <= 0xBF) & ~np.isin(buf[two + 1], (0xAA, 0xB5, 0xBA))]
    three = three[(buf[three + 1] == 0x80) | (buf[three + 1] == 0x81) | ((buf[three + 1] == 0x84) & (buf[three + 2] == 0xA2))]
    for at, width in ((two, 2), (three, 3)):
        for k in range(width):
            plain[at + k] = 32
    starts, ends, first = words(plain, offsets)
    s, left = shingles(word_hashes(plain, starts, ends), first, SHINGLE) if len(starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    count = left - SHINGLE + 1
    heads = first[:-1][np.diff(first) > 0]
    count[heads] = np.maximum(count[heads], 1)
    return s, count, first, starts, ends


def band_keys(s: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each window size in rising order, the band keys of the window at each place."""
    low = [((s * a + b) >> np.uint64(32)).astype(np.uint32) for a, b in zip(_A, _B)]
    width = 1
    for size in sizes:
        while width < size:
            for m in low:
                np.minimum(m[: len(m) - width], m[width:], out=m[: len(m) - width])
            width *= 2
        yield size, [(low[i].astype(np.uint64) << np.uint64(32)) | low[i + 1] for i in range(0, BANDS * ROWS, ROWS)]


class TemplateIndex:
    """Band tables of all template windows and the templates' distinct shingles."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.sets, self.words, self.tables = [], [], [], {}
        entries: dict[int, list] = {}
        for name, text in templates.items():
            buf = np.frombuffer(text.encode(), np.uint8)
            s, count, first, _, _ = parse(buf, np.array([0, len(buf)]))
            if not len(s):
                raise ValueError(f"template {name} has no words")
            n = int(count[0])
            k, size = len(self.names), window_class(n)
            self.names.append(name)
            self.sets.append(set(s[:n].tolist()))
            self.words.append(len(s))
            at = np.arange(n - size + 1)
            keys = next(k2 for w, k2 in band_keys(s[:n], [size]) if w == size)
            entries.setdefault(size, []).append(([x[at] for x in keys], np.full(len(at), k), at))
        for size, parts in sorted(entries.items()):
            template = np.concatenate([p[1] for p in parts])
            offset = np.concatenate([p[2] for p in parts])
            bands = []
            for b in range(BANDS):
                keys = np.concatenate([p[0][b] for p in parts])
                order = np.argsort(keys, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[_slot(keys)] = True
                bands.append((keys[order], order, seen))
            self.tables[size] = (template, offset, bands)

    def matches(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(text, template, start byte, end byte, containment), the best passage of each pair."""
        s, count, first, starts, ends = parse(buf, offsets)
        if not len(s):
            return []
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place, found = np.arange(len(s)) - first[text], []
        for size, keys in band_keys(s, list(self.tables)):
            template, offset, bands = self.tables[size]
            at = np.flatnonzero((count >= size) & (place % max(1, size // 2) == 0))
            for x, (known, order, seen) in zip(keys, bands):
                x = x[at]
                some = np.flatnonzero(seen[_slot(x)])
                lo, hi = np.searchsorted(known, x[some], "left"), np.searchsorted(known, x[some], "right")
                n = hi - lo
                w = np.repeat(at[some], n)
                e = order[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
                if len(w):
                    found.append(np.stack([text[w], template[e], w - offset[e]], axis=1))
        best: dict[tuple[int, int], tuple] = {}
        for t, k, start in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
            lo, hi, n = int(first[t]), int(first[t + 1]), self.words[k]
            slack = n // 8
            a, b = max(lo, start - slack), min(hi, start + n + slack)
            inside = self.sets[k].intersection(s[a:b][(count[a:b] > 0)].tolist()) if b > a else ()
            value = len(inside) / len(self.sets[k])
            if value >= THRESHOLD - 1e-12 and (value, -start) > best.get((t, k), (0.0, 0))[:2]:
                best[t, k] = (value, -start, int(starts[max(start, lo)]), int(ends[min(start + n, hi) - 1]))
        return [(t, k, a, b, v) for (t, k), (v, _, a, b) in sorted(best.items())]


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def _characters(buf: np.ndarray) -> int:
    return int(np.count_nonzero((buf & 0xC0) != 0x80))


def indexes(templates: dict[str, str], size: int = INDEX_BYTES) -> Iterator[TemplateIndex]:
    """Indexes of blocks of templates of at most ``size`` bytes (or one template)."""
    block: dict[str, str] = {}
    held = 0
    for name, text in templates.items():
        n = len(text.encode())
        if block and held + n > size:
            yield TemplateIndex(block)
            block, held = {}, 0
        block[name] = text
        held += n
    yield TemplateIndex(block)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and template in it: doc_id, license, span in code points and containment."""
    out = None
    for index in indexes(TEMPLATES if templates is None else templates):
        part = _scan(docs, index)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(docs: DataFrame, index: TemplateIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            rows = []
            for lo, _, buf, offsets in text_slices(batch.column("text")):
                for t, k, a, b, v in shared.value.matches(buf, offsets):
                    head = _characters(buf[offsets[t] : a])
                    rows.append((lo + t, shared.value.names[k], head, head + _characters(buf[a:b]), v))
            col = lambda j, kind: pa.array([r[j] for r in rows], kind)  # noqa: E731,B023
            ids = batch.column("doc_id").take(col(0, pa.int64()))
            rest = [col(1, pa.string()), col(2, pa.int64()), col(3, pa.int64()), col(4, pa.float64())]
            yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "license", "first_char", "end_char", "containment"])

    kinds = "doc_id long, license string, first_char long, end_char long, containment double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)
