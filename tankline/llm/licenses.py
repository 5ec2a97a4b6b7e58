"""License scans: templates found by MinHash bands over overlapping windows of a text.

Words are runs of letters and digits in lower case; a template's set is its distinct five-word
shingles (a shorter template is one shingle). A text is read in windows of W shingles, W the least
power of two that holds the template's, at steps of W/8. Each window has BANDS MinHash samples, one to a
band; a band that equals the template's makes the window a candidate. At a containment of 0.75 a
window that covers a template has a Jaccard similarity of 0.22 at least, so one of 40 bands meets with
a probability of over 0.9999. Around a candidate the distinct shingles of the template are
counted exactly; the template is found where ``containment`` of them lie within W + W/4 shingles.

Results: a row for each document and template found, with the best containment. NULL and empty texts
hold none. Rows are read one by one, so ids may repeat or be NULL; rows equal in id and template are
given once, with the best. Other columns are not looked at; an empty table gives no rows.

A very long text is read whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, parts, plain
from .decontam import word_hashes

BANDS = 40
#: fixed values: notices as licences ask for them or as pages carry them, and texts of the shorter licences
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied."
    ),
    "MIT": "Released under the MIT License",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "All-rights-reserved": "All rights reserved",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    # whole licence texts
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        "HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and "
        "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
        "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
        "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked "
        "as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law."
    ),
}


def shingle_hashes(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle that starts at each word, and whether it lies within one row."""
    value = np.zeros(len(word), np.uint64)
    padded = np.append(word, np.zeros(size, np.uint64))
    for k in range(size):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(word)])
    row_end = np.repeat(first[1:], np.diff(first))
    return value ^ np.uint64(size), np.arange(len(word)) + size <= row_end


@lru_cache(maxsize=1)
def _samples():
    rng = np.random.default_rng(71)
    return rng.integers(0, 1 << 32, BANDS, dtype=np.uint32), rng.integers(0, 1 << 32, BANDS, dtype=np.uint32) | np.uint32(1)


def _sample(h: np.ndarray, j: int) -> np.ndarray:
    add, odd = _samples()
    x = ((h >> np.uint64(32)).astype(np.uint32) ^ add[j]) * odd[j]
    return x ^ (x >> np.uint32(15))


@lru_cache(maxsize=2)
def _opened(templates: tuple[tuple[str, str], ...]):
    """By shingle size: (name, sorted distinct shingles, samples, log2 of the window)."""
    out: dict[int, list] = {}
    for name, text in templates:
        raw = np.frombuffer(text.encode(), np.uint8)
        word, first = word_hashes(raw, np.array([0, len(raw)]))
        if not len(word):
            continue
        size = min(5, len(word))
        h, whole = shingle_hashes(word, first, size)
        own = np.unique(h[whole])
        out.setdefault(size, []).append((name, own, [int(_sample(own, j).min()) for j in range(BANDS)], int(len(own) - 1).bit_length()))
    return out


def _scan(batches, templates: tuple[tuple[str, str], ...], containment: float) -> Iterator[pa.RecordBatch]:
    for batch, raw, ends in parts(batches):
        word, first = word_hashes(raw, ends)
        best: dict[tuple[int, str], float] = {}
        for size, kinds in _opened(templates).items():
            if len(word) < size:
                continue
            h, whole = shingle_hashes(word, first, size)
            deepest = max(k[3] for k in kinds)
            found = [[] for _ in kinds]
            for j in range(BANDS):
                low = _sample(h, j)
                low[~whole] = np.uint32(0xFFFFFFFF)
                for level in range(deepest + 1):
                    step = max(1, (1 << level) // 8)
                    for k, (_, _, own, need) in enumerate(kinds):
                        if need == level:
                            found[k].append(np.flatnonzero(low[::step] == own[j]) * step)
                    half = 1 << level
                    if level < deepest and len(low) > half:
                        low[:-half] = np.minimum(low[:-half], low[half:])
            for (name, own, _, need), starts in zip(kinds, found):
                starts = np.unique(np.concatenate(starts))
                width = 1 << need
                reach = width + width // 4
                row = np.searchsorted(first, starts, side="right") - 1
                for s, r in zip(starts.tolist(), row.tolist()):
                    key = (r, name)
                    if best.get(key, 0.0) >= 1.0:
                        continue
                    a, b = max(int(first[r]), s - width // 4), min(int(first[r + 1]), s + reach)
                    held = len(np.intersect1d(h[a:b][whole[a:b]], own)) / len(own)
                    if held >= containment:
                        best[key] = max(best.get(key, 0.0), held)
        docs = batch.column("doc_id")
        rows = [(docs[r].as_py(), name, held) for (r, name), held in best.items()]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "license", "containment"])


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, containment: float = 0.75) -> DataFrame:
    """(doc_id, license, containment) of the templates (name: text) found in each document."""
    own = tuple((TEMPLATES if templates is None else templates).items())
    hits = plain(docs, "doc_id", "text").mapInArrow(lambda b: _scan(b, own, containment), "doc_id long, license string, containment double")
    return hits.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))
