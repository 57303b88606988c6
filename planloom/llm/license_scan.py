"""Operator 1: license scans. MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates become sequences of K-word shingles. For a template of n shingles, windows of 2s shingles begin at every
s-th, s at least 1.25 n, so that any stretch of up to s shingles lies wholly in one window. A window that holds the
asked share of the template has a Jaccard similarity with it of at least some j; with BANDS bands of one value each the two
collide with a chance of 1 - (1 - j) ** BANDS, over 0.9999 for every template here (``least_chance``). A band's values of all templates
stand sorted, and windows are looked up in them, so the work hardly depends on the number of templates. Colliding windows are
verified by the exact share of the template's shingles that they hold.

Some notices hold most of each other's words (versions of a license). Where two of these are found at the same place, the one with the larger
share stands.

Short notices, which would be too few shingles of K words, are shingles of half as many words as they have. They are so few that
those of a text are looked up one by one; windows of a notice's own number of shingles, at each place, are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .toxicity import NO_LETTER
from .workspace import ship

K = 5
SHARE = 0.8
BANDS = 48
#: Leading bits of a band's value by which windows that no template can share it with are passed over.
LEADING = 12

#: Notices by which texts are licensed, from the licenses' own recommendations and common use.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)

#: Short notices, in shingles of ``short_k`` words.
SHORT = (
    ("Proprietary", "All rights reserved."),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under MIT"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Licensed under the terms of the MIT License"),
    ("MIT", "Released under MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2"),
    ("BSD", "BSD 2-Clause License"),
    ("BSD", "BSD 3-Clause License"),
    ("BSD", "Licensed under the BSD License"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("ISC", "ISC License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC0-1.0", "CC0 1.0"),
    *((name.partition(":")[0], f"SPDX-License-Identifier: {name.partition(':')[2] or name}") for name in (
        "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL:LGPL-2.1", "LGPL:LGPL-3.0", "BSD:BSD-2-Clause", "BSD:BSD-3-Clause", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0")),
)

_RNG = np.random.default_rng(771)
ODD = _RNG.integers(1, 1 << 62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def permuted(h: np.ndarray, band: int) -> np.ndarray:
    x = h * ODD[band] + ADD[band]
    return x ^ (x >> np.uint64(32))


class Template(NamedTuple):
    number: int
    license: str
    shingles: np.ndarray  # sorted, distinct
    need: int


class Group(NamedTuple):
    """Templates that share a window size: ``step`` shingles from one window to the next, two of these in each."""

    step: int
    templates: list[Template]
    minima: list[np.ndarray]  # for each band the templates' least values, sorted
    order: list[np.ndarray]  # and the templates that they are of
    may: list[np.ndarray]  # and flags for the leading bits of these values


def step_of(n: int) -> int:
    """The least of 2, 3, 4, 6, 8, 12, 16 ... that is 1.25 n or more."""
    least, size = max(2, math.ceil(1.25 * n)), 2
    while True:
        for s in (size, size * 3 // 2):
            if s >= least:
                return s
        size *= 2


def build(templates, share: float = SHARE) -> list[Group]:
    by: dict[int, list[Template]] = {}
    for number, (name, text) in enumerate(templates):
        shingles = np.unique(shingled(pa.array([text]))[0])
        if len(shingles):
            by.setdefault(step_of(len(shingles)), []).append(Template(number, name, shingles, math.ceil(share * len(shingles) - 1e-9)))
    out = []
    for step, own in sorted(by.items()):
        least = [np.array([permuted(t.shingles, b).min() for t in own]) for b in range(BANDS)]
        order = [np.argsort(x, kind="stable") for x in least]
        may = [np.zeros(1 << LEADING, dtype=bool) for _ in least]
        for flags, x in zip(may, least, strict=True):
            flags[(x >> np.uint64(64 - LEADING)).astype(np.int64)] = True
        out.append(Group(step, own, [x[o] for x, o in zip(least, order, strict=True)], order, may))
    return out


def shingled(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for part in tk.slices(column):
        found = tk.words(part, NO_LETTER)
        h, at = tk.shingle_hashes(tk.word_hashes(part, found), found.first, K)
        out += [h[at[i] : at[i + 1]] for i in range(part.last - part.first)]
    return out


def short_k(n: int) -> int:
    """Words in a shingle of a short notice of ``n`` words: half of them, but 2 at least and K at most."""
    return max(2, min(K, n // 2))


class Short(NamedTuple):
    """Short notices whose shingles have ``k`` words: the shingles of all of them, sorted, and the notices."""

    k: int
    shingles: np.ndarray
    templates: list[Template]


def build_short(templates, first: int, share: float = SHARE) -> list[Short]:
    """Short notices by words in a shingle; their numbers go from ``first``."""
    by: dict[int, list[Template]] = {}
    for number, (name, text) in enumerate(templates, first):
        part = next(tk.slices(pa.array([text])))
        found = tk.words(part, NO_LETTER)
        k = short_k(int(found.first[-1]))
        shingles = np.unique(tk.shingle_hashes(tk.word_hashes(part, found), found.first, k)[0])
        if len(shingles):
            by.setdefault(k, []).append(Template(number, name, shingles, math.ceil(share * len(shingles) - 1e-9)))
    return [Short(k, np.unique(np.concatenate([t.shingles for t in own])), own) for k, own in sorted(by.items())]


def short_matches(h: np.ndarray, at: np.ndarray, group: Short) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """As ``matches``, over windows that begin with a shingle of the notice and have as many as it has."""
    out: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    bits = (h >> np.uint64(48)).astype(np.int64)
    may = np.zeros(1 << 16, dtype=bool)
    may[(group.shingles >> np.uint64(48)).astype(np.int64)] = True
    place = np.flatnonzero(may[bits])
    place = place[np.isin(h[place], group.shingles)]
    text = np.searchsorted(at, place, side="right") - 1
    for t in group.templates:
        own = np.isin(h[place], t.shingles)
        where, of = place[own], text[own]
        for i, (a, x) in enumerate(zip(where.tolist(), of.tolist(), strict=True)):
            j = i + 1
            while j < len(where) and of[j] == x and where[j] < a + len(t.shingles):
                j += 1
            held = len(np.unique(h[where[i:j]]))
            if held < t.need:
                continue
            key, share = (x, t.number), held / len(t.shingles)
            span = (a - int(at[x]), int(where[j - 1]) - int(at[x]))
            before = out.get(key)
            better = before is None or share > before[0]
            out[key] = (share if better else before[0], 1 if before is None else before[1] + 1, *(span if better else before[2:]))
    return out


def least_chance(groups: list[Group]) -> float:
    """The least chance that a window which holds the asked share of a template collides with it."""
    return min(1 - (1 - t.need / (len(t.shingles) + 2 * g.step - t.need)) ** BANDS for g in groups for t in g.templates)


def windows(h: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of blocks of ``step`` shingles, the text of each, and whether the next block is of the same text."""
    n = np.diff(at)
    count = -(-n // step)
    text = np.repeat(np.arange(len(n)), count)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    start = at[text] + (np.arange(len(text)) - first[text]) * step
    more = np.zeros(len(text), dtype=bool)
    more[:-1] = text[1:] == text[:-1]
    return start, text, more


def matches(h: np.ndarray, at: np.ndarray, groups: list[Group]) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """(text, template number): share of the template, windows, first and last shingle of the best window's part."""
    out: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    if not len(h):
        return out
    laid = [windows(h, at, g.step) for g in groups]
    hits: list[set[tuple[int, int]]] = [set() for _ in groups]
    for band in range(BANDS):
        x = permuted(h, band)
        for g, (start, _, more), got in zip(groups, laid, hits, strict=True):
            least = np.minimum.reduceat(x, start)
            both = least.copy()
            both[:-1] = np.where(more[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
            near = np.flatnonzero(g.may[band][(both >> np.uint64(64 - LEADING)).astype(np.int64)])
            if len(near):
                low, high = (np.searchsorted(g.minima[band], both[near], side) for side in ("left", "right"))
                for w, a, b in zip(near[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    got.update((w, int(j)) for j in g.order[band][a:b])
    for g, (start, text, _), got in zip(groups, laid, hits, strict=True):
        for w, j in got:
            t = g.templates[j]
            a = int(start[w])
            b = min(a + 2 * g.step, int(at[text[w] + 1]))
            inside = np.isin(h[a:b], t.shingles)
            held = len(np.unique(h[a:b][inside]))
            if held < t.need:
                continue
            place = np.flatnonzero(inside)
            key, own = (int(text[w]), t.number), int(at[text[w]])
            share, before = held / len(t.shingles), out.get(key)
            span = (a + int(place[0]) - own, a + int(place[-1]) - own)
            if before is None:
                out[key] = (share, 1, *span)
            else:
                better = (-share, span[0]) < (-before[0], before[2])
                out[key] = (max(share, before[0]), before[1] + 1, *(span if better else before[2:]))
    return out


def rivals(groups: list[Group]) -> set[tuple[int, int]]:
    """Pairs (a, b) of templates of which a's text alone would be reported as b."""
    every = [t for g in groups for t in g.templates]
    return {(a.number, b.number) for a in every for b in every if a.number != b.number and len(np.intersect1d(a.shingles, b.shingles)) >= b.need}


def settled(found: dict[tuple[int, int], tuple[float, int, int, int]], pairs: set[tuple[int, int]]) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """Of near-identical templates found at the same place of a text, those with the largest share."""
    by: dict[int, list[int]] = {}
    for text, number in found:
        by.setdefault(text, []).append(number)

    def beaten(text: int, b: int) -> bool:
        share, _, first, last = found[text, b]
        return any((a, b) in pairs and found[text, a][0] > share and found[text, a][2] <= last and first <= found[text, a][3] for a in by[text])

    return {key: x for key, x in found.items() if not beaten(*key)}


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("template", pa.int32()), ("license", pa.string()), ("share", pa.float64()), ("n_windows", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def _scan(templates, share: float, short, best: bool):
    names = [name for name, _ in (*templates, *short)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, few = build(templates, share), build_short(short, len(templates), share)
        pairs = rivals(groups) if best else set()
        for batch in batches:
            rows, ids = [], batch.column(0)
            for part in tk.slices(batch.column(1), 1 << 18):
                found = tk.words(part, NO_LETTER)
                hashes = tk.word_hashes(part, found)
                h, at = tk.shingle_hashes(hashes, found.first, K)
                got = [(x, K, y) for x, y in settled(matches(h, at, groups), pairs).items()]
                for g in few:
                    got += [(x, g.k, y) for x, y in short_matches(*tk.shingle_hashes(hashes, found.first, g.k, short=False), g).items()]
                for (i, number), k, (held, n, a, b) in sorted(got):
                    last = min(b + k, int(found.first[i + 1] - found.first[i])) - 1
                    rows.append({"doc_id": ids[part.first + i].as_py(), "template": number, "license": names[number], "share": held, "n_windows": n, "first_word": a, "last_word": last})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", short=(), best: bool = True) -> DataFrame:
    """License notices in whole texts: a row for each row of ``docs`` and template of which a window holds ``share`` or more.

    Returns doc_id, template (its number), license, share (of the template's distinct K-word shingles, in the best window),
    n_windows, first_word and last_word (numbers of the words, runs of letters and digits, of the best window's part; the first of
    equals). A text or template of fewer than K words is one shingle of them all. Null and empty texts hold nothing; rows that
    repeat are reported each; further columns aren't used; an empty table gives an empty result. ``templates`` is a
    short list of (license, text), and so is ``short``, of notices in shingles of ``short_k`` words: the query gives SHORT. Their
    numbers follow those of ``templates``. With ``best``, of templates that hold each other (versions of a license) and are found at the
    same place, only those with the largest share are returned. Very long texts are scanned whole, in memory of a few times their size.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scan(tuple(templates), share, tuple(short), best), "doc_id long, template int, license string, share double, n_windows long, first_word long, last_word long")
