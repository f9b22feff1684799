"""License scan by patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import _U, char_offsets, lowered, raw_bytes, slices, span_hashes, table, tidy, words

#: Of a template's words so many are aligned at least, and of the words that the alignment reaches over.
MIN_COVERAGE, MIN_DENSITY = 0.8, 0.5

_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out "
    "of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the "
    "above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
    "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
#: SPDX identifier and words, lower case, without punctuation.
TEMPLATES: tuple[tuple[str, str], ...] = (
    (
        "MIT",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
        "do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY,
    ),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    (
        "BSD-3-Clause",
        f"{_BSD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    ),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("BSD-2-Clause", "licensed under the bsd 2 clause license"),
    (
        "ISC",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
        "in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "Apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("GPL-3.0-or-later", _GNU.format("general public license", "3")),
    ("GPL-2.0-or-later", _GNU.format("general public license", "2")),
    ("LGPL-3.0-or-later", _GNU.format("lesser general public license", "3")),
    ("LGPL-2.1-or-later", _GNU.format("lesser general public license", "2 1")),
    ("AGPL-3.0-or-later", _GNU.format("affero general public license", "3")),
    ("GPL-3.0-only", "licensed under the gnu general public license version 3"),
    ("GPL-2.0-only", "licensed under the gnu general public license version 2"),
    ("AGPL-3.0-only", "licensed under the gnu affero general public license version 3"),
    ("LGPL-3.0-only", "licensed under the gnu lesser general public license version 3"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    (
        "Zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted "
        "to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    ("Unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("BSL-1.0", "distributed under the boost software license version 1 0"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    *((f"CC-{x.upper().replace(' ', '-')}-{v}.0", f"licensed under cc {x} {v} 0") for x in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd") for v in (3, 4)),
    *(
        (f"CC-{x}-4.0", f"licensed under a creative commons attribution{y} 4 0 international license")
        for x, y in (("BY", ""), ("BY-SA", " sharealike"), ("BY-NC", " noncommercial"), ("BY-ND", " noderivatives"), ("BY-NC-SA", " noncommercial sharealike"), ("BY-NC-ND", " noncommercial noderivatives"))
    ),
)

SCHEMA = "doc_id bigint, license string, start bigint, end bigint, coverage double"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal elements of a and b in rising order. Elements that occur once in either are anchors, of which the longest rising run stays; so on between neighbouring anchors. Where a gap has no anchors, equal beginnings and ends are taken."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        place = {b[y]: y for y in range(k, m) if once_b[b[y]] == 1}
        anchors = [(x, place[a[x]]) for x in range(i, j) if once_a[a[x]] == 1 and a[x] in place]
        run = _rising(anchors)
        if run:
            out += run
            edges = [(i - 1, k - 1), *run, (j, m)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


def _rising(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence whose second numbers rise."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(anchors)
    for i, (_, y) in enumerate(anchors):
        k = bisect_left(tails, y)
        back[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [y], [i]
    out: list[tuple[int, int]] = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(anchors[i])
        i = back[i]
    return out[::-1]


def _hashes(column: pa.Array) -> tuple[np.ndarray, ...]:
    raw, offsets = raw_bytes(lowered(column))
    starts, ends, text, first = words(raw, offsets)
    return raw, offsets, starts, ends, text, first, span_hashes(raw, starts, ends)


def needed(n: int) -> int:
    """Words of a template of n that have to be aligned."""
    return ceil(MIN_COVERAGE * n - 1e-9)


@cache
def _templates() -> tuple[list[list[int]], list[dict[int, list[int]]], np.ndarray, list[list[int]]]:
    """The words of each template; its key words, each with its places there; the sorted key words of all; the templates that have each as a key.

    What is aligned lacks at most n - needed(n) of a template's n words, so it holds one of any n - needed(n) + 1 of them: the keys are
    those that the fewest templates have, and the longest.
    """
    _, _, _, _, text, first, h = _hashes(pa.array([t for _, t in TEMPLATES]))
    own = [h[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    spread = Counter(w for t in own for w in set(t))
    length = {w: len(x) for t, (_, x) in zip(own, TEMPLATES) for w, x in zip(t, x.split())}
    keys: list[dict[int, list[int]]] = []
    for t in own:
        chosen: dict[int, list[int]] = {}
        for w in sorted(set(t), key=lambda w: (spread[w], -length[w], w)):
            if sum(map(len, chosen.values())) > len(t) - needed(len(t)):
                break
            chosen[w] = [i for i, x in enumerate(t) if x == w]
        keys.append(chosen)
    distinct = np.array(sorted({w for k in keys for w in k}), _U)
    return own, keys, distinct, [[t for t, k in enumerate(keys) if w in k] for w in distinct.tolist()]


def align(text: list[int], seeds: list[int], template: list[int], keys: dict[int, list[int]]) -> list[tuple[int, int, float]]:
    """First word, end and coverage of each place in a text that aligns with a template. seeds: where it has a key word, in order.

    A key word tells where the template would begin; the words from there on are aligned, then with more and more around, and the
    most words aligned count. The next place is searched behind.
    """
    n, need, bag = len(template), needed(len(template)), Counter(template)
    out: list[tuple[int, int, float]] = []
    lo = x = y = shared = 0
    have: Counter[int] = Counter()  # of the template's words in text[x:y], which reaches as far as any alignment around the seed; shared: as many as the template has
    for s in seeds:
        if s < lo:
            continue
        if s - 3 * n > y:
            x = y = s - 3 * n
            have.clear()
            shared = 0
        while y < min(len(text), s + 3 * n):
            if (w := text[y]) in bag:
                have[w] += 1
                shared += have[w] <= bag[w]
            y += 1
        while x < s - 3 * n:
            if (w := text[x]) in bag:
                shared -= have[w] <= bag[w]
                have[w] -= 1
            x += 1
        if shared < need:
            continue
        best: tuple[int, int, int] | None = None
        for slack, t in ((k, t) for k in (0, n // 4 + 1, 2 * n) for t in keys[text[s]]):
            if best and best[2] == n:
                break
            a, b = max(lo, s - t - slack), min(len(text), s - t + n + slack)
            if (Counter(text[a:b]) & bag).total() < need:
                continue
            span = _dense(patience(text[a:b], template))
            if span and span[2] >= need and (best is None or span[2] > best[2]):
                best = a + span[0], a + span[1], span[2]
        if best:
            out.append((best[0], best[1], best[2] / n))
            lo = best[1]
    return out


def _dense(pairs: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """Begin, end and number of the aligned words, without those at either end that lie so far off that fewer than MIN_DENSITY of the words between are aligned."""
    while pairs:
        a, b = pairs[0][0], pairs[-1][0] + 1
        if len(pairs) >= MIN_DENSITY * (b - a):
            return a, b, len(pairs)
        left = pairs[1][0] - pairs[0][0] if len(pairs) > 1 else 0
        right = pairs[-1][0] - pairs[-2][0] if len(pairs) > 1 else 0
        pairs = pairs[1:] if left >= right else pairs[:-1]
    return None


def best(found: list[tuple[int, int, float, int]], sizes: list[int]) -> list[tuple[int, int, float, int]]:
    """Of places that overlap, the one with the most aligned words, then the best covered, then the first template."""
    out: list[tuple[int, int, float, int]] = []
    for x in sorted(found, key=lambda x: (-round(x[2] * sizes[x[3]]), -x[2], x[3], x[0])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in out):
            out.append(x)
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, keys, distinct, has = _templates()
    sizes = [len(x) for x in own]
    kinds = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
    for batch in slices(batches):
        raw, offsets, starts, ends, text, first, h = _hashes(batch.column("text"))
        if not len(h):
            continue
        slot = np.minimum(np.searchsorted(distinct, h), len(distinct) - 1)
        hit = np.flatnonzero(distinct[slot] == h)
        by_doc: dict[int, dict[int, list[int]]] = {}
        for w, s, d in zip((hit - first[text[hit]]).tolist(), slot[hit].tolist(), text[hit].tolist()):
            for t in has[s]:
                by_doc.setdefault(d, {}).setdefault(t, []).append(w)
        ids, rows = batch.column("doc_id"), []
        for doc, seeds in by_doc.items():
            base = int(first[doc])
            mine = h[base : int(first[doc + 1])].tolist()
            found = [(a, b, c, t) for t, own_seeds in seeds.items() for a, b, c in align(mine, own_seeds, own[t], keys[t])]
            for a, b, c, t in best(found, sizes):
                lo, hi = char_offsets(raw, int(offsets[doc]), np.array([starts[base + a], ends[base + b - 1]])).tolist()
                rows.append((ids[doc].as_py(), TEMPLATES[t][0], lo, hi, round(c, 6)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows), kinds)], schema=kinds)
    tidy()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each license text or notice found: doc_id, its SPDX identifier, start and end in characters, the part of the template's words that is aligned.

    Texts are compared by lower-case words. A place counts if MIN_COVERAGE of a template is aligned, in order, and MIN_DENSITY of the
    words it reaches over. Of templates that overlap the one with more aligned words counts; places of one template follow one another. Null and empty texts have none; a null
    doc_id is carried through; repeated rows give repeated results; other columns are not read. Texts of any length are searched whole.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
