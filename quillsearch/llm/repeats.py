"""Quality rules by repetition: suffix array and longest common prefixes give the repeated substrings of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import _byte_values, _powers, mix, raw_bytes, slices, table, tidy

#: A repeat has at least so many bytes (of UTF-8); a multiple of 8.
MIN_REPEAT = 48
#: A document is kept if repeats cover at most this part of its characters, and the longest has at most so many.
MAX_COVERED, MAX_LONGEST = 0.5, 1000
SLICE = 1_000_000

_U = np.uint64
SCHEMA = "doc_id bigint, n_chars bigint, repeated_chars bigint, covered double, longest bigint, n_spans bigint, keep boolean"


class Hashes:
    """Hashes of any byte span of a buffer, from sums over its beginnings."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, _U)
        np.cumsum(_byte_values()[raw] * power[: len(raw)], out=self.total[1:])

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.total[at + length] - self.total[at]) * self.inverse[at]


def repeated(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in order, whose suffix shares MIN_REPEAT bytes or more with another suffix of its document, and how many at most.

    A window of MIN_REPEAT bytes that occurs once in its document takes no part in a repeat; so only the suffixes at repeated
    windows are sorted. They are ranked by their windows' bytes, then by prefix doubling: the rank of 2k windows from the ranks of
    the first k and of the k behind them. Where suffixes are still equal, these too lie at a repeated window, or right behind one. The
    common prefix of neighbours in the suffix array is found by bisection over hashes; that of a suffix with either
    neighbour, whichever is longer, is the depth of the innermost LCP interval it lies in.
    """
    none = np.empty(0, np.int64)
    m = MIN_REPEAT
    sizes = np.diff(offsets)
    if len(raw) < m:
        return none, none
    h = Hashes(raw)
    count = np.maximum(sizes - m + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(begin[-1]) + np.repeat(offsets[:-1] - begin[:-1], count)
    key = (doc.astype(_U) << _U(44)) | (mix(h.of(at, m)) >> _U(20))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return none, none
    twice = np.unique(twice)
    slot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    hit = twice[slot] == key
    active, owner = at[hit], doc[hit]
    both = np.union1d(active, np.minimum(active + m, offsets[owner + 1] - 1))
    where = np.searchsorted(offsets, both, side="right") - 1
    end = offsets[where + 1]
    padded = np.concatenate([raw, np.zeros(m, np.uint8)])
    columns = []
    for k in range(m // 8):
        span = np.arange(8 * k, 8 * k + 8)
        part = padded[both[:, None] + span]
        part[both[:, None] + span >= end[:, None]] = 0
        columns.append(np.ascontiguousarray(part).view(">u8").ravel().astype(_U))
    order = np.lexsort([*columns[::-1], where])
    new = where[order[1:]] != where[order[:-1]]
    for c in columns:
        new |= c[order[1:]] != c[order[:-1]]
    rank = np.empty(len(both), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(new)])
    k, n = m, len(both)
    while k < int(sizes.max()):
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        ahead = both[tied] + k
        there = np.minimum(np.searchsorted(both, ahead), n - 1)
        second = np.where((ahead < end[tied]) & (both[there] == ahead), rank[there] + 1, 0)
        order = np.lexsort([second, rank[tied]])
        r, s = rank[tied][order], second[order]
        group = np.concatenate([[True], r[1:] != r[:-1]])
        step = np.concatenate([[False], (r[1:] == r[:-1]) & (s[1:] != s[:-1])])
        # a rank leaves room for its whole group, so that the ranks of others stay; the first of equal ones counts
        place = np.arange(len(order))
        base = np.maximum.accumulate(np.where(group, place, 0))
        first = np.maximum.accumulate(np.where(group | step, place, 0))
        if k == m:
            start = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=n))])[rank]
            rank = start
            r = rank[tied][order]
        rank[tied[order]] = r + first - base
        k *= 2
    own = np.searchsorted(both, active)
    order = np.argsort(rank[own], kind="stable")
    sa, doc = active[order], owner[order]
    a, b = sa[:-1], sa[1:]
    low = np.zeros(len(a), np.int64)
    high = np.where(doc[:-1] == doc[1:], offsets[doc[:-1] + 1] - np.maximum(a, b), 0)
    todo = np.flatnonzero(high > 0)
    while len(todo):
        middle = (low[todo] + high[todo] + 1) // 2
        same = h.of(a[todo], middle) == h.of(b[todo], middle)
        low[todo[same]] = middle[same]
        high[todo[~same]] = middle[~same] - 1
        todo = todo[low[todo] < high[todo]]
    lcp = np.concatenate([[0], low, [0]])
    depth = np.maximum(lcp[:-1], lcp[1:])
    length = np.zeros(len(active), np.int64)
    length[order] = depth
    some = length >= m
    return active[some], length[some]


def measure(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of each text: characters, those that repeats cover, characters of the longest repeat, number of spans in the union."""
    raw, offsets = raw_bytes(column)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    n = len(offsets) - 1
    chars = lead[offsets[1:]] - lead[offsets[:-1]]
    covered, longest, spans = (np.zeros(n, np.int64) for _ in range(3))
    at, length = repeated(raw, offsets)
    if len(at):
        end = np.maximum.accumulate(at + length)  # a span doesn't leave its document
        head = np.concatenate([[True], at[1:] > end[:-1]])
        head[1:] |= (np.searchsorted(offsets, at[1:], side="right") != np.searchsorted(offsets, at[:-1], side="right"))
        tail = np.concatenate([head[1:], [True]])
        lo, hi = at[head], end[tail]
        doc = np.searchsorted(offsets, lo, side="right") - 1
        np.add.at(covered, doc, lead[hi] - lead[lo])
        np.add.at(spans, doc, 1)
        np.maximum.at(longest, np.searchsorted(offsets, at, side="right") - 1, lead[at + length] - lead[at])
    return chars, covered, longest, spans


def _scan(batches: Iterator[pa.RecordBatch], most_covered: float, most_longest: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        chars, covered, longest, spans = measure(batch.column("text"))
        part = np.round(covered / np.maximum(chars, 1), 9)
        keep = (part <= most_covered) & (longest <= most_longest)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (chars, covered, part, longest, spans, keep))], names=["doc_id", "n_chars", "repeated_chars", "covered", "longest", "n_spans", "keep"])
    tidy()


def repetition(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row for each document: its characters, those that repeats of MIN_REPEAT bytes or more cover (all occurrences), their part, the longest repeat, the spans of the union, and whether both limits are kept.

    A repeat occurs twice or more in the document; occurrences may overlap. Null and empty texts have no characters and are kept; a
    null doc_id is carried through; repeated rows give repeated results; other columns are not read. Texts of any length are
    sorted whole.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda b: _scan(b, max_covered, max_longest), SCHEMA)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))
