"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PACKED, _word_bytes, buckets, close_rows, connected, filter_of, linked, mix, packed, pairs, passes, raw_bytes, slices, span_hashes, table, tidy, written

#: Lines are the same from this edit similarity of their words on: 1 - distance / length of the longer, in characters.
SIMILARITY = 0.9
#: Bits of the SimHash. Its features are the distinct pairs of neighbouring bytes, in lines of up to SHORT characters, or triples.
SIMHASH, SHORT = 192, 128
#: For each class of lines: the features, its fewest and most characters, the blocks that the SimHash is cut into, and in how many bits
#: of a second SimHash (of 128 bits, by runs of four bytes) lines with an equal block may differ. Of lines whose SimHashes differ in fewer
#: bits than there are blocks one block at least is equal. The classes overlap, so that no two alike lines are without a common one. A bit
#: more a block for each doubling of a corpus keeps the number of lines that a line is compared with.
TINY = 48
CLASSES = (("b", 10, TINY, 16, 28), ("b", TINY * SIMILARITY, SHORT, 12, 24), ("t", SHORT * SIMILARITY, np.inf, 12, 20))
#: Lines of fewer characters have no edit to spare: they are the same or not.
LEAST = CLASSES[0][1]
#: Lengths are compared by steps of one in a hundred; lines of similarity SIMILARITY are at most LENGTH_STEPS of them apart.
LENGTH_STEP, LENGTH_STEPS, LENGTH_BITS = 1.01, 11, 12
#: Features fall into so many bins; bins, with signs, into so many sums.
BINS, SUMS = 2048, 512

_U = np.uint64
_STREAMS = SIMHASH // 64
#: Rows of the Hadamard matrix in an order in which the first ones tell all bins apart.
_ROWS = np.arange(1, SUMS) * 197 % SUMS
#: Lines whose sums are made together.
_TOGETHER_LINES = 256
SLICE = 1_000_000
#: An entry of a bucket: class, block and its bits, step of the length, line, second SimHash.
ENTRY = np.dtype([("group", "<u4"), ("step", "<u2"), ("line", "<i8"), ("c0", "<u8"), ("c1", "<u8")])
#: And the group that the line is known to be of, when lines of different groups are compared.
PLACED = np.dtype([*ENTRY.descr, ("root", "<i8")])


@cache
def _signs() -> np.ndarray:
    return (1 - 2 * (mix(np.arange(BINS, dtype=_U) + _U(77)) & _U(1)).astype(np.int8)).reshape(BINS // SUMS, SUMS, 1)


def simhashes(has: np.ndarray, bits: int, rows: np.ndarray = np.arange(1, SUMS)) -> np.ndarray:
    """The SimHash of lines by the bins that their features fall into, lines x 64-bit numbers. has: bins x lines, 1 or 0.

    Each bit is the sign of a sum over the bins with a row of signs of its own: a Hadamard matrix, in which the bins come with random
    signs, gives all sums by log2(SUMS) rounds of additions. rows: of the matrix, in the order of the bits.
    """
    n = has.shape[1]
    y = (has.reshape(BINS // SUMS, SUMS, n) * _signs()).sum(axis=0, dtype=np.int16)
    half = 1
    while half < SUMS:
        two = y.reshape(SUMS // (2 * half), 2, half, n)
        low, high = two[:, 0], two[:, 1]
        less = low - high
        low += high
        high[:] = less
        half *= 2
    return np.ascontiguousarray(np.packbits(y[rows[:bits]] > 0, axis=0, bitorder="little").T).view(_U)


class Normal:
    """The lines of texts as their lower-case words, one space between, that have a word. flat: all lines behind one another, with a space before, between and behind; lo, hi: where each is; doc, number: its text and its number there; size: its characters; line: a hash."""

    def __init__(self, column: pa.Array):
        column = pc.utf8_lower(pc.fill_null(column, ""))
        raw, offsets = raw_bytes(pc.binary_join_element_wise(column, "", "\n"))  # each text ends in a line break
        inside = _word_bytes()[raw]
        keep = inside.copy()
        keep[1:] |= inside[:-1]  # one space behind each word
        self.flat = np.concatenate([np.array([32], np.uint8), np.where(inside, raw, np.uint8(32))[keep]])
        ends = np.flatnonzero(raw == 10)
        upto = np.cumsum(keep, dtype=np.int32)
        to = upto[ends].astype(np.int64)  # of flat, which is one longer, the number of the space behind the line
        lo = np.concatenate([[0], to[:-1]]) + 1
        some = np.flatnonzero(to >= lo)
        before = np.searchsorted(ends, offsets)
        doc = np.searchsorted(offsets, ends[some], side="right") - 1
        self.doc, self.number = doc, some - before[doc]
        self.lo, self.hi = lo[some], to[some]
        lead = np.concatenate([[0], np.cumsum((self.flat & 0xC0) != 0x80, dtype=np.int32)])
        self.size = lead[self.hi] - lead[self.lo]
        self.line = span_hashes(self.flat, self.lo, self.hi).view(np.int64)

    def sketches(self, own: np.ndarray, n: int, bits: int) -> np.ndarray:
        """SimHashes of these lines, of LEAST characters or more, by their distinct runs of n bytes, the spaces around counted in."""
        f = np.concatenate([self.flat, np.zeros(n, np.uint8)]).astype(np.uint32)
        g = f[: len(self.flat)].copy()
        for k in range(1, n):
            g |= f[k : k + len(self.flat)] << np.uint32(8 * k)
        g = ((g ^ (g >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BINS.bit_length() + 1)).astype(np.int64) * _TOGETHER_LINES
        for k in range(n - 2):  # runs that would go beyond the line count as its first
            g[self.hi[own] - 1 - k] = g[self.lo[own] - 1]
        out = np.zeros((len(own), bits // 64), _U)
        has = np.zeros(BINS * _TOGETHER_LINES, np.int8)
        count = self.hi - self.lo + 1
        if len(own) < len(count):  # the runs of all lines follow one another without a gap
            some = np.zeros(len(count), bool)
            some[own] = True
            g = g[: count.sum()][np.repeat(some, count)]
        edge = np.concatenate([[0], np.cumsum(count[own])])
        for at in range(0, len(own), _TOGETHER_LINES):
            to = min(at + _TOGETHER_LINES, len(own))
            slot = np.repeat(np.arange(to - at), count[own[at:to]])
            slot += g[edge[at] : edge[to]]
            has[slot] = 1
            out[at:to] = simhashes(has.reshape(BINS, _TOGETHER_LINES), bits, _ROWS)[: to - at]
            has[:] = 0
        return out

    def texts(self, own: np.ndarray) -> pa.Array:
        data = self.flat.tobytes()
        return pa.array([data[a:b].decode() for a, b in zip(self.lo[own].tolist(), self.hi[own].tolist())], pa.string())


_SKETCHES = [*(f"{kind}{s}" for kind in "bt" for s in range(_STREAMS)), "c0", "c1"]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        x = Normal(batch.column("text"))
        columns = []
        for n, bits, has in ((2, SIMHASH, (x.size <= SHORT) & (x.size >= LEAST)), (3, SIMHASH, x.size >= SHORT * SIMILARITY), (4, 128, x.size >= LEAST)):
            own = np.flatnonzero(has)
            sketch = np.zeros((len(x.line), bits // 64), _U)
            sketch[own] = x.sketches(own, n, bits)
            columns += [pa.array(np.ascontiguousarray(s).view(np.int64), mask=~has) for s in sketch.T]
        doc = pa.array(x.doc)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(doc), batch.column("row").take(doc), pa.array(x.number.astype(np.int32)), pa.array(x.line), pa.array(x.size.astype(np.int32)), *columns],
            names=["doc_id", "row", "number", "line", "size", *_SKETCHES],
        )
    tidy()


def _keyed(batches: Iterator[pa.RecordBatch], n_buckets: int, entry: np.dtype = ENTRY) -> Iterator[pa.RecordBatch]:
    """An entry for each block of each line's SimHash. A line that the task has had is left out."""
    seen = np.empty(0, np.int64)
    kept: list[np.ndarray] = []
    for batch in batches:
        line = batch.column("line").to_numpy()
        _, first = np.unique(line, return_index=True)
        at = np.minimum(np.searchsorted(seen, line[first]), max(0, len(seen) - 1))
        first = first[seen[at] != line[first]] if len(seen) else first
        if not len(first):
            continue
        seen = np.sort(np.concatenate([seen, line[first]]))
        batch = batch.take(pa.array(first))
        size = batch.column("size").to_numpy()
        step = np.floor(np.log(size) / np.log(LENGTH_STEP)).astype(np.uint16)
        for kind, (name, least, most, blocks, _) in enumerate(CLASSES):
            own = np.flatnonzero((size >= least) & (size <= most))
            part = batch.take(pa.array(own))
            s = [part.column(f"{name}{k}").to_numpy().view(_U) for k in range(_STREAMS)]
            width = SIMHASH // blocks
            for k in range(blocks):
                at = k * width
                block = s[at // 64] >> _U(at % 64)
                if at % 64 + width > 64:
                    block = block | (s[at // 64 + 1] << _U(64 - at % 64))
                out = np.empty(len(own), entry)
                out["group"] = (block & _U((1 << width) - 1)).astype(np.uint32) | np.uint32((kind << 4 | k) << 16)
                out["step"], out["line"] = step[own], part.column("line").to_numpy()
                out["c0"], out["c1"] = (part.column(c).to_numpy().view(_U) for c in ("c0", "c1"))
                if "root" in entry.names:
                    out["root"] = part.column("root").to_numpy()
                kept.append(out)
        if sum(map(len, kept)) > 1 << 17:
            every = np.concatenate(kept)
            kept = []
            yield packed(every, every["group"], n_buckets)
    if kept:
        every = np.concatenate(kept)
        yield packed(every, every["group"], n_buckets)
    tidy()


def _windows(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of entries in the order of their blocks and lengths: their numbers, keys and lines; the distance of rows by the second SimHash, the most that it may be, and that SimHash."""
    tag = (entries["group"].astype(_U) << _U(42)) | (entries["step"].astype(_U) << _U(30)) | (entries["line"].astype(_U) >> _U(34))
    order = np.argsort(tag)
    tag, line = tag[order], entries["line"][order]
    new = np.concatenate([np.ones(min(1, len(tag)), bool), (tag[1:] != tag[:-1]) | (line[1:] != line[:-1])])  # of a line that came from several tasks, one
    order, key, line = order[new], (tag[new] >> _U(30)).astype(np.int64), line[new]
    x, y = entries["c0"][order], entries["c1"][order]
    most = np.array([c[4] for c in CLASSES], np.uint8)[key >> (LENGTH_BITS + 20)]
    return order, key, line, lambda i, j: np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]), most, (x, y)


def _near(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of an equal block and of like length whose second SimHashes differ in few bits, as far as they connect lines; and each line that has more such pairs, beside itself."""
    _, key, line, apart, most, words = _windows(entries)
    a, b, more = linked(key, apart, most, LENGTH_STEPS, words)
    a, b = line[np.append(a, more)], line[np.append(b, more)]
    return np.minimum(a, b), np.maximum(a, b)


def _across(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All such pairs of lines that aren't known to be of one group."""
    order, key, line, apart, most, words = _windows(entries)
    found = [(line[i], line[j]) for i, j, _ in close_rows(key, apart, most, LENGTH_STEPS, entries["root"][order], words)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    return np.minimum(a, b), np.maximum(a, b)


def aligned(a: list[str], b: list[str], most: int) -> bool:
    """Whether words put side by side from left to right show that the distance is at most `most`; if not, it may be all the same."""
    i = j = cost = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        if a[i + 1 : i + 3] == b[j + 1 : j + 3]:
            cost += max(len(a[i]), len(b[j]))
            i += 1
            j += 1
        elif a[i + 1 : i + 3] == b[j : j + 2]:
            cost += len(a[i]) + 1
            i += 1
        elif a[i : i + 2] == b[j + 1 : j + 3]:
            cost += len(b[j]) + 1
            j += 1
        else:
            cost += max(len(a[i]), len(b[j]))
            i += 1
            j += 1
        if cost > most:
            return False
    return cost + sum(len(x) + 1 for x in a[i:]) + sum(len(x) + 1 for x in b[j:]) <= most


def most_edits(longest):
    """Edits that two lines may be apart, by the length of the longer."""
    return (np.asarray(longest) * (1 - SIMILARITY) + 1e-9).astype(np.int64)


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or a number above `most` where it is larger than that: the bit-parallel columns of Myers, on one integer of the pattern's length."""
    m = len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, m - 1
    plus, minus, score, left = full, 0, m, len(b)
    for c in b:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        score += (ph >> top & 1) - (mh >> top & 1)
        left -= 1
        if score - left > most:
            return most + 1
        ph = (ph << 1 | 1) & full
        plus = (mh << 1) & full | (full & ~(xv | ph))
        minus = ph & xv
    return score


def _points(texts: list[str], width: int) -> np.ndarray:
    """Code points of texts, one a row, filled up with zeros."""
    flat = np.frombuffer("".join(x.ljust(width, "\0") for x in texts).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(texts), width).astype(np.int64)


def _distances(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Levenshtein distances of many pairs at once, or numbers above `most` where they are larger: the same columns in blocks of 64 rows, of which those that lie off the diagonal by `most` are left out. b in falling order of length, no text of a longer than its own of b."""
    n, size = len(a), np.array([len(x) for x in b])
    last = np.array([len(x) for x in a])
    blocks = -(-int(last.max()) // 64)
    pa_, pb = _points(a, int(last.max())), _points(b, int(size.max()))
    keys = np.unique(np.where(pa_ > 0, (np.arange(n)[:, None] << 21) | pa_, -1))
    keys = keys[keys >= 0]  # a text has no zero here: its characters are those of words
    start = np.searchsorted(keys, np.arange(n) << 21)
    kinds = int(np.diff(np.append(start, len(keys))).max()) + 1
    masks = np.zeros((n, kinds, blocks), _U)
    row, at = np.nonzero(pa_)
    kind = np.searchsorted(keys, (row << 21) | pa_[row, at]) - start[row]
    np.bitwise_or.at(masks, (row, kind, at // 64), _U(1) << (at % 64).astype(_U))
    want = (np.arange(n)[:, None] << 21) | pb
    slot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    kind_b = np.where(keys[slot] == want, slot - start[:, None], kinds - 1)
    plus, minus = np.full((blocks, n), ~_U(0)), np.zeros((blocks, n), _U)
    bottom, shift = (last - 1) // 64, ((last - 1) % 64).astype(_U)
    one, top = _U(1), _U(63)
    beyond = ~((((one << shift) - one) << one) | one)  # rows below a text's last in its last block
    masks = masks.reshape(n * kinds, blocks)
    hi = min(blocks - 1, most // 64)
    score = np.full(n, 64 * (hi + 1))  # in the last row of block hi
    out = np.zeros(n, np.int64)
    for j in range(int(size.max())):
        k = int(np.searchsorted(-size, -j, side="left"))  # those that have a j-th character
        if (j + most) // 64 > hi and hi < blocks - 1:
            hi += 1
            score += 64
        lo = max(0, (j - most) // 64)
        eqs = masks[np.arange(k) * kinds + kind_b[:k, j]]
        up, down = np.ones(k, _U), np.zeros(k, _U)
        for w in range(lo, hi + 1):
            p, m, eq = plus[w, :k], minus[w, :k], eqs[:, w]
            xv = eq | m
            eq = eq | down
            xh = (((eq & p) + p) ^ p) | eq
            ph = m | ~(xh | p)
            mh = p & xh
            next_up, next_down = ph >> top, mh >> top
            ph, mh = (ph << one) | up, (mh << one) | down
            plus[w, :k] = mh | ~(xv | ph)
            minus[w, :k] = ph & xv
            up, down = next_up, next_down
        score[:k] += up.astype(np.int64) - down.astype(np.int64)
        done = slice(int(np.searchsorted(-size, -(j + 1), side="left")), k)
        if done.start < done.stop:
            total = score[done].copy()
            for w in range(lo, hi + 1):
                rows = np.where(bottom[done] < w, ~_U(0), np.where(bottom[done] == w, beyond[done], _U(0)))
                total -= np.bitwise_count(plus[w, done] & rows).astype(np.int64) - np.bitwise_count(minus[w, done] & rows).astype(np.int64)
            out[done] = total
    return out


#: Blocks of 64 characters by which pairs are put together, and pairs from which on that is worth it.
_CLASSES, _TOGETHER = (1, 2, 4, 8, 16, 32), 64


def within(a: list[str], b: list[str], most: list[int]) -> np.ndarray:
    """Whether each pair's distance is at most `most`. Many pairs of like length go together, others one by one."""
    out = np.zeros(len(a), bool)
    rest: dict[int, list[tuple[int, int, str, str]]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        if len(x) > len(y):
            x, y = y, x
        lo, n = 0, len(x)
        while lo + 32 <= n and x[lo : lo + 32] == y[lo : lo + 32]:
            lo += 32
        while lo < n and x[lo] == y[lo]:
            lo += 1
        x, y = x[lo:], y[lo:]
        hi, n, d = 0, len(x), len(y) - len(x)
        while hi + 32 <= n and x[n - hi - 32 : n - hi] == y[n + d - hi - 32 : n + d - hi]:
            hi += 32
        while hi < n and x[n - 1 - hi] == y[n + d - 1 - hi]:
            hi += 1
        x, y = x[: n - hi], y[: n + d - hi]
        if not x:
            out[i] = len(y) <= most[i]
        else:
            rest.setdefault(next((w for w in _CLASSES if 64 * w >= len(x)), -(-len(x) // 64)), []).append((len(y), i, x, y))
    for blocks, own in rest.items():
        if len(own) < _TOGETHER:
            for _, i, x, y in own:
                out[i] = distance(x, y, most[i]) <= most[i]
            continue
        own.sort(key=lambda r: -r[0])
        for at in range(0, len(own), 2048):
            part = own[at : at + 2048]
            i = np.array([r[1] for r in part])
            limit = np.array([most[k] for k in i])
            out[i] = _distances([r[2] for r in part], [r[3] for r in part], int(limit.max())) <= limit
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose edit similarity is SIMILARITY or more. What their words show to be alike is; others are compared by characters, many at a time."""
    left: list[tuple[int, int, str, str, int]] = []

    def settled() -> pa.RecordBatch:
        a, b, x, y, most = zip(*left)
        hit = np.flatnonzero(within(list(x), list(y), list(most)))
        left.clear()
        return pa.RecordBatch.from_arrays([pa.array([a[k] for k in hit], pa.int64()), pa.array([b[k] for k in hit], pa.int64())], names=["a", "b"])

    for batch in batches:
        ok = []
        for k, (a, b, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")))):
            most = int(most_edits(max(len(x), len(y))))
            if aligned(x.split(" "), y.split(" "), most):
                ok.append(k)
            elif abs(len(x) - len(y)) <= most:
                left.append((a, b, x, y, most))
        hit = pa.array(ok, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(hit), batch.column("b").take(hit)], names=["a", "b"])
        if len(left) >= 1 << 14:
            yield settled()
    if left:
        yield settled()
    tidy()


def _picked(batches: Iterator[pa.RecordBatch], rows, lines) -> Iterator[pa.RecordBatch]:
    """The normalised words of the lines that pass a filter, of the documents that pass another."""
    for batch in batches:
        batch = batch.filter(pa.array(passes(rows.value, batch.column("row").to_numpy())))
        for part in slices([batch]):
            x = Normal(part.column("text"))
            own = np.flatnonzero(passes(lines.value, x.line))
            yield pa.RecordBatch.from_arrays([pa.array(x.line[own]), x.texts(own)], names=["line", "words"])
    tidy()


def _held(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """The lines that pass a filter."""
    for batch in batches:
        yield batch.filter(pa.array(passes(held.value, batch.column("line").to_numpy())))
    tidy()


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines that have a word (doc_id, row, number, line), and the group of each line (line, group) that occurs again or is like another.

    Candidates are verified in two rounds: first those that connect all lines that any connect, then, of lines that have others too,
    all that are of different groups still.
    """
    sketches = ", ".join(f"{s} bigint" for s in _SKETCHES)
    kinds = f"doc_id bigint, row bigint, number int, line bigint, size int, {sketches}"
    keyed_docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    lines = written(keyed_docs.mapInArrow(_lines, kinds))
    counts = written(lines.groupBy("line").agg(F.min("row").alias("row"), F.count("*").alias("n")))
    wide = buckets(docs.sparkSession)
    keyed = lines.select("line", "size", *_SKETCHES)
    near = written(pairs(keyed.mapInArrow(lambda b: _keyed(b, wide), PACKED), ENTRY, _near).distinct())
    asked = written(near.select(F.explode(F.array("a", "b")).alias("line")).distinct().join(counts.select("line", "row"), "line"))
    rows, own = filter_of(asked.select("row")), filter_of(asked.select("line"))
    texts = written(keyed_docs.select("text", "row").mapInArrow(lambda b: _picked(b, rows, own), "line bigint, words string").dropDuplicates(["line"]))

    def verified(near: DataFrame) -> DataFrame:
        both = near.join(texts.select(F.col("line").alias("a"), F.col("words").alias("x")), "a").join(texts.select(F.col("line").alias("b"), F.col("words").alias("y")), "b")
        return both.mapInArrow(_verified, "a bigint, b bigint")

    parts = connected(verified(near.where("a <> b")))
    more = near.where("a = b").select(F.col("a").alias("line"))
    if not more.isEmpty():
        held = filter_of(more)
        some = keyed.mapInArrow(lambda b: _held(b, held), f"line bigint, size int, {sketches}")
        some = some.join(parts.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
        across = written(pairs(some.mapInArrow(lambda b: _keyed(b, wide, PLACED), PACKED), PLACED, _across).distinct())
        found = written(verified(across.join(near, ["a", "b"], "left_anti")))
        if not found.isEmpty():
            parts = connected(found.union(parts))
    placed = counts.select("line", "n").join(parts.withColumnRenamed("node", "line"), "line", "left").where("n > 1 or root is not null")
    return lines, placed.select("line", F.coalesce("root", "line").alias("group"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """One row for each line that goes: doc_id, row (hash of doc_id and text), number (of the line, from 0), kept_id, kept_number.

    Lines are normalised to lower-case words, and alike if the edit similarity of these is SIMILARITY or more; alike lines are
    connected, by way of others too. Of a group the first occurrence stays: the smallest doc_id (null last), then the smallest
    hash of the row, then the smallest number. Lines without a word, in null and empty texts too, are alike to nothing. Rows equal
    in doc_id and text are one. A line of any length is compared whole. Other columns are not read.
    """
    lines, groups = line_groups(docs)
    at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "number")
    placed = lines.select("doc_id", "row", "number", "line").join(groups, "line")
    first = placed.groupBy("group").agg(F.min(at).alias("first"))
    gone = placed.join(first, "group").where("not (doc_id <=> first.doc_id and row = first.row and number = first.number)")
    return gone.select("doc_id", "row", "number", F.col("first.doc_id").alias("kept_id"), F.col("first.number").alias("kept_number")).distinct()


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go, all other columns as they were, whatever their names. A document that had a word and has none left goes; null and empty texts stay."""
    gone = repeated_lines(docs).groupBy("doc_id", "row").agg(F.collect_set("number").alias("numbers")).select(F.struct("doc_id", "row").alias("at"), "numbers")
    held = docs.select(F.struct("*").alias("d"), F.struct(F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row")).alias("at"))
    joined = held.join(gone, held["at"].eqNullSafe(gone["at"]), "left").select("d", "numbers")
    kept = F.array_join(F.filter(F.split("d.text", "\n", -1), lambda _, i: ~F.array_contains("numbers", i)), "\n")
    text = F.when(F.col("numbers").isNull(), F.col("d.text")).otherwise(kept)
    left = joined.select("d", "numbers", text.alias("left")).where(F.col("numbers").isNull() | F.col("left").rlike(r"[0-9A-Za-z\x{80}-\x{10ffff}]"))
    return left.select(*(F.col("left").alias("text") if c == "text" else F.col("d").getField(c).alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that goes, beside the line of its group that stays."""
    return repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "number", "kept_id", "kept_number")
