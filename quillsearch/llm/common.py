"""What the operators share: slicing Arrow batches, words as numpy arrays, tables, folders for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; a longer text is handled whole, alone.
SLICE_BYTES = 2_000_000

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints that the session names; only where none is named, as in tests, a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; no text is divided."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind one another, and the n + 1 offsets of the texts; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - (off[0] if len(off) else 0)


def lowered(column: pa.Array) -> pa.Array:
    """Lower case by code point, so that character offsets stay as they are."""
    return pc.utf8_lower(pc.fill_null(column, ""))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        one = np.ones(1, _U)
        _POWERS[:] = [np.concatenate([one, np.cumprod(np.full(size, p, _U))]) for p in (_P, _P_INV)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are in order and don't overlap; equal bytes give equal hashes."""
    out = np.zeros(len(starts), _U)
    at = 0
    while at < len(starts):  # in blocks, so that the powers stay in cache
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        power, inverse = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(_byte_values()[raw[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (total[e] - total[s]) * inverse[s]
        at = to
    return mix(out ^ (ends - starts).astype(_U))


@cache
def _word_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return t


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word, a run of ASCII letters and digits or of any other code points beyond ASCII; and the number of words before each text (n + 1). Words don't go over a text's end."""
    inside = _word_bytes()[raw] if len(raw) else np.empty(0, bool)
    edge = np.zeros(len(raw) + 1, bool)
    if len(raw):
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0], edge[-1] = inside[0], inside[-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        both = cuts[inside[cuts] & inside[cuts - 1]]
        edge[both] = True
    at = np.flatnonzero(edge)
    if len(raw) and len(both := np.unique(both)):  # a word that ends where the next text's first begins: the edge counts twice
        at = np.sort(np.concatenate([at, both]))
    starts, ends = at[0::2], at[1::2]
    first = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return starts, ends, text, first


def ngrams(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n words in a row of one text, and the number of the first word of each."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    out = np.zeros(m, _U)
    for k in range(n):
        out = (out ^ h[k : k + m]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(out[at]), at


def char_offsets(raw: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets in a text that begins at byte `base`."""
    if not len(at):
        return at
    lead = (raw[base : int(at.max())] & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])
    return count[at - base]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; those that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif b > a:
            out.append((a, b))
    return out


#: Entries that a task compares by itself; larger buckets are dealt out in parts of so many, each two parts to a task.
PART = 1 << 20
#: Buckets for each partition of a shuffle.
BUCKETS = 8
#: Rows of one window up to which windows are compared all at once, a pair of each at a time; larger ones are compared by themselves. The pairs are the same.
SMALL_GROUP = 96
#: Pairs that are held before those are left out that connect nothing.
MOST_HELD = 1 << 21

PACKED = "bucket int, n int, entries binary"


def buckets(spark: SparkSession) -> int:
    return BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(entries: np.ndarray, group: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A row for each bucket that groups fall into, with its entries: for a shuffle that has a few large rows instead of many small ones."""
    bucket = (mix(group.astype(_U)) % _U(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    kinds, first = np.unique(bucket[order], return_index=True)
    edge = np.append(first, len(order))
    # not pa.array of memoryviews: Arrow never gives those up, so that each worker would keep all entries it ever packed
    ends = pa.py_buffer((edge * entries.dtype.itemsize).astype(np.int32))
    blobs = pa.Array.from_buffers(pa.binary(), len(kinds), [None, ends, pa.py_buffer(entries[order].view(np.uint8))])
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.diff(edge).astype(np.int32)), blobs], names=["bucket", "n", "entries"])


def pairs(rows: DataFrame, kind: np.dtype, compare) -> DataFrame:
    """(a, b) for the pairs that compare(entries) finds in each bucket of packed rows.

    A bucket of more than PART entries isn't held by any task: its rows pass through, numbered by parts, and each two parts are
    compared by a task of their own, so that no pair is missed.
    """
    sorted_ = rows.repartition("bucket").sortWithinPartitions("bucket")
    found = written(sorted_.mapInArrow(lambda b: _compared(b, kind, compare), f"a bigint, b bigint, part int, {PACKED}"))
    edges = found.where("part is null").select("a", "b")
    hot = found.where("part is not null").select("part", "bucket", "entries")
    if hot.isEmpty():
        return edges
    last = hot.groupBy("bucket").agg(F.max("part").alias("last"))
    met = F.transform(F.sequence(F.lit(0), "last"), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    dealt = hot.join(last, "bucket").select("entries", F.explode(met).alias("m"), "bucket").select("entries", F.xxhash64("bucket", "m.i", "m.j").alias("task"))
    return edges.union(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: _met(b, kind, compare), "a bigint, b bigint"))


def _entries(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _compared(batches: Iterator[pa.RecordBatch], kind: np.dtype, compare) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("entries", pa.binary())])
    kept: list[bytes] = []
    now, total, large = None, 0, False

    def close() -> Iterator[pa.RecordBatch]:
        if kept:
            a, b = compare(_entries(kept, kind))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in list(schema)[2:])], schema=schema)

    def passed(blob: bytes, at: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, at // PART, now, len(blob) // kind.itemsize, blob), schema)], schema=schema)

    for batch in batches:
        for bucket, n, blob in zip(batch.column("bucket").to_pylist(), batch.column("n").to_pylist(), batch.column("entries")):
            if bucket != now:
                yield from close()
                now, total, large, kept = bucket, 0, False, []
            data = blob.as_py()
            if not large and total + n > PART:
                at = 0
                for x in kept:
                    yield passed(x, at)
                    at += len(x) // kind.itemsize
                large, kept = True, []
            if large:
                yield passed(data, total)
            else:
                kept.append(data)
            total += n
    yield from close()
    tidy()


def _met(batches: Iterator[pa.RecordBatch], kind: np.dtype, compare) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "task"):
        a, b = compare(_entries(t["entries"].to_pylist(), kind))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    tidy()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Each group of rows with one key, from rows sorted by key."""
    kept: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(edge, edge[1:]):
            if kept and k[lo] != now:
                yield pa.Table.from_batches(kept)
                kept = []
            now = k[lo]
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept)


#: Rows that others are compared with at once, and pairs: so many that the bits in which they differ stay in a core's cache.
_WIDE, _CACHED = 1 << 13, 1 << 16


def _near_bits(words: tuple[np.ndarray, ...], most: np.ndarray, i: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the rows i, which follow one another, and lo to hi whose words differ in at most `most` bits: numbers in i, and from lo; the bits."""
    tall = min(len(i), -(-_CACHED // (hi - lo)))
    shape = (tall, hi - lo)
    unlike, far, more, met = np.empty(shape, _U), np.empty(shape, np.uint8), np.empty(shape, np.uint8), np.empty(shape, bool)
    found, bits = [], []
    for k in range(0, len(i), tall):
        own = slice(int(i[k]), int(i[min(k + tall, len(i)) - 1]) + 1)
        n = own.stop - own.start
        for w, word in enumerate(words):
            np.bitwise_xor(word[own, None], word[None, lo:hi], out=unlike[:n])
            np.bitwise_count(unlike[:n], out=(more if w else far)[:n])
            if w:
                np.add(far[:n], more[:n], out=far[:n])
        np.less_equal(far[:n], most[own, None], out=met[:n])
        at = np.flatnonzero(met[:n])
        if len(at):
            found.append(at + k * (hi - lo))
            bits.append(far[:n].ravel()[at])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    return *np.divmod(np.concatenate(found), hi - lo), np.concatenate(bits)


def close_rows(key: np.ndarray, apart, most, reach_by: int = 0, label: np.ndarray | None = None, words: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of row numbers at most `most` apart, in parts, with their distances; where labels are given, those of different labels only.

    key: rising; rows are compared whose keys differ by `reach_by` at most. most: for each row; apart(i, j) takes arrays of row numbers
    that broadcast and gives distances. words: 64-bit words of each row, where the distance is the bits in which these differ (three words
    at most); in wide windows they are compared in its place, which takes less time. The pairs are the same.
    """
    row = np.arange(len(key))
    end = np.searchsorted(key, key + reach_by, side="right")
    wide = end - row > SMALL_GROUP
    at = np.flatnonzero(wide)
    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
        for k in range(0, len(run), 64):
            i = run[k : k + 64]
            for lo in range(int(i[0]) + 1, int(end[i[-1]]), _WIDE):
                j = row[lo : min(lo + _WIDE, int(end[i[-1]]))]
                if words is not None:
                    p, q, d = _near_bits(words, most, i, lo, lo + len(j))
                else:
                    d = apart(i[:, None], j[None, :])
                    p, q = np.nonzero(d <= most[i][:, None])
                    d = d[p, q]
                own = (j[q] > i[p]) & (j[q] < end[i[p]])
                if label is not None:
                    own &= label[i[p]] != label[j[q]]
                if own.any():
                    yield i[p[own]], j[q[own]], d[own]
    at = np.flatnonzero(~wide & (end > row + 1))
    step = 1
    while len(at):
        for lo in range(0, len(at), 1 << 16):
            i = at[lo : lo + (1 << 16)]
            if label is not None:
                i = i[label[i] != label[i + step]]
            d = apart(i, i + step)
            hit = np.flatnonzero(d <= most[i])
            if len(hit):
                yield i[hit], i[hit] + step, d[hit]
        step += 1
        at = at[at + step < end[at]]


def linked(key: np.ndarray, apart, most, reach_by: int = 0, words: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of close_rows those that connect what all of them connect, by the nearest pairs; and the rows that have other pairs besides.

    Of each cycle the pair that is farthest apart is left out. Where a pair that stays proves to be none by other means, one that was
    left out may be what connects: these rows are to be compared again.
    """
    n = len(key)
    held = [np.empty((3, 0), np.int64)]
    more = np.zeros(n, bool)
    size = 0

    def reduced() -> np.ndarray:
        edges = np.concatenate(held, axis=1)
        some = np.zeros(edges.shape[1], bool)
        some[forest(n, *edges)] = True
        more[edges[:2, ~some]] = True
        return edges[:, some]

    for i, j, d in close_rows(key, apart, most, reach_by, words=words):
        held.append(np.stack([i, j, d.astype(np.int64)]))
        size += len(i)
        if size > MOST_HELD:  # a forest has fewer edges than rows
            held = [reduced()]
            size = 0
    x, y, _ = reduced()
    return x, y, np.flatnonzero(more)


def links(key: np.ndarray, apart, most, reach_by: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of linked, without the rows that have others."""
    return linked(key, apart, most, reach_by)[:2]


def forest(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a lightest spanning forest; of equal weights the first edge counts. Each round every component takes its lightest edge out."""
    order = np.argsort(weight, kind="stable")
    label = np.arange(n)
    chosen: list[np.ndarray] = []
    while len(order):
        a, b = label[left[order]], label[right[order]]
        apart = a != b
        order, a, b = order[apart], a[apart], b[apart]
        if not len(order):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, a, np.arange(len(order)))
        np.minimum.at(best, b, np.arange(len(order)))
        some = np.unique(best[best < len(order)])
        chosen.append(order[some])
        label = labels_of(n, a[some], b[some])[label]
    return np.concatenate([np.empty(0, np.int64), *chosen])


def labels_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row number that the edges connect it with."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node it is connected with. Large-star and small-star rounds, each cut from its lineage; a round sends every edge a fixed number of times."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        e = cut(joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder, of which later reads take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives memory that Arrow and malloc hold for later back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if (trim := _malloc_trim()) is not None:
        trim(0)


@cache
def _malloc_trim():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


#: Bits of a filter of hashes: its size doesn't follow the data. The more hashes it holds, the more others pass it too; what passes is joined exactly afterwards.
FILTER_BITS = 26


def filter_of(hashes: DataFrame):
    """A Bloom filter of a column of 64-bit hashes (two bits for each), broadcast. Its words are gathered with their bits put together first."""
    x = hashes.select(F.col(hashes.columns[0]).alias("x"))
    bit = F.explode(F.array(F.col("x").bitwiseAND((1 << FILTER_BITS) - 1), F.shiftright("x", 64 - FILTER_BITS).bitwiseAND((1 << FILTER_BITS) - 1)))
    word = x.select(bit.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[word["word"].to_numpy()] = word["bits"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bits)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    x = hashes.view(_U) if hashes.dtype == np.int64 else hashes
    word = bits.view(_U)
    out = np.ones(len(x), bool)
    for at in (x & _U((1 << FILTER_BITS) - 1), x >> _U(64 - FILTER_BITS)):
        out &= (word[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
    return out
