"""Benchmark decontamination: an FM-index of each training shard, searched backward for test phrases through wavelet-tree ranks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, char_offsets, lowered, merged, raw_bytes, slices, span_hashes, table, tidy, words

#: Words of a test phrase; an item of fewer words is one phrase, if it has at least MIN_PHRASE.
PHRASE, MIN_PHRASE = 10, 5
#: Bytes of text in the shard of one index.
SHARD = 8_000_000
#: Bytes of the benchmark's texts, which go to every task.
MOST_BENCHMARK = 64_000_000
#: Every so many positions of the text, the suffix array is kept.
SAMPLE = 8

SPANS = "doc_id bigint, row bigint, item_ids array<bigint>, start bigint, end bigint"


@dataclass(frozen=True)
class Phrases:
    """vocabulary: sorted hashes of the benchmark's words, symbol k + 1 for the k-th; pairs: sorted symbol pairs that follow each other there; symbols, lengths, items: of each distinct phrase."""

    vocabulary: np.ndarray
    pairs: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    items: tuple[tuple[int, ...], ...]


def phrases(items: list[tuple[int | None, str | None]]) -> Phrases:
    """All runs of PHRASE words of all items; those of an item whose id is null count too, for no item. Null texts are left out."""
    items = [(i, t) for i, t in items if t]
    raw, offsets = raw_bytes(lowered(pa.array([t for _, t in items], pa.large_string())))
    starts, ends, text, first = words(raw, offsets)
    h = span_hashes(raw, starts, ends)
    vocabulary = np.unique(h)
    symbol = np.searchsorted(vocabulary, h) + 1
    pairs: set[int] = set()
    found: dict[tuple[int, ...], set[int]] = {}
    width = len(vocabulary) + 1
    for k, (item, _) in enumerate(items):
        own = symbol[first[k] : first[k + 1]].tolist()
        n = min(PHRASE, len(own))
        if n < MIN_PHRASE:
            continue
        pairs.update(a * width + b for a, b in zip(own, own[1:]))
        for j in range(len(own) - n + 1):
            found.setdefault(tuple(own[j : j + n]), set()).update(() if item is None else (item,))
    keys = list(found)
    symbols = np.zeros((len(keys), PHRASE), np.int64)
    for r, key in enumerate(keys):
        symbols[r, : len(key)] = key
    return Phrases(vocabulary, np.array(sorted(pairs), np.int64), symbols, np.array([len(k) for k in keys], np.int64), tuple(tuple(sorted(found[k])) for k in keys))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; s ends in the only smallest symbol."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, k = len(s), 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2
        if k >= n:
            return order


class Wavelet:
    """A wavelet tree laid out by level (highest bit first, zeros before ones): how often a symbol occurs before a position."""

    def __init__(self, s: np.ndarray, top: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])  # a shard has fewer than 2^31 words
            self.levels.append((b, ones, len(s) - int(ones[-1])))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(at), at
        for b, ones, zeros in self.levels:
            up = ((symbol >> b) & 1).astype(bool)
            a, z = ones[lo], ones[hi]
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return hi - lo


class FMIndex:
    """Of a sequence of symbols from 1 to top, in which 0 parts what isn't adjacent."""

    def __init__(self, s: np.ndarray, top: int):
        s = np.append(s + 1, 0)  # the end is the only 0
        sa = suffix_array(s)
        self.last = s[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 3))])
        self.wavelet = Wavelet(self.last, top + 1)
        self.kept = sa % SAMPLE == 0
        self.place = np.cumsum(self.kept) - 1
        self.samples = sa[self.kept]
        self.size = len(s)

    def search(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each phrase, all phrases a step at a time from their last symbols on."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size)
        live = np.arange(len(lengths))
        for k in range(int(lengths.max(initial=0))):
            live = live[(hi[live] > lo[live])]
            now = live[lengths[live] > k]
            c = symbols[now, lengths[now] - 1 - k] + 1
            lo[now] = self.before[c] + self.wavelet.rank(c, lo[now])
            hi[now] = self.before[c] + self.wavelet.rank(c, hi[now])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows: back through the text to the next sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1)
        todo = np.arange(len(rows))
        while len(todo):
            there = self.kept[at[todo]]
            done = todo[there]
            out[done] = self.samples[self.place[at[done]]] + steps[done]
            todo = todo[~there]
            c = self.last[at[todo]]
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
        return out


def occurrences(symbol: np.ndarray, text: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase number and number of the first word of each occurrence in a shard. symbol: of each word, 0 for those that no item has; text: the number of each word's text."""
    if len(symbol) < 2 or not len(p.lengths):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = len(p.vocabulary) + 1
    both = np.flatnonzero((symbol[:-1] > 0) & (symbol[1:] > 0) & (text[:-1] == text[1:]))
    key = symbol[both].astype(np.int64) * width + symbol[both + 1]
    slot = np.minimum(np.searchsorted(p.pairs, key), len(p.pairs) - 1)
    both = both[p.pairs[slot] == key]  # words that follow each other in no item can't be in a phrase
    if not len(both):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    head = np.concatenate([[True], np.diff(both) > 1])
    tail = np.concatenate([head[1:], [True]])
    lo, hi = both[head], both[tail] + 2
    long = hi - lo >= p.lengths.min()
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = hi - lo + 1  # with a separator behind each run
    begin = np.concatenate([[0], np.cumsum(size)])
    inside = np.repeat(lo - begin[:-1], size) + np.arange(begin[-1])
    s = symbol[np.minimum(inside, len(symbol) - 1)]
    s[begin[1:] - 1] = 0
    index = FMIndex(s, width - 1)
    a, b = index.search(p.symbols, p.lengths)
    n = b - a
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    return which, inside[index.locate(rows)]


def _symbols(raw: np.ndarray, offsets: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and symbol of each word of a shard, made of some texts at a time, in narrow numbers: workers share an executor's memory."""
    kind = np.int32 if len(raw) < 1 << 31 else np.int64
    parts: list[list[np.ndarray]] = [[np.empty(0, kind)] for _ in range(4)]
    at = 0
    while at < len(offsets) - 1:
        base = int(offsets[at])
        to = max(at + 1, int(np.searchsorted(offsets, base + SLICE_BYTES, side="right")) - 1)
        part = raw[base : offsets[to]]
        starts, ends, text, _ = words(part, offsets[at : to + 1] - base)
        if len(starts):
            h = span_hashes(part, starts, ends)
            slot = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
            for column, x in zip(parts, (starts + base, ends + base, text + at, np.where(p.vocabulary[slot] == h, slot + 1, 0))):
                column.append(x.astype(kind))
        at = to
    return tuple(np.concatenate(x) for x in parts)


def _spans(batches: Iterator[pa.RecordBatch], p: Phrases) -> Iterator[pa.RecordBatch]:
    for batch in slices(_joined(batches), most=SHARD):
        if len(p.vocabulary) and (found := _found(batch, p)) is not None:
            yield found
    tidy()


def _found(batch: pa.RecordBatch, p: Phrases) -> pa.RecordBatch | None:
    """The spans of a shard, if it has any."""
    kinds = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("start", pa.int64()), ("end", pa.int64())])
    raw, offsets = raw_bytes(lowered(batch.column("text")))
    starts, ends, text, symbol = _symbols(raw, offsets, p)
    which, at = occurrences(symbol, text, p)
    if not len(at):
        return None
    order = np.argsort(at, kind="stable")
    which, at = which[order], at[order]
    doc, lo, hi = text[at], starts[at], ends[at + p.lengths[which] - 1]
    out: list[tuple[int, set[int], int, int]] = []
    for d, w, a, b in zip(doc.tolist(), which.tolist(), lo.tolist(), hi.tolist()):  # in order: spans that overlap become one
        if out and out[-1][0] == d and a <= out[-1][3]:
            e = out[-1]
            out[-1] = (d, e[1] | set(p.items[w]), e[2], max(e[3], b))
        else:
            out.append((d, set(p.items[w]), a, b))
    ids, row = batch.column("doc_id"), batch.column("row")
    rows: list[list] = [[] for _ in kinds]
    k = 0
    while k < len(out):
        d = out[k][0]
        own = []
        while k < len(out) and out[k][0] == d:
            own.append(out[k])
            k += 1
        a = char_offsets(raw, int(offsets[d]), np.array([x[2] for x in own]))
        b = char_offsets(raw, int(offsets[d]), np.array([x[3] for x in own]))
        for x, s, e in zip(own, a.tolist(), b.tolist()):
            for column, value in zip(rows, (ids[d].as_py(), row[d].as_py(), sorted(x[1]), s, e)):
                column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, kinds)], schema=kinds)


def _joined(batches: Iterator[pa.RecordBatch], most: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Batches put together to about `most` bytes."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        kept.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0] if sum(b.num_rows for b in kept) else kept[0]
            kept, size = [], 0
    if sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def benchmark_phrases(benchmark: DataFrame) -> Phrases:
    """The benchmark is collected: it is a set of test items, which doesn't grow with the corpus. One of more than MOST_BENCHMARK bytes is an error, not cut: it is to be searched in parts."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > MOST_BENCHMARK:
        raise ValueError(f"the benchmark has {size} bytes of text; at most {MOST_BENCHMARK} are searched at once")
    t = benchmark.select("item_id", "text").toArrow()
    return phrases(sorted(zip(t["item_id"].to_pylist(), t["text"].to_pylist()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each span of a document that test phrases cover: doc_id, row (hash of doc_id and text), the items, start and end in characters.

    A phrase is a run of PHRASE lower-case words of an item, or all words of a shorter one (of fewer than MIN_PHRASE: none). Spans
    that overlap or touch are one. Null and empty texts and items have none; repeated rows give repeated results; an empty
    benchmark gives no rows. Texts of any length are indexed whole. Other columns are not read.
    """
    p = benchmark_phrases(benchmark)
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).mapInArrow(lambda b: _spans(b, p), SPANS)


def _cleaned(batches: Iterator[pa.RecordBatch], p: Phrases) -> Iterator[pa.RecordBatch]:
    for batch in slices(_joined(batches), most=SHARD):
        at = batch.schema.get_field_index("text")
        texts = batch.column(at)
        numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), pa.array([0] * batch.num_rows, pa.int64()), texts], names=["doc_id", "row", "text"])
        spans: dict[int, list[tuple[int, int]]] = {}
        for part in _spans(iter([numbered]), p):
            for d, a, b in zip(part["doc_id"].to_pylist(), part["start"].to_pylist(), part["end"].to_pylist()):
                spans.setdefault(d, []).append((a, b))
        if spans:
            order = sorted(spans)
            new = pa.array([without(texts[d].as_py(), spans[d]) for d in order], texts.type)
            mask = np.zeros(batch.num_rows, bool)
            mask[order] = True
            batch = batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(texts, pa.array(mask), new))
        yield batch
    tidy()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in merged(spans):
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with the spans that test phrases cover cut out of their texts; all other columns, whatever their names, and texts without such spans as they were.

    No document goes: null and empty texts stay, repeated rows are treated alike, and an empty benchmark or table changes nothing.
    """
    p = benchmark_phrases(benchmark)
    return docs.mapInArrow(lambda b: _cleaned(b, p), docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
