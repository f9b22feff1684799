"""Tokens counted by document, and documents turned into blocks of postings, in Arrow batches: neither moves a row between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stemming import stemmer

#: Tokens that are counted, and postings that are turned, at once; a document is never cut.
PIECE, BLOCK = 1 << 18, 1 << 20
#: Stems that a task remembers.
KNOWN = 1 << 17


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` elements. Afterwards the worker, which Spark keeps, gives back the memory that it has freed."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
    pa.default_memory_pool().release_unused()
    if (trim := _malloc_trim()) is not None:
        trim(0)


@cache
def _malloc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return None


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def until(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _counter(n_fields: int, language: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, known = stemmer(language), {}
        for batch in batches:
            inner = batch.column(1).flatten()
            lens = pc.list_value_length(inner).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n_fields)
            for a, b in pieces(lens.sum(1), PIECE):
                own = lens[a:b]
                coded = inner.slice(a * n_fields, own.size).flatten().dictionary_encode()
                words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                terms, other = words, None
                if language != "none":  # each distinct token is stemmed once; words of one stem get adjacent numbers
                    if len(known) > KNOWN:
                        known.clear()
                    terms = pa.array([known[w] if w in known else known.setdefault(w, stem(w)) for w in words.to_pylist()], words.type)
                    order = np.argsort(terms.dictionary_encode().indices.to_numpy(zero_copy_only=False), kind="stable")
                    rank = np.empty(len(order), np.int64)
                    rank[order] = np.arange(len(order))
                    codes, words, terms = rank[codes], words.take(pa.array(order)), terms.take(pa.array(order))
                    other = pc.if_else(pc.equal(words, terms), pa.scalar(None, words.type), words)
                slots = np.repeat(np.arange(own.size), own.ravel())  # row, field
                key, tf = np.unique((slots // n_fields * max(1, len(words)) + codes) * n_fields + slots % n_fields, return_counts=True)
                row, code = np.divmod(key // n_fields, max(1, len(words)))
                field = key % n_fields
                if other is not None:
                    full = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)[code]
                    row, code, field, tf = row[full], code[full], field[full], tf[full]
                offsets, taken = np.searchsorted(row, np.arange(b - a + 1)), pa.array(code)
                raws = pa.nulls(b - a, pa.list_(words.type)) if other is None else lists(other.take(taken), offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(own.sum(1)), lists(pa.array(own.ravel()), np.arange(b - a + 1) * n_fields), lists(terms.take(taken), offsets), raws, lists(pa.array(field, pa.int32()), offsets), lists(pa.array(tf, pa.int32()), offsets)],
                    names=["name", "len", "field_lens", "terms", "raws", "fieldids", "tfs"],
                )

    return count


def counted(rows: DataFrame, n_fields: int, language: str) -> DataFrame:
    """name, len, field_lens, terms, raws, fieldids, tfs: a row for each row of (name, fields), whose postings are parallel arrays in which those of a term, and within them those of a raw term, are side by side. A raw term is null if it is the term, and raws is if tokens are not stemmed."""
    name = rows.schema["name"].dataType.simpleString()
    return rows.select("name", "fields").mapInArrow(_counter(n_fields, language), f"name {name}, len bigint, field_lens array<bigint>, terms array<string>, raws array<string>, fieldids array<int>, tfs array<int>")


def _changes(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Where the row or the code is not that of the element before."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return new


def _inverter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, field_lens, terms, raws, fieldids, tfs = (batch.column(c) for c in ("name", "field_lens", "terms", "raws", "fieldids", "tfs"))
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
        flat_lens = field_lens.flatten().to_numpy(zero_copy_only=False)
        n_fields = len(flat_lens) // max(1, len(batch))
        for a, b in pieces(sizes, BLOCK):
            n, own = b - a, sizes[a:b]
            term = terms.slice(a, n).flatten()
            if not len(term):
                continue
            coded = term.dictionary_encode()
            row, t = np.repeat(np.arange(n), own), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            pair, words, raw = t, coded.dictionary, None
            if raws.null_count < len(raws):
                coded = pc.coalesce(raws.slice(a, n).flatten(), term).dictionary_encode()
                pair = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                _, where = np.unique(pair, return_index=True)  # a raw term has one stem
                words = term.take(pa.array(where))
                raw = pc.if_else(pc.equal(coded.dictionary, words), pa.scalar(None, words.type), coded.dictionary)
            bits = int(len(row)).bit_length()
            order = np.sort((pair << bits) | np.arange(len(row))) & ((1 << bits) - 1)  # by pair, then by place
            counts = np.bincount(pair, minlength=len(words))
            offsets, field = until(counts), fieldids.slice(a, n).flatten().to_numpy(zero_copy_only=False)
            flen = flat_lens[(a + row) * n_fields + field]
            yield pa.RecordBatch.from_arrays(
                [
                    words, pa.nulls(len(words), words.type) if raw is None else raw,
                    pa.array(np.bincount(pair[_changes(row, t)], minlength=len(words))), pa.array(np.bincount(pair[_changes(row, pair)], minlength=len(words))),
                    lists(names.slice(a, n).take(pa.array(row[order])), offsets), lists(pa.array(field[order], pa.int32()), offsets),
                    lists(pa.array(tfs.slice(a, n).flatten().to_numpy(zero_copy_only=False)[order], pa.int32()), offsets), lists(pa.array(flen[order], pa.int32()), offsets),
                ],
                names=["term", "raw", "df", "raw_df", "names", "fieldids", "tfs", "flens"],
            )


def inverted(forward: DataFrame) -> DataFrame:
    """term, raw, df, raw_df, names, fieldids, tfs, flens: blocks of the postings of a term and a raw term, of some thousand documents each. raw is null if it is the term. df and raw_df: what the block adds to the documents of the term, and of the pair."""
    name = forward.schema["name"].dataType.simpleString()
    return forward.select("name", "field_lens", "terms", "raws", "fieldids", "tfs").mapInArrow(_inverter, f"term string, raw string, df bigint, raw_df bigint, names array<{name}>, fieldids array<int>, tfs array<int>, flens array<int>")


def from_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each posting. The arrays are never empty; the outer form keeps Spark from testing that by zipping them once more."""
    each = blocks.select("term", F.coalesce("raw", "term").alias("raw_term"), F.inline_outer(F.arrays_zip("names", "fieldids", "tfs", "flens")))
    return each.select("term", "raw_term", F.col("names").alias("name"), F.col("fieldids").alias("fieldid"), F.col("tfs").cast("long").alias("tf"), F.col("flens").cast("long").alias("flen"))


def from_documents(forward: DataFrame) -> DataFrame:
    """The same postings, document by document."""
    zipped = F.arrays_zip("terms", F.coalesce("raws", F.array().cast("array<string>")).alias("raws"), "fieldids", "tfs")
    each = forward.select("name", "field_lens", F.inline_outer(zipped)).where("terms is not null")
    return each.select(F.col("terms").alias("term"), F.coalesce("raws", "terms").alias("raw_term"), "name", F.col("fieldids").alias("fieldid"), F.col("tfs").cast("long").alias("tf"), F.col("field_lens")[F.col("fieldids")].alias("flen"))


def dictionary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("term").agg(F.sum("df").alias("df"))


def raw_dictionary(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(F.coalesce("raw", "term").alias("raw_term"), "term").agg(F.sum("raw_df").alias("df"))
