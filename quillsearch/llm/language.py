"""Language identification by interpolated Kneser-Ney character models in sorted arrays, with calibrated rejection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy, written

#: Characters a gram, of 16 bits each in one 64-bit number. The counts of shorter grams follow from those of whole ones.
ORDER = 4
#: A text is rejected if its cross-entropy is above that of nearly all (QUANTILE) documents of its language, by more than MARGIN bits a character; SPREAD standard errors are allowed for a text's length.
QUANTILE, MARGIN, SPREAD = 0.995, 0.25, 3.0
ACCURACY = 100_000

_U = np.uint64
_MASKS = [_U(0), _U(0xFFFF), _U(0xFFFFFFFF), _U(0xFFFFFFFFFFFF), _U(0xFFFFFFFFFFFFFFFF)]
SCHEMA = "doc_id bigint, language string, cross_entropy double, margin double, n_grams bigint, keep boolean"


def _letters() -> np.ndarray:
    t = np.full(0x110000, 32, np.uint16)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha() or unicodedata.category(s)[0] == "M":  # marks belong to their letters
            low = s.lower()
            t[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    t[0x10000:0xE0000] = 1  # beyond 16 bits: one letter
    return t


_TABLE: list[np.ndarray] = []


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character and at the end of each text, and the number of grams before each text. Letters are lower case, runs of all else are one space; texts without letters have none."""
    if not _TABLE:
        _TABLE.append(_letters())
    texts = pc.fill_null(column, "").to_pylist()
    flat = np.frombuffer("".join(x + " " for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    c = _TABLE[0][flat]
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    heads = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    keep[heads[c[heads] == 32]] = False  # a text's leading space is in its padding
    c, doc = c[keep].astype(_U), doc[keep]
    before = np.searchsorted(doc, np.arange(len(texts) + 1))
    place = np.arange(len(c)) - before[doc]
    key = c.copy()
    for k in range(1, ORDER):
        back = np.full(len(c), 32, _U)
        back[k:] = c[:-k] if k < len(c) else back[k:]
        back[place < k] = 32
        key |= back << _U(16 * k)
    return key, before


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams and their counts by language, added up over all batches of the task in parts."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in slices(batches):
        lang = np.array(batch.column("lang").to_pylist(), object)
        for name in {x for x in lang.tolist() if x is not None}:
            key, _ = grams(batch.column("text").filter(pa.array(lang == name)))
            parts = held.setdefault(name, [])
            parts.append(np.unique(key, return_counts=True))
            if len(parts) > 16:
                held[name] = [_added(parts)]
    for name, parts in held.items():
        key, n = _added(parts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, which, np.concatenate([n for _, n in parts]))
    return key, n


class KneserNey:
    """One language's model: for each order the sorted grams, and the sorted contexts with what is taken off and left over."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        key, n = key[order], n[order].astype(np.float64)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(ORDER, 0, -1):
            one, two = (n == 1).sum(), (n == 2).sum()
            off = one / (one + 2 * two) if one and two else 0.5
            context, which = np.unique(key >> _U(16), return_inverse=True)
            total, kinds = np.bincount(which, n), np.bincount(which)
            self.orders.append((key, np.maximum(n - off, 0) / total[which], context, off * kinds / total))
            if k > 1:  # shorter grams count by how many different characters they follow
                key, n = np.unique(key & _MASKS[k - 1], return_counts=True)
                n = n.astype(np.float64)
        self.symbols = len(self.orders[-1][0]) + 1

    def probability(self, key: np.ndarray, k: int = ORDER) -> np.ndarray:
        if k == 0:
            return np.full(len(key), 1 / self.symbols)
        own, p, context, left = self.orders[ORDER - k]
        lower = self.probability(key & _MASKS[k - 1], k - 1)
        if not len(own):
            return lower
        at = np.minimum(np.searchsorted(own, key), len(own) - 1)
        c = np.minimum(np.searchsorted(context, key >> _U(16)), len(context) - 1)
        return np.where(own[at] == key, p[at], 0.0) + np.where(context[c] == key >> _U(16), left[c], 1.0) * lower


@dataclass
class Models:
    """names: the languages; models; grams: those that any has, sorted; bits: for each of these and each language, minus log2 of its probability; limits: for each language the mean, the deviation of a character and the rest that is allowed (infinite: nothing is rejected)."""

    names: list[str]
    models: list[KneserNey]
    grams: np.ndarray
    bits: np.ndarray
    limits: np.ndarray

    def measure(self, key: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros((len(key), len(self.names)), np.float32)
        at = np.minimum(np.searchsorted(self.grams, key), len(self.grams) - 1)
        out = self.bits[at]
        new = np.flatnonzero(self.grams[at] != key)
        if len(new):
            some, which = np.unique(key[new], return_inverse=True)
            out[new] = np.stack([-np.log2(m.probability(some)) for m in self.models], axis=1).astype(np.float32)[which]
        return out


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    names = sorted(counts)
    models = [KneserNey(*counts[x]) for x in names]
    known = np.unique(np.concatenate([m.orders[0][0] for m in models])) if models else np.empty(0, _U)
    bits = np.stack([-np.log2(m.probability(known)) for m in models], axis=1).astype(np.float32) if models else np.zeros((0, 0), np.float32)
    return Models(names, models, known, bits, np.full((len(names), 3), np.inf))


def entropies(models: Models, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits a character of each text under each language, and the number of grams of each text."""
    key, before = grams(column)
    n = np.diff(before)
    total = np.zeros((len(n), len(models.names)))
    some = np.flatnonzero(n)
    if len(some) and len(models.names):
        total[some] = np.add.reduceat(models.measure(key), before[some], axis=0, dtype=np.float64)
    return total / np.maximum(n, 1)[:, None], n


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """For each document with letters its language, its bits a character under that language's model, their sum and sum of squares, and its grams."""
    models: Models = shared.value
    place = {x: k for k, x in enumerate(models.names)}
    for batch in slices(batches, most=500_000):
        key, before = grams(batch.column("text"))
        bits = models.measure(key)
        lang, n = batch.column("lang").to_pylist(), np.diff(before)
        some = np.flatnonzero(n).tolist()
        own = [bits[before[d] : before[d + 1], place[lang[d]]].astype(np.float64) for d in some]
        total, square = np.array([x.sum() for x in own], np.float64), np.array([(x**2).sum() for x in own], np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([lang[d] for d in some], pa.string()), pa.array(total / n[some]), pa.array(total), pa.array(square), pa.array(n[some].astype(np.int64))], names=["lang", "h", "total", "square", "n"])


def calibrate(models: Models, known: DataFrame) -> None:
    """Sets the limits by all documents (text, lang) of known language; a language with fewer than 20 rejects nothing. Quantiles are exact up to ACCURACY documents a language, beyond it their rank is off by a part of 1 / ACCURACY."""
    if not models.names:
        return
    shared = known.sparkSession.sparkContext.broadcast(models)
    scored = written(known.select("text", "lang").mapInArrow(lambda b: _scored(b, shared), "lang string, h double, total double, square double, n bigint"))
    all_ = scored.groupBy("lang").agg(F.count("*").alias("docs"), F.percentile_approx("h", 0.5, ACCURACY).alias("mean"), F.sum("total").alias("total"), F.sum("square").alias("square"), F.sum("n").alias("n")).where("docs >= 20")
    by = all_.select("lang", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") / F.col("n") - F.pow(F.col("total") / F.col("n"), 2))).alias("deviation"))
    rest = scored.join(F.broadcast(by), "lang").withColumn("rest", F.col("h") - F.col("mean") - SPREAD * F.col("deviation") / F.sqrt("n"))
    limits = rest.groupBy("lang").agg(F.first("mean"), F.first("deviation"), F.percentile_approx("rest", QUANTILE, ACCURACY))
    for name, mean, deviation, most in limits.collect():
        models.limits[models.names.index(name)] = mean, deviation, max(0.0, most) + MARGIN
    shared.unpersist()


def fit(docs: DataFrame) -> Models:
    """Models of all languages of the documents' column lang, from all these documents. Null languages and texts are left out.

    What is collected are the distinct grams of ORDER letters: their number is bounded by the alphabets, not by the corpus.
    """
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    found = known.select("text", "lang").mapInArrow(_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    key, n = found["gram"].to_numpy().view(_U), found["n"].to_numpy()
    names = sorted(pc.unique(found["lang"]).to_pylist())
    lang = pc.index_in(found["lang"], pa.array(names, pa.string())).to_numpy()
    models = train({x: (key[lang == k], n[lang == k]) for k, x in enumerate(names)})
    calibrate(models, known)
    return models


def _identified(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    models: Models = shared.value
    names = np.array([*models.names, None], object)
    for batch in slices(batches, most=1_000_000):
        h, n = entropies(models, batch.column("text"))
        rows = np.arange(len(n))
        if len(models.names):
            best = h.argmin(axis=1)
            least = h[rows, best]
            other = np.partition(h, 1, axis=1)[:, 1] - least if len(models.names) > 1 else np.zeros(len(n))
            mean, deviation, rest = models.limits[best].T
            with np.errstate(invalid="ignore"):
                keep = (n > 0) & ~(least > mean + SPREAD * deviation / np.sqrt(np.maximum(n, 1)) + rest)
        else:
            best, least, other, keep = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), bool)
        none = n == 0
        best = np.where(none, len(models.names), best)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(np.round(least, 6), mask=none), pa.array(np.round(other, 6), mask=none), pa.array(n), pa.array(keep)],
            names=["doc_id", "language", "cross_entropy", "margin", "n_grams", "keep"],
        )
    tidy()


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """One row for each document: the language of the lowest cross-entropy (bits a character), how much the next one is above it, the grams scored, and whether it isn't rejected.

    A text without letters, null and empty ones too, has no language and isn't kept; of equal languages the first by name counts; a
    null doc_id is carried through; repeated rows give repeated results; other columns are not read. Texts of any length are scored
    whole. Without models nothing has a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return docs.select("doc_id", "text").mapInArrow(lambda b: _identified(b, shared), SCHEMA)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
