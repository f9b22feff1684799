"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy
from .folding import codes, homoglyphs, string

#: Whole words and their weights, whatever the labels say.
LEXICON = {
    "idiot": 1.0, "idiots": 1.0, "moron": 1.0, "morons": 1.0, "imbecile": 1.0, "stupid": 0.8, "dumbass": 1.2, "trash": 0.7, "scum": 1.0, "scumbag": 1.2,
    "loser": 0.8, "losers": 0.8, "clown": 0.6, "clowns": 0.6, "pathetic": 0.7, "worthless": 0.8, "disgusting": 0.7, "vermin": 0.8, "retard": 1.2,
    "retarded": 1.2, "asshole": 1.3, "bastard": 1.0, "bitch": 1.2, "fuck": 1.2, "fucking": 1.2, "fucker": 1.3, "shit": 0.9, "shithead": 1.3, "cunt": 1.3,
    "whore": 1.2, "slut": 1.2, "dickhead": 1.3, "jackass": 1.0, "degenerate": 0.7, "filth": 0.6, "braindead": 0.9, "halfwit": 0.9, "dimwit": 0.9,
}
#: A lexicon match inside one of these doesn't count.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "take out the trash", "class clown", "clown fish", "clown car", "circus clown",
    "pathetic fallacy", "the idiot by dostoevsky", "idiot proof", "idiot light", "sore loser", "stupid question", "worthless check", "fire retard", "pond scum", "soap scum",
)
#: The sample of labelled documents that weights and threshold are fitted on holds at most so many toxic and so many other ones.
FIT_TOXIC, FIT_CLEAN = 2000, 4000
#: A learned entry is a word or a word's beginning, of so many characters, in so large a part of the toxic sample, so many times as frequent there.
STEM, SUPPORT, RATIO = (4, 12), 0.01, 20.0
#: Without labels, the score from which a text is toxic.
DEFAULT_THRESHOLD = 0.02

SCHEMA = "doc_id bigint, score double, n_hits bigint, n_words bigint, toxic boolean"


@cache
def folds() -> np.ndarray:
    """Homoglyphs, then digits and signs read as letters, l read as i (both are written 1), lower case; all that is no letter is a space."""
    t = homoglyphs().copy()
    ascii_part = np.arange(128, dtype=np.uint32)
    for a, b in zip("0134578@$!|", "oieastbasii"):
        ascii_part[ord(a)] = ord(b)
    for c in range(65, 91):
        ascii_part[c] = c + 32
    for c in (ord("l"), ord("L")):
        ascii_part[c] = ord("i")
    for c in range(128):
        if not chr(int(ascii_part[c])).isalpha():
            ascii_part[c] = 32
    low = t < 128
    t[low] = ascii_part[t[low]]
    for c in range(128, 0x3000):
        if t[c] == c:
            s = chr(c).lower()
            t[c] = ord(s) if len(s) == 1 and (s.isalpha() or 0x300 <= c < 0x370) else (c if 0x300 <= c < 0x370 else 32)
    return t


def fold(points: np.ndarray) -> np.ndarray:
    """An exclamation mark is a letter only before another letter."""
    out = folds()[points]
    mark = np.flatnonzero(points == 33)
    after = np.append(points, 32)[mark + 1]
    out[mark[(after == 33) | (folds()[after] == 32)]] = 32
    return out


def folded(text: str) -> str:
    return string(fold(codes(text)))


@dataclass(frozen=True)
class Lexicon:
    """entries: (folded pattern that begins, and for a whole word ends, with a space; weight). exceptions: folded phrases."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    threshold: float


def base(threshold: float = DEFAULT_THRESHOLD) -> Lexicon:
    return Lexicon(tuple(sorted({f" {folded(w)} ": x for w, x in LEXICON.items()}.items())), tuple(sorted({f" {folded(w)} " for w in EXCEPTIONS})), threshold)


@cache
def automaton(lexicon: Lexicon):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in lexicon.exceptions:
        a.add_word(w, (len(w), -1.0))
    for w, x in lexicon.entries:
        a.add_word(w, (len(w), x))
    a.make_automaton()
    return a


def measure(texts: list[str], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of weights, number of matches, number of words, of each text."""
    flat = codes(" " + "  ".join(texts) + " ")
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begin = np.concatenate([[1], 1 + np.cumsum(sizes + 2)])[:-1] if len(texts) else np.empty(0, np.int64)
    points = fold(flat)
    letter = points != 32
    heads = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    n_words = np.bincount(np.searchsorted(begin, heads, side="right") - 1, minlength=len(texts)) if len(heads) else np.zeros(len(texts), np.int64)
    total, hits = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    spared: list[tuple[int, int]] = []
    found: list[tuple[int, int, float]] = []
    for end, (n, x) in automaton(lexicon).iter(string(points)):
        if x < 0:
            spared.append((end - n + 1, end))
        else:
            found.append((end - n + 2, end, x))
    spared.sort()
    spared_from = [a for a, _ in spared]
    spared_to = list(accumulate((b for _, b in spared), max))  # of all that begin before, the last end
    edge = (begin + sizes).tolist()
    best: dict[int, tuple[int, float]] = {}
    for s, e, x in found:  # of entries that begin with the same word, the heaviest counts
        doc = int(np.searchsorted(begin, s, side="right")) - 1
        if e <= edge[doc] + 1 and (s not in best or x > best[s][1]):
            k = bisect_left(spared_from, s) - 1
            if k < 0 or spared_to[k] < e:
                best[s] = (doc, x)
    for doc, x in best.values():
        total[doc] += x
        hits[doc] += 1
    return total, hits, n_words


def scores(total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Weight by the square root of the length: a long text with a few matches scores less than a short one, but isn't let off for its length alone."""
    return total / np.sqrt(np.maximum(n_words, 1)) / 4


def learn(texts: list[str], toxic: list[bool]) -> Lexicon:
    """The base lexicon, and words and word beginnings learned from labelled texts, with a threshold that parts these best; a clean text lost counts as five toxic ones kept."""
    n_t, n_c = sum(toxic), len(toxic) - sum(toxic)
    plain = base()
    if not n_t or not n_c:
        return plain
    lo, hi = STEM
    least = max(5, SUPPORT * n_t)

    def patterns(text: str) -> set[str]:
        own: set[str] = set()
        for w in set(folded(text).split()):
            if len(w) >= lo:
                own.add(f" {w} ")
                own.update(f" {w[:k]}" for k in range(lo, min(hi, len(w)) + 1))
        return own

    often: Counter[str] = Counter()
    for text, bad in zip(texts, toxic):
        if bad:
            often.update(patterns(text))
    often = Counter({p: n for p, n in often.items() if n >= least})
    in_toxic: dict[str, list[int]] = defaultdict(list)
    in_clean: Counter[str] = Counter()
    for i, (text, bad) in enumerate(zip(texts, toxic)):
        own = patterns(text) & often.keys()  # of what is rare in toxic texts, nothing is kept
        if bad:
            for p in own:
                in_toxic[p].append(i)
        else:
            in_clean.update(own)
    found = []
    for p, docs in in_toxic.items():
        if len(docs) >= least:
            odds = math.log((len(docs) + 0.5) / (n_t + 1)) - math.log((in_clean[p] + 0.5) / (n_c + 1))
            if odds >= math.log(RATIO):
                found.append((len(docs) * odds, len(p), p, odds))
    found.sort(reverse=True)
    covered: Counter[int] = Counter()
    chosen: dict[str, float] = dict(plain.entries)
    for _, _, p, odds in found:
        new = sum(1 for i in in_toxic[p] if not covered[i])
        if p in chosen or new >= max(3, 0.004 * n_t):
            chosen[p] = round(min(1.5, odds / 5), 3)
            covered.update(in_toxic[p])
    lexicon = Lexicon(tuple(sorted(chosen.items())), plain.exceptions, 0.0)
    total, _, n_words = measure(texts, lexicon)
    s, bad = scores(total, n_words), np.array(toxic)
    cuts = np.unique(s[s > 0])
    if not len(cuts):
        return plain
    gain = [(bad & (s >= c)).sum() / n_t - 5 * (~bad & (s >= c)).sum() / n_c for c in cuts]
    k = int(np.argmax(gain))
    below = cuts[k - 1] if k else 0.0
    return Lexicon(lexicon.entries, lexicon.exceptions, float(0.5 * (below + cuts[k])))


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Fitted on at most FIT_TOXIC and FIT_CLEAN labelled documents, taken in the order of a hash of doc_id. Labels that are null, or whose document isn't there, are left out. Of several texts of one doc_id the smallest counts; of several labels the larger."""
    ids = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = ids.where("toxic = 1").orderBy(*order).limit(FIT_TOXIC).union(ids.where("toxic = 0").orderBy(*order).limit(FIT_CLEAN))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toArrow()  # at most FIT_TOXIC + FIT_CLEAN ids are broadcast
    order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
    rows = rows.take(order)
    return learn(rows["text"].to_pylist(), [x == 1 for x in rows["toxic"].to_pylist()])


def _columns(batch: pa.RecordBatch, lexicon: Lexicon) -> tuple[np.ndarray, ...]:
    total, hits, n_words = measure(pc.fill_null(batch.column("text"), "").to_pylist(), lexicon)
    s = np.round(scores(total, n_words), 9)
    return s, hits, n_words, (hits > 0) & (s >= lexicon.threshold)


def _score(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, _columns(batch, lexicon))], names=["doc_id", "score", "n_hits", "n_words", "toxic"])
    tidy()


def _keep(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield batch.filter(pa.array(~_columns(batch, lexicon)[3]))
    tidy()


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row for each document: doc_id, score, matches, words, and whether it is toxic.

    Null and empty texts score 0 and aren't toxic; a null doc_id is carried through; repeated rows give repeated results; other
    columns are not read. Texts of any length are scanned whole. Where entries begin at the same place the heaviest counts.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda b: _score(b, lexicon), SCHEMA)


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents that aren't toxic, all columns as they were; null and empty texts stay."""
    return docs.mapInArrow(lambda b: _keep(b, lexicon), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
