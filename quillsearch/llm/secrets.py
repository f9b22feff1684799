"""Secret scan by token efficiency: random strings need many tokens for their length."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import char_offsets, raw_bytes, slices, table, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A candidate is a run of at least so many of these characters.
MIN_LENGTH = 16
#: A candidate with fewer characters a token than this is a secret.
MAX_RATIO = 2.4
#: A run of letters with so many characters a token is a word.
WORD_RATIO = 3.0
#: Distinct characters at least; a run of one repeated sign is no secret.
MIN_DISTINCT = 8

SCHEMA = "doc_id bigint, start bigint, end bigint, secret string, n_tokens int, chars_per_token double"

_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z", re.I)
_SRI = re.compile(r"sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+=*\Z")
_NUMBER = re.compile(r"[0-9+/=_-]+\Z")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A digest that follows such a name is a credential all the same.
_NAMED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s*[:=]\s*[\"']?\Z", re.I)


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _candidate_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-"]] = True
    return t


def excluded(run: str, before: str, encoding) -> bool:
    """Whether a run is a known digest or an identifier: a bare digest or UUID (unless the text before it names a credential), a number, a path or name made of what the vocabulary knows as words."""
    if (_DIGEST.match(run) or _UUID.match(run)) and not _NAMED.search(before):
        return True
    if _SRI.match(run) or _NUMBER.match(run):
        return True
    if len(set(run)) < MIN_DISTINCT:
        return True
    parts = [p for p in _PARTS.findall(run) if len(p) >= 4 and not p.isdigit()]
    return sum(len(p) for p in parts if len(p) >= WORD_RATIO * len(encoding.encode_ordinary(p))) >= 0.6 * len(run)


def trimmed(run: str) -> tuple[int, int]:
    """Where the value lies in a run: behind a name and '=' (as in password=...), without signs at the ends but base64's padding."""
    lo, hi = 0, len(run)
    if m := re.match(r"[A-Za-z][A-Za-z_-]{0,40}=+(?=[^=])", run):
        lo = m.end()
    while lo < hi and run[lo] in "=_-+/":
        lo += 1
    while hi > lo and run[hi - 1] in "_-+/":
        hi -= 1
    return lo, hi


def find(text: str, start: int, end: int, encoding, max_ratio: float = MAX_RATIO) -> tuple[int, int, int, float] | None:
    """The secret in the run text[start:end], as (start, end, tokens, characters a token), or None."""
    lo, hi = trimmed(text[start:end])
    value = text[start + lo : start + hi]
    if len(value) < MIN_LENGTH or excluded(value, text[max(0, start + lo - 40) : start + lo], encoding):
        return None
    n = len(encoding.encode_ordinary(value))
    ratio = len(value) / n
    return (start + lo, start + hi, n, ratio) if ratio < max_ratio else None


def _scan(batches: Iterator[pa.RecordBatch], path: str, max_ratio: float) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(path)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("n_tokens", pa.int32()), ("chars_per_token", pa.float64())])
    for batch in slices(batches):
        raw, offsets = raw_bytes(batch.column("text"))
        if not len(raw):
            continue
        inside = np.concatenate([[False], _candidate_bytes()[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[0::2], edge[1::2]
        long = ends - starts >= MIN_LENGTH
        ids = batch.column("doc_id")
        rows: list[tuple] = []
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            first, last = int(np.searchsorted(offsets, s, side="right")) - 1, int(np.searchsorted(offsets, e - 1, side="right")) - 1
            for doc in range(first, last + 1):  # a run can go over the ends of texts
                a, b = max(s, int(offsets[doc])), min(e, int(offsets[doc + 1]))
                if b - a < MIN_LENGTH:
                    continue
                base = max(int(offsets[doc]), a - 64)
                while base > offsets[doc] and (raw[base] & 0xC0) == 0x80:
                    base -= 1
                near = raw[base:b].tobytes().decode("utf-8")
                lo = len(near) - (b - a)  # the run itself is ASCII
                if hit := find(near, lo, len(near), encoding, max_ratio):
                    at = int(char_offsets(raw, int(offsets[doc]), np.array([a]))[0]) - lo
                    rows.append((ids[doc].as_py(), at + hit[0], at + hit[1], near[hit[0] : hit[1]], hit[2], hit[3]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
    tidy()


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """Every secret of every text, one row each: doc_id, start and end in characters, the string, its tokens, characters a token.

    A candidate is a run of MIN_LENGTH or more ASCII letters, digits and ``+/=_-``. Known digests (hexadecimal of the usual
    lengths, UUIDs, ``sha256-`` strings), numbers and names made of words are left out, but for a digest that is assigned to a
    password, token, secret or key. What is left is a secret if the vocabulary gives it fewer than `max_ratio` characters a token.
    Null and empty texts have none; a null doc_id is carried through; repeated rows give repeated results; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda b: _scan(b, vocabulary, max_ratio), SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
