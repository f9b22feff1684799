"""SentencePiece encoding and decoding as the shortest path of a weighted finite-state transducer."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import raw_bytes, slices, span_hashes, table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The space that pieces have.
MARK = "▁"
#: Segments whose encoding, and pairs of pieces whose fit, a Python worker keeps.
MOST_KEPT = 100_000

SCHEMA = "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean"


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        shift += 7
        if c < 128:
            return x, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = (_varint(b, i)) if kind == 2 else (8 if kind == 1 else 4, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Transducer:
    """The normaliser, the pieces and the byte fallback of a model, compiled to arcs.

    A state of the composition with an input is a position and the piece that ends there. An arc reads one piece's characters and
    writes its id; it weighs one, or infinity (no arc) if the model's merges would never leave these two pieces side by side (which depends
    on the two alone). So the path of least weight is the one that the merges give. A character that no piece has is read by an arc
    that writes the ids of its bytes.
    """

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            model = f.read()
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: list[int] = [-1] * 256
        self.written: list[bytes] = []
        self.unknown = 0
        self.dummy_prefix, self.squeeze, self.escape, charsmap, kind = True, True, True, b"", 1
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                text, form, n = own.get(1, b"").decode(), own.get(3, 1), len(self.written)
                if form == 6:
                    self.bytes[int(text[3:5], 16)] = n
                    self.written.append(bytes([int(text[3:5], 16)]))
                elif form in (1, 4):
                    self.id[text], self.score[text] = n, struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0]
                    self.written.append(text.replace(MARK, " ").encode())
                else:
                    self.unknown = n if form == 2 else self.unknown
                    self.written.append(" ⁇ ".encode() if form == 2 else b"")
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                own = dict(_fields(value))
                charsmap, self.dummy_prefix, self.squeeze, self.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if kind != 2 or charsmap or self.squeeze or not self.escape or -1 in self.bytes:
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a space inside")
        #: The pieces that the merges can leave, by their characters; "" marks a piece's end.
        self.trie: dict = {}
        #: For each two bytes, whether a piece has them side by side, in one character or in two. No merge goes over others.
        self.inside = np.zeros((256, 256), bool)
        for p in self.id:
            if len(p) == 1 or self.merge(p) == [p]:
                node = self.trie
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = {}
            b = p.replace(MARK, " ").encode()
            for x, y in zip(b, b[1:]):
                self.inside[x, y] = True
        self.inside[:, 0x80:0xC0] = True
        self.inside[0x81, 32] = self.inside[32, 0xE2] = self.inside[0x81, 0xE2] = True  # U+2581 reads as a space
        self.inside[0x81] |= self.inside[32]
        self.kept: dict[bytes, bytes] = {}
        self._fits: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces by the model's merges: the best-scored pair first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether two pieces can stand side by side in what the merges give."""
        return self.merge(a + b) == [a, b]

    def path(self, text: str) -> list[str]:
        """The shortest path: arcs are tried from the longest on. What the merges give for a beginning of the text has one last piece, so that one state lives at each position, and a position from which there is no way on is dead for all."""
        n = len(text)
        known, root = self._fits, self.trie
        out: list[str] = []
        dead: set[int] = set()
        arcs: list[list[int]] = []
        at, before = 0, ""
        while at < n:
            if len(arcs) == len(out):  # a new state
                node, k, ends = root.get(text[at]), at + 1, [at + 1]
                while node is not None and k < n:
                    node = node.get(text[k])
                    k += 1
                    if node is not None and "" in node:
                        ends.append(k)
                arcs.append(ends)
            ends = arcs[-1]
            while ends:
                end = ends.pop()
                if end in dead:
                    continue
                piece = text[at:end]
                if before:
                    key = before + "\n" + piece
                    ok = known.get(key)
                    if ok is None:
                        if len(known) >= MOST_KEPT:
                            known.clear()
                        ok = known[key] = self.fits(before, piece)
                    if not ok:
                        continue
                out.append(piece)
                at, before = end, piece
                break
            else:
                if not out:
                    return self.merge(text)
                dead.add(at)
                arcs.pop()
                at -= len(out.pop())
                before = out[-1] if out else ""
        return out

    def segment(self, data: bytes) -> bytes:
        """The ids of a segment, which no merge goes into or out of."""
        found = self.kept.get(data)
        if found is None:
            text = data.decode().replace(" ", MARK)
            # A run of spaces has equal scores for all its lengths, so that only the merges' own order tells.
            parts = self.merge_long(text) if text.startswith(MARK * 2) else self.path(text)
            ids: list[int] = []
            for p in parts:
                k = self.id.get(p)
                ids += [k] if k is not None else [self.bytes[c] for c in p.encode()]
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            found = self.kept[data] = array("i", ids).tobytes()
        return found

    def merge_long(self, text: str) -> list[str]:
        """As merge, by a heap of pairs."""
        import heapq

        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(parts)
            if j < len(parts) and (s := self.score.get(whole := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, whole))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        return encode_all(self, pa.array([text]))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        data = b"".join(self.written[k] for k in ids).decode("utf-8", "replace")
        return data[1:] if self.dummy_prefix and data.startswith(" ") else data


@lru_cache(maxsize=2)
def transducer(path: str = MODEL) -> Transducer:
    return Transducer(path)


def _take(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of flat behind one another."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])]


def encode_all(t: Transducer, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts behind one another, the offsets of the texts in them, and the normalised bytes with their offsets. Null and empty texts have no ids."""
    column = pc.fill_null(column, "")
    if t.dummy_prefix:
        column = pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise("", column, " "))
    raw, offsets = raw_bytes(column)
    head = np.zeros(len(raw) + 1, bool)
    head[offsets] = True
    if len(raw):
        head[1:-1] |= ~t.inside[raw[:-1], raw[1:]]
    bounds = np.flatnonzero(head)
    starts, ends = bounds[:-1], bounds[1:]
    h = span_hashes(raw, starts, ends)
    distinct, index, which = np.unique(h, return_index=True, return_inverse=True)
    data = raw.tobytes()
    known = [t.segment(data[a:b]) for a, b in zip(starts[index].tolist(), ends[index].tolist())]
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    flat = np.frombuffer(b"".join(known), np.int32)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    ids = _take(flat, base[which], sizes[which]) if len(which) else np.empty(0, np.int32)
    total = np.concatenate([[0], np.cumsum(sizes[which])]) if len(which) else np.zeros(1, np.int64)
    return ids, total[np.searchsorted(starts, offsets)] if len(starts) else np.zeros(len(offsets), np.int64), raw, offsets


def decode_all(t: Transducer, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the ids of all texts write, dummy prefixes too, and the offsets of the texts in them."""
    sizes = np.fromiter(map(len, t.written), np.int64, len(t.written))
    flat = np.frombuffer(b"".join(t.written), np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    own = sizes[ids]
    return _take(flat, base[ids], own), np.concatenate([[0], np.cumsum(own)])[offsets]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for batch in slices(batches):
        ids, at, raw, offsets = encode_all(t, batch.column("text"))
        back, back_at = decode_all(t, ids, at)
        same = np.diff(back_at) == np.diff(offsets)
        if same.all():
            wrong = np.flatnonzero(raw != back)
            same[np.searchsorted(offsets, wrong, side="right") - 1] = False
        else:
            for k in range(batch.num_rows):
                same[k] = np.array_equal(raw[offsets[k] : offsets[k + 1]], back[back_at[k] : back_at[k + 1]])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pc.is_null(batch.column("text")))
        n = pa.array(np.diff(at), mask=np.asarray(pc.is_null(batch.column("text"))))
        ok = pa.array(same, mask=np.asarray(pc.is_null(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, n, ok], names=["doc_id", "ids", "n_tokens", "round_trip"])
    tidy()


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for batch in batches:
        text = [None if x is None else t.decode(x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row for each document: doc_id, its ids, their number, and whether decoding them gives the normalised text again.

    An empty text has no ids; a null text has null ids, number and round_trip; a null doc_id is carried through; repeated rows give
    repeated results; other columns are not read. A text that holds U+2581 itself decodes to a space there (round_trip is false).
    Texts of any length are encoded whole.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda b: _encoded(b, model), SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text that the ids stand for; null ids give a null text, no ids an empty one. Bytes that are no UTF-8 become U+FFFD."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, model), "doc_id bigint, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
