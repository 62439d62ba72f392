"""Byte-level BPE: vectorised pre-tokenisation, cached merges, decoding.

Texts are cut where the pattern of the public rank files cuts them
(contractions, words, numbers, other runs, white space), without a regex: a
table gives each code point a class, and a finite transducer over the classes
tells where a piece begins. The transducer's state before each character comes
from an associative scan: transition functions are composed within blocks, the
blocks' functions are chained, and all blocks then advance together.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from otflow.llm.common import slices, utf8

# Classes of code points. The letters of the contractions 's 't 're 've 'm 'll 'd.
END, SPACE, WHITE, NUMBER, OTHER, QUOTE, LETTER, STMD, R, V, E, L = range(12)
LETTERS = (LETTER, STMD, R, V, E, L)
N_CLASSES = 12

# States: what the piece that holds the last character is.
START, IN_SPACE, IN_WHITE, IN_LETTERS, IN_NUMBER, IN_OTHER, AFTER_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(11)
N_STATES = 11

BLOCK = 64
#: Code points that are scanned at once.
CHUNK = 1 << 18
#: Bytes of a text beyond which it is encoded part by part.
LONG = 1 << 20
#: Bytes of a piece up to which merging needs no heap.
SHORT = 48


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for at in range(0x110000):
        kind = unicodedata.category(chr(at))
        if kind[0] == "L":
            out[at] = LETTER
        elif kind[0] == "N":
            out[at] = NUMBER
        elif kind[0] == "Z":
            out[at] = WHITE
    # White space that is in no separator category: \t \n \v \f \r and next line.
    out[[9, 10, 11, 12, 13, 0x85]] = WHITE
    out[32] = SPACE
    out[ord("'")] = QUOTE
    out[[ord(c) for c in "stmd"]] = STMD
    out[ord("r")], out[ord("v")], out[ord("e")], out[ord("l")] = R, V, E, L
    return out


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """next_state[class, state] and begins[state, class, following class]."""
    step = np.zeros((N_CLASSES, N_STATES), np.uint8)
    begins = np.zeros((N_STATES, N_CLASSES, N_CLASSES), bool)
    for state in range(N_STATES):
        step[SPACE, state], step[WHITE, state] = IN_SPACE, IN_WHITE
        step[NUMBER, state], step[END, state] = IN_NUMBER, START
        step[OTHER, state] = IN_OTHER
        # A quote opens a contraction only where it begins a piece.
        step[QUOTE, state] = IN_OTHER if state in (IN_SPACE, IN_OTHER, AFTER_QUOTE) else AFTER_QUOTE
        for c in LETTERS:
            step[c, state] = IN_LETTERS
    step[STMD, AFTER_QUOTE] = CONTRACTED
    step[R, AFTER_QUOTE], step[V, AFTER_QUOTE], step[L, AFTER_QUOTE] = QUOTE_R, QUOTE_V, QUOTE_L
    step[E, QUOTE_R] = step[E, QUOTE_V] = step[L, QUOTE_L] = CONTRACTED

    for state in range(N_STATES):
        for c in range(N_CLASSES):
            for then in range(N_CLASSES):
                if c in (SPACE, WHITE):
                    # In a run of white space only the last one before other text begins anew.
                    new = state not in (IN_SPACE, IN_WHITE) or then not in (SPACE, WHITE, END)
                elif state == IN_SPACE:
                    new = False
                elif c == NUMBER:
                    new = state != IN_NUMBER
                elif c in (OTHER, QUOTE):
                    new = state not in (IN_OTHER, AFTER_QUOTE)
                elif c in LETTERS:
                    pair = (c in (R, V) and then == E) or (c == L and then == L)
                    if state == AFTER_QUOTE:
                        new = not (c == STMD or pair)
                    else:
                        new = state not in (IN_LETTERS, QUOTE_R, QUOTE_V, QUOTE_L)
                else:
                    new = True
                begins[state, c, then] = new
    return step, begins


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The transducer's state before each character, by a blocked associative scan."""
    step, _ = tables()
    n = len(kinds)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    # Each block's function from the state before it to the state after it.
    after = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (blocks, N_STATES)).copy()
    flat = step.ravel()
    for column in columns:
        after = flat[column[:, None].astype(np.uint16) * N_STATES + after]
    # Composition is associative: doubling gives the function of all blocks up to each.
    reach = 1
    while reach < blocks:
        after[reach:] = np.take_along_axis(after[reach:], after[:-reach], axis=1)
        reach *= 2
    state = np.concatenate([np.zeros(1, np.uint8), after[:-1, START]])
    out = np.empty((BLOCK, blocks), np.uint8)
    for k, column in enumerate(columns):
        out[k] = state
        state = flat[column.astype(np.uint16) * N_STATES + state]
    return out.T.ravel()[:n]


def piece_starts(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Joined bytes of the texts, byte offsets where pieces begin, and each text's first piece.

    The last entry of either array is the end.
    """
    joined = "\0".join([t.decode("utf-8", "replace") for t in texts] + [""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t.decode("utf-8", "replace")) for t in texts), np.int64, len(texts))
    kinds = classes()[points]
    ends = np.cumsum(lengths + 1) - 1
    kinds[ends] = END
    _, begins = tables()
    following = np.append(kinds[1:], END)
    starts = begins[states_before(kinds), kinds, following]
    starts[ends] = False
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[ends] = 0
    offset = np.cumsum(width) - width
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, np.append(0, ends + 1))
    data = "".join(t.decode("utf-8", "replace") for t in texts).encode("utf-8")
    return data, np.append(offset[at], len(data)), first


def parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about CHUNK bytes, cut where a piece surely begins: before white space after a visible character."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        end = len(data)
        for begin in range(at + CHUNK, len(data), CHUNK):
            before, own = data[begin - 1 : begin - 1 + CHUNK], data[begin : begin + CHUNK]
            white = (own == 32) | ((own >= 9) & (own <= 13))
            cuts = np.flatnonzero(white & (before[: len(own)] >= 33) & (before[: len(own)] <= 126))
            if len(cuts):
                end = begin + int(cuts[0])
                break
        yield text[at:end]
        at = end


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, cache: int = 150_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.vocabulary[rank] = piece
        # Two generations of at most so many pieces each; what is still used moves to the younger one.
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.bound = cache

    def merge(self, piece: bytes) -> list[int]:
        """Ranks of one piece: the adjacent pair of lowest rank is merged first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        if n <= SHORT:
            return self._merge_short(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = after[:]  # where the part that begins here ends; 0 once it is merged away
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not end[i] or (j := after[i]) >= n or ranks.get(piece[i : end[j]]) != rank:
                continue  # what this entry stood for has changed
            end[i], end[j] = end[j], 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h))
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def _merge_short(self, piece: bytes) -> list[int]:
        """The same by repeated search of the lowest rank, which is faster on short pieces."""
        get, none = self.ranks.get, len(self.vocabulary)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[x] for x in parts]

    def packed(self, piece: bytes) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers, from the cache where it has them."""
        found = self.cache.get(piece)
        if found is None:
            found = self.older.get(piece) or np.array(self.merge(piece), "<u4").tobytes()
            if len(piece) <= 64:
                self.cache[piece] = found
        return found

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as arrays of unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > LONG:
                out += self._encode(group) if group else []
                out.append(np.concatenate([self._encode([part])[0] for part in parts(text)]))
                group, size = [], 0
                continue
            if group and size + len(text) > CHUNK:
                out += self._encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        return out + self._encode(group) if group else out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        data, offsets, first = piece_starts(texts)
        offsets = offsets.tolist()
        if len(self.cache) > self.bound:
            self.cache, self.older = {}, self.cache
        cache, packed = self.cache, self.packed
        pieces = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        ids = [cache.get(p) or packed(p) for p in pieces]
        bounds = first.tolist()
        return [np.frombuffer(b"".join(ids[a:b]), "<u4") for a, b in zip(bounds[:-1], bounds[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id's piece begins in the decoded text."""
        width = self._widths()[ids]
        return np.cumsum(width) - width

    def _widths(self) -> np.ndarray:
        if not hasattr(self, "widths"):
            self.widths = np.array([len(x) for x in self.vocabulary], np.int64)
            self._starts = np.cumsum(self.widths) - self.widths
            self._bytes = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        return self.widths

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """The bytes of ids, each put at its offset."""
        if not len(ids):
            return b""
        widths = self._widths()[ids]
        offsets = self.offsets(ids) if offsets is None else offsets
        return self._bytes[np.arange(int(widths.sum())) + np.repeat(self._starts[ids] - offsets, widths)].tobytes()


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each rank file and Python worker."""
    return Codec(path)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and offsets (first byte of each id) of every whole text.

    ranks: path of a public rank file, readable on every executor. Null and
    empty texts have no ids. Null ids, repeated rows and further columns don't
    matter: each input row gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in slices(batches):
            ids = own.encode(utf8(batch.column(1)))
            column = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            offsets = pa.array([own.offsets(x) for x in ids], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), column, offsets], names=["doc_id", "ids", "offsets"])

    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as binary) text")
    return source.mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and text (binary) of rows with ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in slices(batches):
            texts = [own.decode(np.array(x or [], np.uint32)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encode, then decode the ids by their offsets, in one pass.

    Null and empty texts have no ids, whose digests are those of no bytes.
    Repeated rows give a row each, a null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in slices(batches):
            ids = own.encode(utf8(batch.column(1)))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(own.decode(x, own.offsets(x))).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as binary) text")
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
