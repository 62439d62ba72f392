"""Benchmark decontamination by spaced seeds.

Fixed masks over token positions ignore some positions. The masked tokens of
every benchmark item and every document are hashed and joined; around each hit
the tokens are compared position by position, so that passages with some
substituted words are found as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType

from otflow.llm.common import WordHash, folded_words, materialize, mix64, slices, utf8

#: Tokens of a window that is compared, and the share of them that must be equal.
WINDOW = 13
SIMILARITY = 0.8
#: Tokens over which the hits of one segment spread at most, so that an alignment never costs more than that.
SPAN = 256
#: Bits of the seed filter, whose size doesn't depend on the benchmark's.
FILTER_BITS = 24


def window_of(tokens: int) -> int:
    """Tokens compared for an item of so many: 13, or all of a shorter one."""
    return min(tokens, WINDOW)


def mismatches(window: int) -> int:
    """Substituted tokens that a window may hold; windows of under five tokens must be equal."""
    return int(window * (1 - SIMILARITY) + 1e-9)


@cache
def masks(window: int) -> tuple[tuple[int, ...], ...]:
    """Masks (positions that count) for windows of the given number of tokens.

    Lossless: whichever positions of a window are substituted, as many as it
    may hold, some mask at some place misses them all. Found greedily among
    all masks of one weight.
    """
    if window < 5:
        return (tuple(range(window)),)
    base, weight = (13, 5) if window >= 13 else (10, 4) if window >= 10 else (5, 4)
    patterns = [frozenset(p) for p in combinations(range(base), mismatches(base))]
    choices = {}
    for rest in combinations(range(1, base), weight - 1):
        mask = (0, *rest)
        places = [frozenset(p + at for p in mask) for at in range(base - mask[-1])]
        choices[mask] = {k for k, p in enumerate(patterns) if any(not p & place for place in places)}
    left, chosen = set(range(len(patterns))), []
    while left:
        best = max(choices, key=lambda m: (len(choices[m] & left), [-p for p in m]))
        chosen.append(best)
        left -= choices[best]
    return tuple(sorted(chosen))


def seeds(tokens: np.ndarray, owner: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a mask lies within one owner's tokens, and the seeds there."""
    span = mask[-1]
    n = len(tokens) - span
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[:n] == owner[span:])
    out = np.full(len(at), hash(mask) & 0xFFFFFFFF, np.uint64)
    for p in mask:
        out = (out + tokens[at + p]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return at, mix64(out)


def _tokens(texts: list[bytes], words: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    split = [folded_words(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    return words.of([w for ws in split for w in ws]), np.repeat(np.arange(len(split)), sizes), sizes


def item_seeds(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, tokens) and their seeds (seed, item_id, place); items without words have none."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            tokens = [words.of(folded_words(t)).view(np.int64) for t in utf8(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(tokens, pa.list_(pa.int64()))], names=["item_id", "tokens"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids, places = [], [], []
            for item, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = found.values.to_numpy().view(np.uint64)
                for mask in masks(window_of(len(tokens))):
                    at, own = seeds(tokens, np.zeros(len(tokens), np.int8), mask)
                    out.append(own.view(np.int64))
                    ids += [item] * len(at)
                    places.append(at.astype(np.int32))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(out)), pa.array(ids, pa.int64()), pa.array(np.concatenate(places))], names=["seed", "item_id", "place"])

    source = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as binary) text").where("item_id is not null")
    items = source.mapInArrow(tokenise, "item_id long, tokens array<long>").where("size(tokens) > 0")
    items = materialize(items, "items")
    return items, materialize(items.mapInArrow(seed, "seed long, item_id long, place int"), "item-seeds")


def _filter(found: DataFrame) -> np.ndarray:
    """A Bloom filter with two functions over all seeds; at most 2**24 positions reach the driver."""
    low = (1 << FILTER_BITS) - 1
    positions = F.explode(F.array(F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", 40).bitwiseAND(low)))
    at = found.select(positions.alias("at")).select(F.col("at").cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    table = np.zeros(1 << FILTER_BITS, bool)
    table[at] = True
    return table


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, matched, window, position.

    A document leaks an item where, at some alignment without gaps, at least
    80 % of a window of 13 words (of all words of a shorter item; all of them
    below five) are equal without regard to ASCII case and punctuation.
    matched: equal words of the best window; position: the word of the document
    where that begins, the first of several. Null and empty texts leak nothing;
    rows without an id are not judged; repeated rows give the same rows once.
    """
    source = docs.selectExpr("cast(doc_id as long) id", "cast(text as binary) text").where("id is not null")
    return _leaks(source, benchmark).withColumnRenamed("id", "doc_id")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """leaks of docs with an id of any type and a text; without an id a text is known by its SHA-256, in binary."""
    named = "id" in docs.columns
    kind = docs.schema["id"].dataType if named else BinaryType()
    items, found = item_seeds(benchmark)
    sizes = [r["n"] for r in items.select(F.least(F.size("tokens"), F.lit(WINDOW)).alias("n")).distinct().collect()]
    used = sorted({m for n in sizes for m in masks(n)})
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(_filter(found)))
    arrow = to_arrow_type(kind)
    low, margin = np.uint64((1 << FILTER_BITS) - 1), WINDOW - 1

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = WordHash(), np.unpackbits(shared.value).view(bool)
        for batch in slices(batches, 500):
            texts = utf8(batch.column("text"))
            tokens, owner, sizes = _tokens(texts, words)
            places, values = [], []
            for mask in used:
                at, own = seeds(tokens, owner, mask)
                maybe = np.flatnonzero(table[own & low])
                maybe = maybe[table[own[maybe] >> np.uint64(40)]]
                places.append(at[maybe])
                values.append(own[maybe])
            place = np.concatenate(places or [np.zeros(0, np.int64)])
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, value = place[order], np.concatenate(values)[order]
            first = np.cumsum(sizes) - sizes
            ids = batch.column("id").to_pylist() if named else None
            # Hits whose surroundings overlap share a segment, as far as SPAN; every window has all its tokens in each of its hits' segments.
            new = np.append(True, (np.diff(place) > 3 * WINDOW) | (owner[place[1:]] != owner[place[:-1]]))
            piece = (place - place[new][np.cumsum(new) - 1]) // SPAN
            new[1:] |= piece[1:] != piece[:-1]
            cuts = np.append(np.flatnonzero(new), len(place)).tolist()
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                doc = owner[place[a]]
                begin = max(first[doc], place[a] - margin)
                end = min(first[doc] + sizes[doc], place[b - 1] + WINDOW + margin)
                name = ids[doc] if named else hashlib.sha256(texts[doc]).digest()
                rows.append((name, int(begin - first[doc]), tokens[begin:end].view(np.int64), value[a:b].view(np.int64), (place[a:b] - begin).astype(np.int32)))
            names, types = ["id", "begin", "tokens", "seeds", "places"], (arrow, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    segments = docs.mapInArrow(segment, f"id {kind.simpleString()}, begin int, tokens array<long>, seeds array<long>, places array<int>")
    segments = materialize(segments, "segments")
    hits = segments.select("id", "begin", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select("id", "begin", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("at"))
    aligned = hits.join(found, "seed").select("id", "begin", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = aligned.join(segments.select("id", "begin", F.col("tokens").alias("text")), ["id", "begin"]).join(items, "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, begin, shift, text, tokens in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), batch.column(5)):
                best = best_window(text.values.to_numpy(), tokens.values.to_numpy(), shift)
                if best:
                    out.append((doc, item, best[0], best[1], begin + best[2]))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (arrow, pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["id", "item_id", "matched", "window", "position"])

    checked = pairs.select("id", "item_id", "begin", "shift", "text", "tokens").mapInArrow(verify, f"id {kind.simpleString()}, item_id long, matched int, window int, position int")
    best = F.max(F.struct("matched", "window", (-F.col("position")).alias("back"))).alias("best")
    return checked.groupBy("id", "item_id").agg(best).select("id", "item_id", "best.matched", "best.window", (-F.col("best.back")).alias("position"))


def best_window(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(equal tokens, window, place in text) of the best window of an alignment, or None where none is similar enough."""
    window = window_of(len(item))
    begin, end = max(0, shift), min(len(text), shift + len(item))
    if end - begin < window:
        return None
    sums = np.append(0, np.cumsum(text[begin:end] == item[begin - shift : end - shift]))
    equal = sums[window:] - sums[:-window]
    at = int(np.argmax(equal))
    if equal[at] < window - mismatches(window):
        return None
    return int(equal[at]), window, begin + at


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text leaks no item, all columns as they were.

    Texts decide, told by their SHA-256: rows with one text all go or stay,
    whatever their doc_ids are, null and repeated ones included. Null and empty
    texts stay.
    """
    bad = _leaks(docs.select(F.col("text").cast("binary").alias("text")), benchmark).select(F.col("id").alias("_leaking")).distinct()
    return docs.join(bad.hint("merge"), F.unhex(F.sha2(docs["text"].cast("binary"), 256)) == bad["_leaking"], "left_anti")
