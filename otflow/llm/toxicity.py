"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import WordHash, folded_words, give_back, materialize, mix64, slices, utf8

BITS = 20
#: Labelled texts that training reads at most; of more, those with the smallest hash of id and text.
MAX_TRAINING_ROWS = 6_000
#: Slots of all these texts together that reach the driver at most (4 bytes each); texts beyond are left out of training.
MAX_TRAINING_SLOTS = 30_000_000
THRESHOLD = 0.3
#: Bytes of a word's stem; compounding languages repeat stems rather than words.
STEM = 6


def features(text: bytes, words: WordHash, bits: int = BITS) -> np.ndarray:
    """Distinct slots of a text's words, their stems, pairs of neighbours and pairs with one word between."""
    split = folded_words(text)
    h = words.of(split)
    slots = [h, words.of([w[:STEM] + b"-" for w in split]), mix64(h[:-1] * np.uint64(3) + h[1:]), mix64(h[:-2] * np.uint64(5) + h[2:])]
    return np.unique(np.concatenate(slots) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Weights:
    """The sparse model: sorted slots, their weights, and the intercept."""

    slots: np.ndarray
    values: np.ndarray
    intercept: float
    bits: int = BITS

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.slots] = self.values
        return dense


def train_ftrl(
    rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 4
) -> Weights:
    """FTRL-proximal with a learning rate for each coordinate; L1 keeps most weights at exactly 0."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    z0 = n0 = 0.0
    for _ in range(epochs):
        for slots, label in rows:
            zs, ns = z[slots], n[slots]
            w = np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))
            w0 = -z0 / ((beta + np.sqrt(n0)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - label
            z[slots] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[slots] = ns + g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * w0
            n0 += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.flatnonzero(w)
    return Weights(kept, w[kept].astype(np.float32), float(-z0 / ((beta + np.sqrt(n0)) / alpha)), bits)


def fold(doc_id: int) -> int:
    """The fold 0..3 of a document; 2 is held out."""
    return zlib.crc32(str(doc_id).encode()) % 4


def fold_column(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4))


def _text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text).cast("binary"))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, text_key, toxic: at most max_rows labelled texts of docs outside the held-out fold.

    Labels of documents that are not in docs don't count, and rows that repeat
    id, text and label count once. A share of the hashes' range is taken first,
    so that only about as many rows are sorted as are wanted.
    """
    usable = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null").where(fold_column("doc_id") != 2)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"))
    found = materialize(texts.join(usable, "doc_id").distinct().withColumn("order", F.xxhash64("doc_id", "text_key")), "labelled")
    n = found.count()
    if n > 2 * max_rows:
        found = found.where(F.pmod("order", F.lit(1 << 30)) < int(2 * max_rows / n * (1 << 30)))
    return found.orderBy(F.pmod("order", F.lit(1 << 30)), "order", "doc_id", "toxic").limit(max_rows).drop("order")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_slots: int = MAX_TRAINING_SLOTS) -> Weights:
    """Train on the texts of training_sample, as far as max_slots goes.

    Only hashed features of that bounded sample reach the driver. Rows without
    an id or a label don't count; without any labels the model scores 0.5.
    """
    picked = training_sample(docs, labels, max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    joined = texts.join(F.broadcast(picked), ["doc_id", "text_key"]).select("doc_id", "text_key", "toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in slices(batches):
            slots = [features(t, words).astype(np.int32).tobytes() for t in utf8(batch.column(3))]
            yield pa.record_batch([*batch.columns[:3], pa.array(slots, pa.binary())], names=["doc_id", "text_key", "toxic", "slots"])

    found = joined.mapInArrow(run, "doc_id long, text_key long, toxic int, slots binary").groupBy("doc_id", "text_key", "toxic").agg(F.min("slots").alias("slots"))
    found = materialize(found.withColumn("n", F.octet_length("slots") / 4), "training-features")
    sizes = found.select("doc_id", "text_key", "toxic", "n").toArrow().to_pylist()
    order = sorted((zlib.crc32(f"order {r['doc_id']}".encode()), r["doc_id"], r["text_key"], r["toxic"], int(r["n"])) for r in sizes)
    last = int(np.searchsorted(np.cumsum([r[4] for r in order]), max_slots, "right"))
    kept = {r[1:4]: k for k, r in enumerate(order[:last])}
    if last < len(order):
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame(list(kept), "doc_id long, text_key long, toxic int")), ["doc_id", "text_key", "toxic"])
    rows = _rows(found, kept) if kept else []
    del sizes, order, kept
    weights = train_ftrl(rows)
    del rows
    give_back()
    return weights


def _rows(found: DataFrame, kept: dict) -> list[tuple[np.ndarray, int]]:
    """Slots and label of each row in the order of kept; the slots stay where Arrow holds them, 4 bytes each."""
    table = found.select("doc_id", "text_key", "toxic", "slots").toArrow()
    keys = list(zip(*(table[c].to_pylist() for c in ("doc_id", "text_key", "toxic"))))
    slots = [np.frombuffer(s.as_buffer(), np.int32) for s in table["slots"]]
    return [(slots[k], keys[k][2]) for k in sorted(range(len(keys)), key=lambda k: kept[keys[k]])]


def score_texts(texts: list[bytes], dense: np.ndarray, intercept: float, words: WordHash, bits: int = BITS) -> np.ndarray:
    """Probability of label 1 for each text."""
    split = [folded_words(t) for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = [w for ws in split for w in ws]
    h = words.of(flat)
    doc = np.repeat(np.arange(len(split)), sizes)
    shift = np.uint64(64 - bits)
    slots, owners = [h >> shift, words.of([w[:STEM] + b"-" for w in flat]) >> shift], [doc, doc]
    for gap, factor in ((1, 3), (2, 5)):
        own = doc[:-gap] == doc[gap:]
        slots.append(mix64(h[:-gap][own] * np.uint64(factor) + h[gap:][own]) >> shift)
        owners.append(doc[:-gap][own])
    at, of = np.concatenate(slots).astype(np.int64), np.concatenate(owners)
    hit = np.flatnonzero(dense[at])
    pairs = np.unique(np.stack([of[hit], at[hit]], 1), axis=0)
    total = np.bincount(pairs[:, 0], dense[pairs[:, 1]], len(texts)) + intercept
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is an input of the score. Null and empty texts get the
    model's intercept. held_out is null for a null doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value, WordHash()
        dense = model.table()
        for batch in slices(batches, 500):
            scores = score_texts(utf8(batch.column(1)), dense, model.intercept, words, model.bits)
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as binary) text")
    return source.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (fold_column("doc_id") == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose predicted toxicity is under the threshold, all columns as they were."""
    weights = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value, WordHash()
        dense = model.table()
        for batch in slices(batches, 500):
            scores = score_texts(utf8(batch.column(at)), dense, model.intercept, words, model.bits)
            yield batch.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
