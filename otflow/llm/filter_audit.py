"""Audit of a chain of filters: what each removes, repeats or loses, in every order.

Texts are routed by fingerprint: each partition keeps chains of the texts that
share one, compares whole texts, and gives on the ids that a smaller id already
has the text of. A document's failures are a mask of bits, and counts of masks
per part of the corpus answer every order.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import give_back, materialize

#: What each filter removes, by UTF-8 text, code points and words.
FILTERS: dict[str, Callable[[bytes, int, list[bytes]], bool]] = {
    "A": lambda raw, points, words: len(words) < 50,
    "B": lambda raw, points, words: 100 * len(set(words)) < 65 * len(words),
    "C": lambda raw, points, words: 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * points,
    "D": lambda raw, points, words: len(raw.translate(None, _MARKS)) < len(raw),
}
_UPPER, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: The filter that removes repeats of a smaller id's text.
REPEATS = "E"
#: Bytes of text that a task keeps before it gives its chains on, and documents that a partition takes on average, at most.
HELD_BYTES, DOCUMENTS_EACH = 1 << 26, 50_000

Filters = dict[str, Callable[[bytes, int, list[bytes]], bool]]


class Chains:
    """Texts by fingerprint, each with its smallest id so far and how many rows of that id every part has."""

    def __init__(self):
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def admit(self, fingerprint: int, raw: bytes, ident: int, bits: int | None, parts: dict[str, int], filters: Filters | None = None) -> tuple | None:
        """Take rows of a text in; returns (id, bits, parts) of rows that are now known to repeat a smaller id's text."""
        chain = self.chains.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] == raw:
                break
        else:
            chain.append([raw, ident, failures(raw, filters) if bits is None else bits, parts])
            self.bytes += len(raw) + 200
            return None
        if ident > entry[1]:
            return ident, entry[2], parts
        if ident == entry[1]:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return None
        beaten = entry[1], entry[2], entry[3]
        entry[1], entry[3] = ident, parts
        return beaten

    def drain(self) -> Iterator[tuple[int, list]]:
        for fingerprint, chain in self.chains.items():
            for entry in chain:
                yield fingerprint, entry
        self.chains, self.bytes = {}, 0


def failures(raw: bytes, filters: Filters) -> int:
    """Bits of the filters that remove a text, the first filter's lowest."""
    points, words = len(raw.decode("utf-8", "replace")), raw.split()
    return sum(1 << k for k, fails in enumerate(filters.values()) if fails(raw, points, words))


def masks(docs: DataFrame, filters: Filters = FILTERS) -> DataFrame:
    """doc_id, part, bits and n: n rows of that id, part and mask of failures; the last bit tells repeats.

    Filters come in the order of the dictionary, then the repeats. A row is a
    repeat if a smaller doc_id has the identical text; null texts are empty
    ones; a null doc_id is neither smaller nor larger than any.

    Each task keeps chains of what it has read, up to HELD_BYTES, so of rows
    that share a text only the smallest id's travels with it; a group of copies
    costs one text a task. Partitions then take them sorted by fingerprint,
    through Spark's external sort, and hold one chain at a time. There are as
    many as Spark's setting says, or as the table's rows ask for.
    """
    repeat = 1 << len(filters)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // DOCUMENTS_EACH)

    def route(rows: Iterator[tuple]) -> Iterator[tuple]:
        from xxhash import xxh64_intdigest

        chains = Chains()
        for ident, part, text in rows:
            raw = text.encode("utf-8", "surrogatepass")
            at = xxh64_intdigest(raw)
            if ident is None:
                yield at, (None, None, failures(raw, filters), {part: 1})
                continue
            known = chains.admit(at, raw, ident, None, {part: 1}, filters)
            if known:
                yield xxh64_intdigest(str(known[0])), (None, known[0], known[1] | repeat, known[2])
            if chains.bytes > HELD_BYTES:
                yield from ((at, tuple(entry)) for at, entry in chains.drain())
        yield from ((at, tuple(entry)) for at, entry in chains.drain())
        give_back()

    def settle(records: Iterator[tuple]) -> Iterator[tuple]:
        chains, here = Chains(), None
        for at, (raw, ident, bits, parts) in records:
            if raw is None:
                yield ident, bits, parts
                continue
            if at != here:
                yield from ((i, b, p) for _, (_, i, b, p) in chains.drain())
                here = at
            if known := chains.admit(at, raw, ident, bits, parts):
                yield known[0], known[1] | repeat, known[2]
        yield from ((i, b, p) for _, (_, i, b, p) in chains.drain())
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).rdd
    routed = rows.mapPartitions(route).repartitionAndSortWithinPartitions(partitions, lambda at: at % partitions)
    flat = routed.mapPartitions(settle).flatMap(lambda r: [(r[0], part, r[1], n) for part, n in r[2].items()])
    return docs.sparkSession.createDataFrame(flat, "doc_id long, part string, bits int, n long", verifySchema=False)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id of each document that repeats the text of a smaller one; rows that repeat each other give rows each."""
    found = masks(docs, {}).where("bits = 1")
    return found.select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_"), "doc_id").select("doc_id")


def vectors(found: DataFrame, labels: DataFrame, filters: int) -> RDD:
    """(part, counts): counts is a list of all, good and toxic documents by mask, one list after another.

    A document is good or toxic if any label of its id says so.
    """
    width = 1 << filters
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # An id that many rows repeat meets its label once.
    rows = found.groupBy("doc_id", "part", "bits").agg(F.sum("n").alias("n")).join(marks, "doc_id", "left")
    rows = rows.select("part", "bits", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))

    def add(counts: list[int], row: tuple) -> list[int]:
        bits, n, good, toxic = row
        counts[bits] += n
        counts[width + bits] += n * good
        counts[2 * width + bits] += n * toxic
        return counts

    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4])))
    return keyed.combineByKey(lambda row: add([0] * (3 * width), row), add, lambda a, b: [x + y for x, y in zip(a, b)], partitions)


def report(part: str, counts: list[int], names: str) -> Iterator[tuple]:
    """The audit's rows of one part: each order of the filters, and each step of it."""
    of = len(names)
    width = 1 << of
    every, good, toxic = np.array(counts, np.int64).reshape(3, width)
    mask = np.arange(width)
    rows, total = [], dict.fromkeys(names, 0)
    for order in itertools.permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            fails, gone = (mask & bit) > 0, (mask & before) > 0
            here = fails & ~gone
            removed = int(every[here].sum())
            total[name] += removed
            rows.append(("".join(order), step, name, int(every[~gone & ~fails].sum()), removed, int(every[fails & gone].sum()), int(every[bit]), int(good[here].sum()), int(toxic[here].sum())))
            before |= bit
    for order, step, name, *numbers in rows:
        yield (part, order, step, *numbers, total[name])


def audit(docs: DataFrame, labels: DataFrame, filters: Filters = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    One row for each part (the source; null counts as empty), order of the
    filters and REPEATS, and step of it. kept: documents of the part after this
    step; removed: here; redundant: failing its filter, removed earlier;
    unique_fails: failing this filter only; good_lost and toxic_lost: removed
    here with label quality or toxic 1; shapley: what its filter removes, over
    all orders, so shapley / orders is its fair share.

    Repeats count table-wide, whether the smaller id is removed or not. Rows
    that repeat each other in full count each, and none repeats the other. A
    null doc_id is no repeat and has no label. Null texts are empty. An empty
    table has no parts. Further columns are not read. Filters may be others, of
    single-letter names; more than six make more orders than are of use.
    """
    names = "".join(filters) + REPEATS
    if len(set(names)) < len(names) or math.factorial(len(names)) > 5040:
        raise ValueError(f"filters {names} need distinct letters, seven at most")
    found = materialize(masks(docs, filters), "audit-masks")
    counted = vectors(found, labels, len(names))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(counted.flatMap(lambda kv: report(kv[0], kv[1], names)), schema, verifySchema=False)
