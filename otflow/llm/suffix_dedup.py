"""Removal of byte strings that repeat across documents, by prefix doubling over anchors.

Ranking all suffixes of a corpus would move each byte many times, so positions
are thinned first: an anchor is a position whose 18-byte gram has the least hash
of some 50-byte window, and it owns the windows of which it is the leftmost such
position. Equal windows have equal owners, so only anchors are ranked, by
strings that grow until they are unique or 50 bytes long:

1. anchors are sorted by gram and by the whole span of bytes that their windows
   cover. One whose gram is nowhere else leaves; one whose span a smaller
   document has as well is settled, with all its windows at once;
2. what is left is ranked by 34 bytes, the gram and the 16 bytes before or after
   it. Strings of one document leave, the others get a rank;
3. windows are sorted by pairs of that rank and the 16 bytes that are left of 50.

Hashes only choose anchors and prune in step 1, but for spans: these count as
equal by 64 bits of the gram and 64 of the span. Steps 2 and 3 compare bytes.
Groups are aggregated partially and joined back, so no task holds one. Equal
strings fall in the same pass, so steps run in passes that share out the disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import discard, materialize, mix64, release, slices

LENGTH = 50
GRAM = 18
#: Bytes by which strings grow from 18 to 34, and from 34 to 50.
STEP = (LENGTH - GRAM) // 2
#: Grams of a window.
WIDTH = LENGTH - GRAM + 1
#: Passes of step 1, a power of two, and of steps 2 and 3. Each takes the grams or 34-byte strings whose hashes end alike, so that only their share lies on disk.
ANCHOR_PASSES = 2
WINDOW_PASSES = 4

#: Bytes of the documents that are hashed at once, so that numpy's calls are few and their arrays stay in a core's cache.
BLOCK = 1 << 16
#: Bits for the places in a block and the window that follows it.
_PLACES = np.uint64(2 * BLOCK - 1)

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, _BACK))
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Text:
    """Hashes of the strings of some bytes, those of one document or of several in a row."""

    def __init__(self, data: np.ndarray):
        self.bytes = data
        n = len(data)
        up, self._down = _powers.upto(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        sums = self.bytes.astype(np.uint64)
        sums += np.uint64(1)
        sums *= up[:n]
        np.cumsum(sums, out=self._sums[1:])

    def checks(self, begin: np.ndarray, end: np.ndarray, inside: np.ndarray | int = 0) -> np.ndarray:
        """A signed hash of data[b:e], and of a place inside it, for each pair: equal for equal strings wherever they stand."""
        hashes = mix64((self._sums[end] - self._sums[begin]) * self._down[begin] + (end - begin).astype(np.uint64))
        return mix64(hashes + np.asarray(inside).astype(np.uint64)).view(np.int64)

    def anchors(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions that own windows of the documents between offsets, their grams' hashes, and the first and last window of each.

        Hashes are compared but for their lowest bits, which tell the place, so the
        leftmost least one of a window is one minimum. Owners never go back, so an
        owner's windows are one run.
        """
        count = len(self.bytes) - LENGTH + 1
        if count < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = mix64((self._sums[GRAM:] - self._sums[:-GRAM]) * self._down[:-GRAM] + np.uint64(GRAM))
        owner = np.empty(count, np.int64)
        for a in range(0, count, BLOCK):
            some = grams[a : a + BLOCK + WIDTH - 1]
            least = _sliding(some & ~_PLACES | np.arange(len(some), dtype=np.uint64), WIDTH, np.minimum)
            owner[a : a + BLOCK] = (least & _PLACES).view(np.int64) + a
        # The last 49 bytes of a document begin no window.
        outside = (offsets[1:, None] - np.arange(1, LENGTH)).ravel()
        owner[outside[(outside >= 0) & (outside < count)]] = -1
        first = np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)
        last = np.append(first[1:], count) - 1
        at = owner[first]
        own = at >= 0
        return at[own], grams[at[own]], first[own], last[own]


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of the given width, by doubling."""
    out, reach = x, 1
    while 2 * reach <= width:
        out = op(out[:-reach], out[reach:])
        reach *= 2
    return op(out[: len(out) - width + reach], out[width - reach :]) if reach < width else out


def _blocks(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a binary column, their bytes in a row and the offsets of each: documents of BLOCK bytes together, or one that is longer."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * wide().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
        yield slice(a, b), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _anchor_rows(batches: Iterator[pa.RecordBatch], turn: int = 0, passes: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows (key, check, doc, info) of the anchors of a batch that a pass takes; info packs high, low, settled and at.

    Rows of equal gram and span are pre-aggregated: those of a larger document
    than the batch's smallest are settled here, under a key that spreads them.
    """
    for batch in slices(batches, 3000):
        key, check, doc, info = [], [], [], []
        docs = batch.column(0).to_numpy()
        for rows, data, offsets in _blocks(batch.column(1)):
            text = Text(data)
            found = text.anchors(offsets)
            mine = (found[1] & np.uint64(passes - 1)) == turn
            at, grams, first, last = (x[mine] for x in found)
            row = np.searchsorted(offsets, at, "right") - 1
            key.append(grams)
            check.append(text.checks(first, last + LENGTH, at - first))
            doc.append(docs[rows][row])
            info.append((at - first) << 38 | (at - last) << 32 | (at - offsets[row]))
        if not key:
            continue
        key, check, doc, info = map(np.concatenate, (key, check, doc, info))
        order = np.argsort(check)
        key, check, doc, info = key[order], check[order], doc[order], info[order]
        first = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])) if len(key) else np.zeros(0, bool)
        settled = doc > np.minimum.reduceat(doc, np.flatnonzero(first))[np.cumsum(first) - 1] if len(key) else first
        key = np.where(settled, mix64(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (info & 0x7FFFFFFF).astype(np.uint64)), key)
        info |= settled.astype(np.int64) << 31
        out = pa.record_batch([pa.array(key.view(np.int64)), pa.array(check), pa.array(doc), pa.array(info)], names=["key", "check", "doc", "info"])
        del key, check, doc, info, order, first, settled
        yield from slices([out], 100_000)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled and unsettled anchors from rows sorted by (key, check, doc).

    Keeps no group: of the last one, what later rows depend on is carried over
    as ghosts, which are the rows of its first class while it has no second,
    or else one row of each of two classes.
    """
    ghosts = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, check, doc, info = (batch.column(c).to_numpy() for c in ("key", "check", "doc", "info"))
        done = (info >> 31 & 1).astype(bool)
        if done.any():
            yield _settlement(check[done], doc[done], info[done], np.ones(int(done.sum()), bool))
            key, check, doc, info = key[~done], check[~done], doc[~done], info[~done]
            if not len(key):
                continue
        fresh = np.ones(len(key), bool)
        if ghosts is not None:
            key, check, doc, info, fresh = (np.concatenate(x) for x in zip(ghosts, (key, check, doc, info, fresh)))
        group = np.append(True, key[1:] != key[:-1])
        kind = group | np.append(True, check[1:] != check[:-1])
        of_group, of_kind = np.cumsum(group) - 1, np.cumsum(kind) - 1
        full = doc > doc[kind][of_kind]
        many = np.bincount(of_group, kind)[of_group] > 1
        last = of_group == of_group[-1]
        open_ = last & ~many & ~full  # may still turn out to have company
        out = fresh & (full | many) & ~open_
        if out.any():
            yield _settlement(check[out], doc[out], info[out], full[out])
        if many[-1]:
            starts = np.flatnonzero(kind & last)[[0, -1]]
            ghosts = tuple(x[starts] for x in (key, check, doc, info)) + (np.zeros(2, bool),)
        else:
            ghosts = tuple(x[open_] for x in (key, check, doc, info)) + (np.ones(int(open_.sum()), bool),)


def _settlement(check, doc, info, full) -> pa.RecordBatch:
    """doc, the span of the windows that the anchor owns, its place inside, their check, and whether it is settled."""
    at, low, high = info & 0x7FFFFFFF, info >> 32 & 63, info >> 38
    columns = [doc, (at - high).astype(np.int32), (at - low + LENGTH).astype(np.int32), high.astype(np.int32), check, full]
    return pa.record_batch([pa.array(c) for c in columns], names=["doc", "begin", "end", "inside", "check", "full"])


def _lists(*columns: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many values each row has, and all rows' values of columns of lists that are as long; null counts as none."""
    counts = columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, [x.flatten().to_numpy().astype(np.int64) for x in columns]


def _fields(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same of a column of lists of structs."""
    flat = column.flatten()
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), [flat.field(k).to_numpy().astype(np.int64) for k in range(flat.type.num_fields)]


def _own(text: Text, offsets: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, inside: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, begin, end and inside of the spans that are of their row's text and not of another row with its doc_id, by places in a block."""
    whole = end <= np.diff(offsets)[row]
    row, begin, end, inside, check = row[whole], begin[whole] + offsets[row[whole]], end[whole] + offsets[row[whole]], inside[whole], check[whole]
    found = text.checks(begin, end, np.maximum(inside, 0))
    own = np.where(inside < 0, found << 32 >> 32, found) == check
    return row[own], begin[own], end[own], inside[own]


def _half_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, begin, most, context) of unsettled anchors, once for windows that hold the 34 bytes from the gram on, once for those up to its end.

    context begins at byte begin with the first of these windows, in which most
    bytes stand before the 34.
    """
    for batch in slices(batches, 500):
        docs, begins, mosts, contexts = ([] for _ in range(4))
        ids = batch.column(0).to_numpy()
        counts, wanted = _lists(*(batch.column(k) for k in range(2, 6)))
        until = np.append(0, np.cumsum(counts))
        for rows, data, offsets in _blocks(batch.column(1)):
            begin, end, inside, check = (x[until[rows.start] : until[rows.stop]] for x in wanted)
            row, begin, end, inside = _own(Text(data), offsets, np.repeat(np.arange(len(offsets) - 1), counts[rows]), begin, end, inside, check)
            at, low, high = begin + inside, inside - (end - begin - LENGTH), inside
            whole = data.tobytes()
            for least, most, ahead in ((low, np.minimum(high, STEP - 1), 0), (np.maximum(low, STEP), high, STEP)):
                side = np.flatnonzero(least <= most)
                first, last = at[side] - most[side], at[side] - least[side] + LENGTH
                docs.append(ids[rows][row[side]])
                begins.append((first - offsets[row[side]]).astype(np.int32))
                mosts.append((most[side] - ahead).astype(np.int8))
                contexts += [whole[a:b] for a, b in zip(first.tolist(), last.tolist())]
        if docs:
            columns = [pa.array(np.concatenate(c)) for c in (docs, begins, mosts)]
            yield pa.record_batch([*columns, pa.array(contexts, pa.binary())], names=["doc", "begin", "most", "context"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, w0, w1, doc, place) of the windows of contexts: the rank of their 34 bytes and how many stand before these, the other 16 bytes, and where it begins with 32 bits of its check."""
    for batch in slices(batches, 5000):
        contexts = batch.column(3).to_pylist()
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        base, n = np.cumsum(size) - size, size - LENGTH + 1
        text = Text(np.frombuffer(b"".join(contexts), np.uint8))
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = base[row] + step
        before = batch.column(2).to_numpy().astype(np.int64)[row] - step
        rest = np.arange(LENGTH - GRAM - STEP)
        places = at[:, None] + rest + np.where(rest < before[:, None], 0, GRAM + STEP)
        words = text.bytes[places].view(np.int64)
        ranks = batch.column(4).to_numpy()[row] * (STEP + 1) + before
        place = text.checks(at, at + LENGTH) << 32 | (batch.column(1).to_numpy()[row] + step)
        columns = [ranks, np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1]), batch.column(0).to_numpy()[row], place]
        yield pa.record_batch([pa.array(c) for c in columns], names=["rank", "w0", "w1", "doc", "place"])


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """The keys that rows of several documents have, each with the smallest of these documents."""
    return rows.groupBy(*key).agg(F.min("doc").alias("least"), F.max("doc").alias("_most")).where(F.col("least") < F.col("_most")).drop("_most")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, begin, end, inside and check: where removal is due in document doc.

    check is that of Text.checks, or where inside is -1 its lower 32 bits with no place inside.
    """
    spark = docs.sparkSession
    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as binary) text").where("doc_id is not null")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    passes = []
    for turn in range(ANCHOR_PASSES):
        rows = source.mapInArrow(partial(_anchor_rows, turn=turn, passes=ANCHOR_PASSES), "key long, check long, doc long, info long")
        rows = rows.repartition(n, "key").sortWithinPartitions("key", "check", "doc")
        passes.append(materialize(rows.mapInArrow(_first_round, "doc long, begin int, end int, inside int, check long, full boolean"), "anchors", "zstd"))
        release(spark)
    ranked = reduce(DataFrame.unionByName, passes)

    # Only positions and hashes are gathered for a document, fewer than its bytes.
    wanted = ranked.where("not full").groupBy("doc").agg(F.collect_list(F.struct("begin", "end", "inside", "check")).alias("wanted"))
    texts = source.join(wanted.hint("merge"), source["doc_id"] == wanted["doc"]).select("doc_id", "text", "wanted.begin", "wanted.end", "wanted.inside", "wanted.check")
    halves = materialize(texts.mapInArrow(_half_rows, "doc long, begin int, most byte, context binary"), "halves", "zstd")
    release(spark)

    halved = halves.withColumn("half", F.expr(f"substring(context, most + 1, {GRAM + STEP})"))
    begin = F.col("place").bitwiseAND(0x7FFFFFFF).cast("int")
    entries = [ranked.where("full").drop("full")]
    for turn in range(WINDOW_PASSES):
        mine = halved.where(F.pmod(F.xxhash64("half"), F.lit(WINDOW_PASSES)) == turn)
        ranks = materialize(_shared(mine.select("half", "doc"), "half").drop("least").withColumn("rank", F.monotonically_increasing_id()), "ranks", "zstd")
        met = mine.join(ranks.hint("merge"), "half").select("doc", "begin", "most", "context", "rank")
        windows = materialize(met.mapInArrow(_window_rows, "rank long, w0 long, w1 long, doc long, place long"), "windows", "zstd")
        discard(ranks)
        least = materialize(_shared(windows.select("rank", "w0", "w1", "doc"), "rank", "w0", "w1"), "repeated-windows", "zstd")
        late = windows.join(least.hint("merge"), ["rank", "w0", "w1"]).where("doc > least")
        late = late.select("doc", begin.alias("begin"), (begin + LENGTH).alias("end"), F.lit(-1).alias("inside"), F.shiftright("place", 32).alias("check"))
        entries.append(materialize(late, "late-windows", "zstd"))
        discard(windows), discard(least)
        release(spark)
    discard(halves)
    return reduce(DataFrame.unionByName, entries)


def _removed(data: np.ndarray, offsets: np.ndarray, *spans: np.ndarray) -> np.ndarray:
    """Whether each byte of a block is removed; spans: row, begin, end, inside and check of the removals that are due."""
    n = len(data)
    if not len(spans[0]):
        return np.zeros(n, bool)
    _, begin, end, _ = _own(Text(data), offsets, *spans)
    return np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0


def _results(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> list[pa.Array]:
    """n_bytes, n_removed, n_spans, kept_sha256, spans and kept of the documents of a block."""
    n, size = len(data), len(offsets) - 1
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
    end = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False))) + 1
    removed, at = np.append(0, np.cumsum(gone))[offsets], np.searchsorted(begin, offsets)
    spans = np.stack([begin, end], 1) - np.repeat(offsets[:-1], np.diff(at))[:, None]
    left, cuts = data[~gone].tobytes(), offsets - removed
    shas = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    kept = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(left)])
    runs = pa.ListArray.from_arrays(pa.array((2 * at).astype(np.int32)), pa.array(spans.ravel()))
    return [pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(at)), pa.array(shas, pa.string()), runs, kept]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    Every byte goes that a 50-byte string covers which also starts in a document
    with a smaller doc_id; strings are judged on the input. spans holds
    begin and end of each removed run, kept the remaining bytes. Null texts
    count as empty. Rows without a doc_id are neither judged nor witnesses;
    of rows that share one, none is smaller. Further columns are not read.
    """
    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as binary) text")
    entries = repeated(docs, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("begin", "end", "inside", "check")).alias("entries"))
    joined = source.join(entries.hint("merge"), source["doc_id"] == entries["doc"], "left").select("doc_id", "text", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            counts, (begin, end, inside, check) = _fields(batch.column(2))
            until, out = np.append(0, np.cumsum(counts)), []
            for rows, data, offsets in _blocks(batch.column(1)):
                row = np.repeat(np.arange(len(offsets) - 1), counts[rows])
                due = (x[until[rows.start] : until[rows.stop]] for x in (begin, end, inside, check))
                out.append(_results(data, offsets, _removed(data, offsets, row, *due)))
            if out:
                columns = [pa.concat_arrays(c) for c in zip(*out)]
                yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
