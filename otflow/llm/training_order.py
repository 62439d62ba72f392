"""Training-order materialisation: token sequences in a keyed pseudo-random global order.

Documents are sorted by id and text, so that every sequence has a dense index
that depends on the data only, however these are split in files. A Feistel
network with cycle-walking turns it into a slot, and shards hold ranges of slots
at a fixed stride, so that a reader at any step knows file and byte offset
without an index.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import discard, materialize, mix64, release, slices, utf8

LENGTH = 256
ROUNDS = 4
SHARD_RECORDS = 1 << 14
#: Id that fills up a document's last sequence; the first free id of the 50k vocabularies.
PAD = 50_256
#: A special token that is never allowed: where a text has it, it is text.
UNUSED = "<|endoftext|>"


def feistel(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slot in 0..n-1 of each index in 0..n-1, or with inverse the index of each slot.

    A balanced Feistel network permutes the smallest power of 4 that holds n;
    values that fall outside 0..n-1 walk on along their cycle.
    """
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key & (2**64 - 1)))
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def _encoder(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    ranks = _ranks(path)
    # No call allows the special token. Without any, tiktoken looks for the empty text and so stops at each character of a text.
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={UNUSED: max(ranks.values()) + 1})


def sequences(docs: DataFrame, ranks: str, length: int = LENGTH) -> DataFrame:
    """One row for each document with words: part, first, doc_id, n_tokens and data, as a written table.

    Rows are ranged and sorted by (doc_id, text), nulls first; of rows that
    repeat both, which are alike, the order doesn't matter. part is the range's
    number, first the number of sequences before the document's in it. data:
    all ids, little-endian unsigned 16 bits, each sequence padded to length.
    Null and empty texts have no sequence, nor has an empty table. Repeated rows
    give their sequences each; further columns are not read. Rank files of over
    65,535 ids don't fit the records and raise ValueError.
    """
    if max(_ranks(ranks).values()) >= 1 << 16 or PAD >= 1 << 16:
        raise ValueError(f"{ranks} has ids of more than 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = _encoder(ranks), 0
        for batch in slices(batches, 500):
            kept, firsts, sizes, data = [], [], [], []
            for k, text in enumerate(utf8(batch.column(1))):
                ids = own.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=()).astype("<u2")
                if len(ids):
                    kept.append(k)
                    firsts.append(first)
                    sizes.append(len(ids))
                    data.append(ids.tobytes() + np.full(-len(ids) % length, PAD, "<u2").tobytes())
                    first += -(-len(ids) // length)
            columns = [pa.array(firsts, pa.int64()), batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())]
            yield pa.record_batch(columns, names=["first", "doc_id", "n_tokens", "data"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").where("octet_length(text) > 0")
    # The place of a row only deals out rows that repeat each other.
    placed = source.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(n, "doc_id", "hash", "place")
    found = placed.sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text").mapInArrow(run, "first long, doc_id long, n_tokens long, data binary")
    return materialize(found.select(F.spark_partition_id().alias("part"), "*"), "sequences", "zstd")


def ordered(found: DataFrame, key: int, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """slot, shard, doc_id, seq_no, n_tokens and record of every sequence, ranged over the shards and sorted by slot.

    The dense index is a sequence's place in its range plus the sizes of the
    ranges before; one count for each is all that reaches the driver. Slots are
    a permutation, so shards are dealt out by number.
    """
    spark = found.sparkSession
    sizes = F.max(F.col("first") + F.ceil(F.col("n_tokens") / length)).alias("n")
    counts = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(sizes).collect())
    total = sum(n for _, n in counts)
    starts = dict(zip((p for p, _ in counts), np.cumsum([0, *(n for _, n in counts)])[:-1].tolist()))
    shards = max(1, -(-total // shard_records))
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards))
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            part, first, tokens = (batch.column(k).to_numpy() for k in (0, 1, 3))
            sizes = -(-tokens // length)
            seq_no = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            index = np.repeat(first + np.array([starts[p] for p in part.tolist()], np.int64), sizes) + seq_no
            slot = feistel(index, total, key)
            own = np.minimum(np.repeat(tokens, sizes) - seq_no * length, length)
            data = b"".join(batch.column(4).to_pylist())
            records = pa.Array.from_buffers(pa.binary(), len(slot), [None, pa.py_buffer((np.arange(len(slot) + 1) * stride).astype(np.int32)), pa.py_buffer(data)])
            ids = batch.column(2).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            shard = slot // shard_records
            columns = [pa.array((shard * n // shards).astype(np.int32)), pa.array(slot), pa.array(shard), ids, pa.array(seq_no.astype(np.int32)), pa.array(own.astype(np.int32)), records]
            yield pa.record_batch(columns, names=["target", "slot", "shard", "doc_id", "seq_no", "n_tokens", "record"])

    schema = "target int, slot long, shard long, doc_id long, seq_no int, n_tokens int, record binary"
    placed = found.select("part", "first", "doc_id", "n_tokens", "data").mapInArrow(run, schema)
    return placed.repartitionById(n, "target").sortWithinPartitions("slot").drop("target")


PACKED = "shard long, doc_id array<long>, seq_no array<int>, n_tokens array<int>, data binary"


def packed(placed: DataFrame) -> DataFrame:
    """One row per shard: its records at their fixed stride, and for each the document, number and tokens it is of.

    A shard has a fixed number of records, so a row has a bounded size.
    """

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        listed = [pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(k).combine_chunks()) for k in (1, 2, 3)]
        data = b"".join(whole.column(4).to_pylist())
        return pa.record_batch([whole.column(0).slice(0, 1).combine_chunks(), *listed, pa.array([data], pa.binary())], names=["shard", "doc_id", "seq_no", "n_tokens", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    if held and shard[a] != last:
                        yield row(held)
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = shard[a]
        if held:
            yield row(held)

    return placed.select("shard", "doc_id", "seq_no", "n_tokens", "record").mapInArrow(run, PACKED)


def write_shards(shards: DataFrame, folder: str, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Write <folder>/shard-<number>.bin files of packed shards; returns a row for each record.

    slot, doc_id, seq_no, n_tokens, shard, byte_offset, record_sha256 (of
    the padded record) and path, the file it is in. folder: a URI that every executor reaches (file:// of a
    shared mount, or a store that pyarrow knows). A shard is written under
    a name of its attempt and then moved, so a task that is repeated, or runs
    twice at a time, leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        stride = 2 * length
        for batch in batches:
            for shard, ids, numbers, sizes, data in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), utf8(batch.column(4))):
                attempt = f"{root}/.shard-{shard:08d}-{uuid.uuid4().hex}"
                with store.open_output_stream(attempt) as out:
                    out.write(data)
                store.move(attempt, f"{root}/shard-{shard:08d}.bin")
                n = len(data) // stride
                offsets = np.arange(n) * stride
                shas = [hashlib.sha256(data[a : a + stride]).hexdigest() for a in offsets.tolist()]
                columns = [pa.array(shard * shard_records + np.arange(n)), ids.values, numbers.values, sizes.values, pa.array(np.full(n, shard)), pa.array(offsets), pa.array(shas), pa.array([f"{folder}/shard-{shard:08d}.bin"] * n)]
                yield pa.record_batch(columns, names=["slot", "doc_id", "seq_no", "n_tokens", "shard", "byte_offset", "record_sha256", "path"])

    return shards.mapInArrow(run, "slot long, doc_id long, seq_no int, n_tokens int, shard long, byte_offset long, record_sha256 string, path string")


def materialise(docs: DataFrame, ranks: str, key: int, folder: str, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Tokenise docs and write their sequences in training order; returns write_shards' rows.

    Files are written when the result is computed. The table of sequences goes
    as soon as the packed shards are there.
    """
    found = sequences(docs, ranks, length)
    shards = materialize(packed(ordered(found, key, length, shard_records)), "shards", "zstd")
    discard(found)
    release(docs.sparkSession)
    return write_shards(shards, folder, length, shard_records)


def read_records(folder: str, first_slot: int, n: int, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> Iterator[np.ndarray]:
    """The records of n slots from first_slot on, which is how a reader resumes at any step."""
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    for slot in range(first_slot, first_slot + n):
        with store.open_input_file(f"{root}/shard-{slot // shard_records:08d}.bin") as f:
            f.seek(slot % shard_records * 2 * length)
            yield np.frombuffer(f.read(2 * length), "<u2")
