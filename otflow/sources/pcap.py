"""Captures as tables and streams of packets.

read_captures and stream_captures read any store that Spark's file sources
reach. A capture of any size is split: tasks read ranges of its bytes, find
where records start, and decode frames by columns; a file that breaks off gives
the packets before. spark.read.format("pcap") reads a folder that every executor
has under the same path, a file a task. Options: path (a folder or file),
packetLimit (per file), backend ('plain' or 'full'), columns (those that are
decoded, the others are null), pushdown ('true': Spark's filters are decided by
headers before contents are decoded; needs
spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from otflow.functions import decode, frame_columns
from otflow.functions.frame_columns import Wanted
from otflow.sources import records as R
from otflow.sources.schema import PACKET

SUFFIXES = (".pcap", ".pcapng")
#: Frames that are decoded together, and bytes that a file is read by.
BATCH, READ = 8192, 1 << 24
EVERYTHING = Wanted()


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(microseconds since the epoch, frame) of a classic capture or a pcapng file."""
    for held, found in R.chunks([data]):
        for at, size, ts_us in zip(found.starts.tolist(), found.sizes.tolist(), found.times.tolist()):
            yield ts_us, held[at : at + size]


def packet_rows(name: str, data: bytes, limit: int | None = None, full: bool = False) -> Iterator[dict]:
    """Rows of PACKET of one capture's content, frame by frame; limit counts frames."""
    for index, (ts_us, frame) in enumerate(records(data)):
        if limit is not None and index >= limit:
            return
        for row in decode.frames(frame, full):
            row |= decode.details(row, full)
            row.pop("payload")
            yield row | {"pcap_file": name, "packet_index": index, "ts_us": ts_us}


def _tables(name: str, data: bytes, found: R.Walk, first: int, limit: int | None, full: bool, wanted: Wanted, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The packets of a walk's frames, of which the first has the number first, in batches."""
    n = len(found.starts) if limit is None else max(0, min(len(found.starts), limit - first))
    for a in range(0, n, BATCH):
        z = min(a + BATCH, n)
        begin, end = int(found.starts[a]), int(found.starts[z - 1] + found.sizes[z - 1])
        batch = frame_columns.table(name, data[begin:end], found.starts[a:z] - begin, found.sizes[a:z], found.times[a:z], first + a, arrow, full, wanted)
        if batch.num_rows:
            yield batch


def packet_batches(name: str, pieces: Iterable[bytes], arrow: pa.Schema, limit: int | None = None, full: bool = False, wanted: Wanted = EVERYTHING) -> Iterator[pa.RecordBatch]:
    """The packets of a capture that comes in pieces, as packet_rows tells them; the longest record and one piece are held."""
    first = 0
    for held, found in R.chunks(pieces):
        yield from _tables(name, held, found, first, limit, full, wanted, arrow)
        first += len(found.starts)
        if limit is not None and first >= limit:
            return


def capture_files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(SUFFIXES))


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKET

    def reader(self, schema: StructType) -> DataSourceReader:
        # Spark takes no reader with pushFilters unless its setting allows that, so it is asked for.
        return (PushingReader if self.options.get("pushdown", "false") == "true" else PcapReader)(schema, self.options)


class PcapReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema = schema
        self.path = options["path"]
        limit = options.get("packetLimit")
        self.limit = int(limit) if limit else None
        self.full = options.get("backend", "plain") == "full"
        names = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
        self.wanted = Wanted(frozenset(names) or None)

    def partitions(self) -> list[InputPartition]:
        files = capture_files(self.path)
        names = [v for c, o, v in self.wanted.conditions if (c, o) == ("pcap_file", "=")]
        return [InputPartition(f) for f in files if all(os.path.basename(f) == v for v in names)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            yield from packet_batches(os.path.basename(partition.value), iter(lambda: f.read(READ), b""), to_arrow_schema(self.schema), self.limit, self.full, self.wanted)


def _pattern(spark: SparkSession, path: str) -> str:
    """path itself if it is a file, else a pattern of the captures right in it; other folders there don't matter."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return path if store.exists(at) and store.getFileStatus(at).isFile() else f"{path.rstrip('/')}/*.pcap*"


class PushingReader(PcapReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Conditions on header columns are decided before contents are decoded; the others go back to Spark."""
        told, left = frame_columns.conditions_of(filters)
        self.wanted = Wanted(self.wanted.columns, tuple(told))
        yield from left


def _bytes(spark: SparkSession, pattern: str) -> DataFrame:
    """The bytes of files between newlines: file (a hash of its path), block (where the split begins) and value, in order within a split.

    Spark's text source cuts at newlines only and leaves all other bytes as
    they are, reads any store, and splits files at any size.
    """
    return spark.read.option("lineSep", "\n").text(pattern).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(file, block, bytes) of each split of a task; one is held at a time. The file's last has a newline too many if it ends without one."""
    here, lines = None, []
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        values, a = batch.column(2).to_pylist(), 0
        while a < len(keys):
            z = a + 1
            while z < len(keys) and keys[z] == keys[a]:
                z += 1
            if keys[a] != here:
                if here is not None:
                    yield *here, b"\n".join(lines) + b"\n"
                here, lines = keys[a], []
            lines += values[a:z]
            a = z
    if here is not None:
        yield *here, b"\n".join(lines) + b"\n"


def _indexed(source: DataFrame, known: dict[tuple[int, int], tuple[int, R.Layout]] | None = None) -> dict[tuple[int, int], R.Piece]:
    """What each split tells (records.index), or of those known the places where they go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, data in _pieces(batches):
            if known is None or (file, block) in known:
                piece = R.index(data, block == 0, *(known or {}).get((file, block), ()))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([pickle.dumps(piece)])], ["file", "block", "piece"])

    if known is not None:
        source = source.where(F.struct("file", "block").isin([F.struct(F.lit(f).alias("file"), F.lit(b).alias("block")) for f, b in known]))
    rows = source.mapInArrow(run, "file long, block long, piece binary").collect()
    return {(r["file"], r["block"]): pickle.loads(r["piece"]) for r in rows}


def _parts(source: DataFrame, sizes: dict[int, int]) -> dict[tuple[int, int], R.Part]:
    """How to read each split. The driver holds a row a split, as it holds a task, with the bytes of one frame.

    Splits whose guess was wrong are walked again, one of a file at a time.
    """
    pieces = _indexed(source)
    while True:
        parts, wrong, of = {}, {}, {}
        for file, block in sorted(pieces):
            of.setdefault(file, []).append(block)
        for file, blocks in of.items():
            told, again = R.joined([pieces[file, b] for b in blocks], sizes.get(file))
            parts |= {(file, b): p for b, p in zip(blocks, told) if p is not None}
            if again:
                wrong[file, blocks[again[0]]] = again[1:]
        if not wrong:
            return parts
        pieces |= _indexed(source, wrong)


def read_captures(spark: SparkSession, path: str, limit: int | None = None, full: bool = False, total: int | None = None, wanted: Wanted = EVERYTHING) -> DataFrame:
    """The packets of all captures in the folder path, or of one file.

    limit: frames per file; total: packets of all files together, in order of
    file and place. wanted: conditions that packets meet, decided by headers
    before contents are decoded, and the columns that are given.

    Files are read twice, by ranges of spark.sql.files.maxPartitionBytes: once
    to find where records begin, once to decode them.
    """
    pattern = _pattern(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    arrow = to_arrow_schema(StructType.fromDDL(PACKET))
    out = [f for f in arrow.names if wanted.columns is None or f in wanted.columns]
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], PACKET).select(*out)
    least = min((n for n in (limit, total) if n is not None), default=None)
    files = spark.read.format("binaryFile").load(pattern).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"), "length").collect()
    names = {r["file"]: unquote(r["path"].rsplit("/", 1)[-1]) for r in files}
    if len(names) < len(files):
        raise ValueError(f"paths of captures in {path} share a hash")
    source = _bytes(spark, pattern)
    parts = spark.sparkContext.broadcast(_parts(source, {r["file"]: r["length"] for r in files}))
    schema = StructType([f for f in StructType.fromDDL(PACKET) if f.name in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, data in _pieces(batches):
            part = parts.value.get((file, block))
            if part is not None and (least is None or part.first < least):
                data = data[: part.end] + part.more
                yield from _tables(names[file], data, R.walk(data, part.at, part.layout), part.first, least, full, wanted, to_arrow_schema(schema))

    found = source.mapInArrow(run, schema)
    return found if total is None else found.orderBy("pcap_file", "packet_index").limit(total)


def _decoded(files: DataFrame, full: bool, limit: int | None) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(PACKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from packet_batches(name, [content.as_py()], arrow, limit, full)

    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, PACKET)


def stream_captures(spark: SparkSession, path: str, full: bool = False, limit: int | None = None) -> DataFrame:
    """The same as a stream of files, with at most limit frames of each, whose log remembers every file by name, whatever the names' order.

    As with any file stream a capture has to appear complete, by a move; one of
    a stream is a task, and has 2 GB at most.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return _decoded(files.load(_pattern(spark, path)), full, limit)
