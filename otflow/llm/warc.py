"""WARC captures: reading records, and resolving not-modified revisits.

A revisit is a 304 answer without a body. It is joined as of its time to the
latest earlier full response of the same canonical URL; where the validators
agree, the response's headers are updated by those that a 304 may carry.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from otflow.llm.common import materialize

#: Headers that a 304 answer may update.
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

RECORD_SCHEMA = "record_id string, uri string, ts timestamp, kind string, status int, headers map<string,string>, body binary, body_sha256 string"
#: Bytes that are decompressed at a time, that a record's head may have, and that a batch of records holds before it is given on.
CHUNK, HEAD, BATCH = 1 << 20, 1 << 16, 1 << 24


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, at least '/' as path."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    head = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0))
    rest = F.substr(bare, F.length(head) + 1)
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.concat(head, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Each revisit with the response that it repeats.

    captures: record_id string, uri string, ts (seconds or a timestamp), kind
    ('response' or 'revisit'; other kinds are left out), status int, headers map
    (lower-case names), body_sha256 string, as read_warc gives them; further
    columns are left out. A response is a full one if its status is 200; those
    of partial content, redirects and errors are none.
    Returns record_id, canonical_url, response_id, outcome, headers, body_sha256
    with outcome one of
    - resolved: ETags equal, or without an ETag in the revisit equal Last-Modified;
    - unchecked: the revisit has no validators; it is resolved as well;
    - mismatch: validators differ; response_id stays, headers are the revisit's;
    - missing: no earlier response; also for a null uri or ts.
    Only responses of an earlier ts count; of equal ts the largest record_id.
    Rows that repeat each other give rows each; an empty table gives none.

    Rows are ranged over (URL, ts), so a hot URL spreads over many partitions;
    each partition fills forward by itself, and only URLs that cross a
    partition's edge get the last response of the partitions before.
    """
    spark = captures.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    is_response = F.col("kind") == "response"
    rows = captures.where((is_response & (F.col("status") == 200)) | (F.col("kind") == "revisit")).select(
        F.col("record_id").cast("string").alias("record_id"),
        canonical_url(F.col("uri")).alias("url"),
        F.col("ts").cast("long").alias("ts"),
        is_response.alias("full"),
        "headers",
        "body_sha256",
    )
    ranged = materialize(
        rows.where("url is not null and ts is not null").repartitionByRange(n, "url", "ts", "full", "record_id").withColumn("part", F.spark_partition_id()),
        "warc-ranged",
    )
    found = F.when(F.col("full"), F.struct("record_id", "headers", "body_sha256"))
    # A response of the same ts comes after the revisit, so it is not earlier.
    order = Window.partitionBy("part", "url").orderBy("ts", "full", "record_id")
    local = ranged.withColumn("hit", F.last(found, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not full")

    crossing = ranged.groupBy("url").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a < z").select("url")
    ends = ranged.join(crossing, "url", "left_semi").groupBy("url", "part").agg(F.max_by(found, F.when(F.col("full"), F.struct("ts", "record_id"))).alias("end"))
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("end", ignorenulls=True).over(before)).where("carried is not null").select("url", "part", "carried")
    joined = local.join(carried, ["url", "part"], "left").select("record_id", "url", "headers", F.coalesce("hit", "carried").alias("hit"))
    lost = rows.where("not full and (url is null or ts is null)").select("record_id", "url", "headers", F.lit(None).cast(joined.schema["hit"].dataType).alias("hit"))
    return _merged(joined.unionByName(lost))


def _merged(rows: DataFrame) -> DataFrame:
    own, theirs = F.col("headers"), F.col("hit.headers")
    etag, modified = own["etag"], own["last-modified"]
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    same = F.when(etag.isNotNull(), weak(etag).eqNullSafe(weak(theirs["etag"]))).when(modified.isNotNull(), modified.eqNullSafe(theirs["last-modified"]))
    outcome = F.when(F.col("hit").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    updates = F.map_filter(own, lambda k, _: k.isin(*UPDATABLE))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: F.coalesce(~F.map_contains_key(updates, k), F.lit(True))), F.coalesce(updates, F.create_map().cast("map<string,string>")))
    good = outcome.isin("resolved", "unchecked")
    return rows.select(
        "record_id",
        F.col("url").alias("canonical_url"),
        F.col("hit.record_id").alias("response_id"),
        outcome.alias("outcome"),
        F.when(good, F.coalesce(merged, own)).otherwise(own).alias("headers"),
        F.when(good, F.col("hit.body_sha256")).alias("body_sha256"),
    )


def _head(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, headers by lower-case name, and what follows the empty line."""
    head, _, rest = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = (line.partition(":") for line in lines)
    return first, {k.strip().lower(): v.strip() for k, colon, v in fields if colon}, rest


def _plain(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """Pieces of a file's plain bytes, and whether what comes next can't belong to the same record.

    Of a gzip member that is damaged the last piece is left out, which is all
    of it where it has a chunk's size; reading goes on with the next member that
    can be told.
    """
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), CHUNK):
            yield data[at : at + CHUNK], False
        return
    at = 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        member, rest, begin, held = zlib.decompressobj(31), data[at : at + CHUNK], at, b""
        at += len(rest)
        try:
            while not member.eof and rest:
                piece = member.decompress(rest, CHUNK)
                yield held, False
                held, rest = piece, member.unconsumed_tail
                if not rest and not member.eof:
                    rest = data[at : at + CHUNK]
                    at += len(rest)
        except zlib.error:
            pass
        if member.eof:
            yield held, False
            at -= len(member.unused_data)
        else:
            at = begin + 3
        yield b"", True


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or of gzip members, one at a time.

    What can't be read has the kind 'malformed' and nothing else: a record
    without a usable Content-Length, which is one that ends where the file, the
    member or the next record's line begins; one that is cut short; a damaged
    gzip member. Reading goes on with the next record that can be told, which
    may lie within the length that a malformed one claims.
    """
    buffer, mark = bytearray(), LINE
    for piece, ends in _plain(data):
        buffer += piece
        mark = yield from _drained(buffer, mark, ends)
        if ends:
            buffer.clear()
            mark = LINE
    yield from _drained(buffer, mark, True)


#: How a record begins, and how one does after another one's block.
LINE, NEXT = b"WARC/", b"\r\n\r\nWARC/"


def _drained(buffer: bytearray, mark: bytes, final: bool) -> Iterator[dict]:
    """The records that a buffer holds whole, which are taken off it; returns by what the next one is told."""
    while (begin := buffer.find(mark)) >= 0:
        begin += len(mark) - len(LINE)
        end = buffer.find(b"\r\n\r\n", begin)
        if end < 0 and len(buffer) - begin <= HEAD and not final:
            return mark
        fields, stop = {}, None
        if 0 <= end - begin <= HEAD:
            _, fields, _ = _head(bytes(buffer[begin : end + 4]))
            size = fields.get("content-length", "0")
            stop = end + 4 + int(size) if size.isascii() and size.isdigit() and len(size) < 19 else None
        if stop is not None and len(buffer) < stop + len(NEXT) and not final:
            return mark
        if stop is not None and stop <= len(buffer) and LINE.startswith(bytes(buffer[stop : stop + len(NEXT)]).lstrip(b"\r\n")[: len(LINE)]):
            block = bytes(buffer[end + 4 : stop])
            del buffer[:stop]
            mark = LINE
            yield _record(fields, block)
        else:
            yield MALFORMED
            del buffer[: begin + len(LINE)]
            mark = NEXT  # what is left of the record may name one
    del buffer[: max(0, len(buffer) - len(mark) + 1)]
    return mark


MALFORMED = {"record_id": None, "uri": None, "date": None, "kind": "malformed", "status": None, "headers": {}, "body": None, "body_sha256": None}


def _record(fields: dict[str, str], block: bytes) -> dict:
    status, headers, body = None, {}, block
    if "application/http" in fields.get("content-type", ""):
        line, headers, body = _head(block)
        code = line.split(" ")[1:2]
        status = int(code[0]) if code and code[0].isascii() and code[0].isdigit() and len(code[0]) < 10 else None
    return {
        "record_id": fields.get("warc-record-id"),
        "uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        "kind": fields.get("warc-type"),
        "status": status,
        "headers": headers,
        "body": body,
        "body_sha256": hashlib.sha256(body).hexdigest(),
    }


def read_warc(spark: SparkSession, path: str, malformed: bool = False) -> DataFrame:
    """The records of all WARC files under path, one row each, by RECORD_SCHEMA.

    With malformed there is also a row of that kind for each record that can't
    be read. A task holds a file as it is stored (at most 2 GB) and one batch
    of records. An unreadable date gives a null ts.
    """
    types = [("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("status", pa.int32())]
    types += [("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("body_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for record in parse_warc(content.as_py()):
                    if malformed or record["kind"] != MALFORMED["kind"]:
                        held.append(record | {"headers": list(record["headers"].items())})
                        size += len(record["body"] or b"") + 1000
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(types))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(types))

    raw = spark.read.format("binaryFile").load(path).select("content")
    schema = RECORD_SCHEMA.replace("ts timestamp", "date string")
    return raw.mapInArrow(run, schema).select("record_id", "uri", F.try_to_timestamp("date").alias("ts"), "kind", "status", "headers", "body", "body_sha256")
