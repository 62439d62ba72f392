"""Capture files made of the events table, byte by byte, and what the decoders read from them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from otflow.sources import pcap
from otflow.sources.schema import PACKET

PORTS = (502, 80, 1883, 1883, 4840, 443)
FLAGS = (0x02, 0x12, 0x18, 0x11)
METHODS = ("GET", "POST", "PUT")


def _text(value: str, code: str = ">H") -> bytes:
    data = value.encode()
    return struct.pack(code, len(data)) + data


def _modbus(e: int, k: int, v: int, back: int) -> bytes:
    function = (3, 6, 16)[e // 2 % 3]
    low, high = v % 65536, (v + 1) % 65536
    bodies = {
        3: (struct.pack(">HH", k, 1 + k % 4), struct.pack(">BH", 2, low)),
        6: (struct.pack(">HH", k, low), struct.pack(">HH", k, low)),
        16: (struct.pack(">HHBHH", k, 2, 4, low, high), struct.pack(">HH", k, 2)),
    }
    body = bodies[function][back]
    return struct.pack(">HHHBB", e % 65536, 0, len(body) + 2, e % 7, function) + body


def _http(e: int, k: int, v: int, back: int) -> bytes:
    if back:
        return f"HTTP/1.1 {200 + k} OK\r\nContent-Type: Text/HTML\r\n\r\n".encode()
    return f"{METHODS[e // 2 % 3]} /p/{k}/{v} HTTP/1.1\r\nHost: Host{k}.Example\r\n\r\n".encode()


def _publish(e: int, k: int, v: int, back: int) -> bytes:
    qos = e // 2 % 3
    body = _text(f"t/{k}/{e % 9}") + (struct.pack(">H", 1 + e % 65535) if qos else b"") + str(v / 4).encode()
    return bytes([0x30 | qos << 1 | e // 6 % 2, len(body)]) + body


def _connect(e: int, k: int, v: int, back: int) -> bytes:
    body = _text("MQTT") + struct.pack(">BBH", 4, 2, k) + _text(f"c-{e % 50}")
    return bytes([0x10, len(body)]) + body


def _opcua(e: int, k: int, v: int, back: int) -> bytes:
    kind, body = (b"OPNF", struct.pack("<I", e) + _text(f"policy-{k % 4}", "<i")) if back else (b"HELF", bytes(20) + _text(f"opc.tcp://host{k}:4840", "<i"))
    return kind + struct.pack("<I", 8 + len(body)) + body


def _hello(e: int, k: int, v: int, back: int) -> bytes:
    if back:
        return b"\x17\x03\x03\x00\x04" + struct.pack(">I", e)
    name = b"\0" + _text(f"s{k}.example.net")
    server = struct.pack(">HHH", 0, len(name) + 2, len(name)) + name
    body = struct.pack(">H", 0x0303) + bytes(32) + b"\0" + struct.pack(">HH", 2, 0x1301) + b"\1\0" + struct.pack(">H", len(server)) + server
    shake = b"\1" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


PAYLOADS = (_modbus, _http, _publish, _connect, _opcua, _hello)


def frame(e: int, k: int, v: int) -> bytes:
    """The Ethernet frame of event e: plain, with a VLAN tag, or in GRE without or with a key."""
    back = e % 2
    client, server = (bytes((10, k % 7, e % 200, k)), 40000 + k), (bytes((192, 168, 43, k % 5 + 1)), PORTS[k % 6])
    (src, sp), (dst, dp) = (server, client) if back else (client, server)
    body = struct.pack(">HHIIBBHHH", sp, dp, e, v, 5 << 4, FLAGS[e % 4], 0, 0, 0) + PAYLOADS[k % 6](e, k, v, back)
    packet = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0) + src + dst + body
    if e % 5 in (1, 2):
        body = (struct.pack(">HHI", 0x2000, 0x0800, e) if e % 5 == 2 else struct.pack(">HH", 0, 0x0800)) + packet
        packet = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, 47, 0) + bytes((1, 1, 1, 1, 2, 2, 2, 2)) + body
    tag = struct.pack(">HH", 0x8100, 7) if e % 5 == 0 else b""
    return bytes(6) + bytes((2, 0, 0, 0, e % 256, k)) + tag + b"\x08\0" + packet


def capture(frames: list[tuple[int, bytes]], order: str) -> bytes:
    out = [struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for ts_us, data in frames:
        out.append(struct.pack(order + "4I", ts_us // 1_000_000, ts_us % 1_000_000, len(data), len(data)) + data)
    return b"".join(out)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as frames in capture files of both byte orders, decoded again. tcp_seq is the event's id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.selectExpr("event_id e", "cast(get_json_object(props, '$.k') as bigint) k", "cast(abs(floor(value)) as bigint) v", "unix_micros(from_utc_timestamp(cast(ts as timestamp), current_timezone())) ts_us")
    arrow = to_arrow_schema(StructType.fromDDL(PACKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(batch.column(c).to_pylist() for c in ("e", "k", "v", "ts_us"))))
            for n, at in enumerate(range(0, len(found), 1000)):
                content = capture([(ts, frame(e, k, v)) for e, k, v, ts in found[at : at + 1000]], "<>"[n % 2])
                yield from pcap.packet_batches("events.pcap", [content], arrow)

    return rows.mapInArrow(run, PACKET)


def _named(k: int) -> tuple[int, int, int, bytes]:
    """Transport, ports and content whose protocol the two backends name in their own ways."""
    question = struct.pack(">6H", k, 0, 1, 0, 0, 0) + bytes((3,)) + b"plc" + bytes((5,)) + b"local" + struct.pack(">BHH", 0, 1, 1)
    session = lambda body: struct.pack(">HH", 0, len(body)) + body
    return (
        (17, 5353, 5353, question),
        (6, 40000 + k, 139, session(b"\xffSMB\x72" + bytes(27))),
        (6, 445, 40000 + k, session(b"\xfeSMB" + bytes(60))),
        (6, 22, 502, b""),
        (6, 40000 + k, 53, struct.pack(">H", len(question)) + question),
    )[k % 5]


def _segment(transport: int, sp: int, dp: int, content: bytes) -> bytes:
    """An untagged frame of one TCP or UDP segment."""
    body = struct.pack(">HH", sp, dp) + (struct.pack(">HH", 8 + len(content), 0) if transport == 17 else struct.pack(">IIBBHHH", 1, 1, 5 << 4, 24, 0, 0, 0)) + content
    return bytes(12) + b"\x08\0" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, transport, 0) + bytes((10, 0, 0, 1, 10, 0, 0, 2)) + body


def _service(e: int, k: int, v: int) -> bytes:
    """An OPC UA message: a read of two nodes, a write to one, or the answer to a read."""
    node = lambda n: struct.pack("<BH", 3, 3) + _text(f"tag{n % 4}", "<i")
    none, extension = struct.pack("<i", -1), bytes(3)
    number = lambda x: struct.pack("<BBd", 1, 11, x)
    asked = bytes(2) + bytes(16) + none + bytes(4) + extension
    kind, body = (
        (631, asked + bytes(12) + struct.pack("<i", 2) + b"".join(node(n) + struct.pack("<I", 13) + none + bytes(2) + none for n in (k, k + 1))),
        (673, asked + struct.pack("<i", 1) + node(k) + struct.pack("<I", 13) + none + number(v / 2)),
        (634, bytes(16) + bytes(1) + struct.pack("<i", 0) + extension + struct.pack("<i", 2) + number(v / 4) + struct.pack("<BI", 2, 0x80000000)),
    )[k % 3]
    message = struct.pack("<I8xIBBH", 7 + k % 2, e, 1, 0, kind) + body
    return b"MSGF" + struct.pack("<I", 8 + len(message)) + message


def services_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an OPC UA message of each event is read as, from and to the server's port."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id e", "cast(get_json_object(props, '$.k') as bigint) k", "cast(abs(floor(value)) as bigint) v")
    arrow = to_arrow_schema(StructType.fromDDL(PACKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*(batch.column(c).to_pylist() for c in ("e", "k", "v")))
            frames = [(e, _segment(6, *((4840, 40000) if k % 3 == 2 else (40000, 4840)), _service(e, k, v))) for e, k, v in found]
            yield from pcap.packet_batches("events.pcap", [capture(frames, ">")], arrow)

    told = rows.mapInArrow(run, PACKET)
    return told.selectExpr(
        "opcua_request_id event_id", "opcua_message_type", "opcua_secure_channel_id", "opcua_service_type", "opcua_operation", "array_join(opcua_node_ids, ',') nodes",
        "size(opcua_values) n_values", "try_element_at(opcua_values, 1) first_value", "try_element_at(opcua_values, 2) second_value",
    )


def names_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, plain and full: the protocol of a frame of each event as either backend names it."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id e", "cast(get_json_object(props, '$.k') as bigint) k")
    arrow = to_arrow_schema(StructType.fromDDL(PACKET))
    wanted = pcap.Wanted(frozenset(("ts_us", "high_level_protocol")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = []
            for e, k in zip(batch.column("e").to_pylist(), batch.column("k").to_pylist()):
                frames.append((e, _segment(*_named(k))))
            content = capture(frames, "<")
            plain, full = (pa.Table.from_batches(pcap.packet_batches("events.pcap", [content], arrow, None, which, wanted), arrow).combine_chunks() for which in (False, True))
            yield from pa.table([plain["ts_us"], plain["high_level_protocol"], full["high_level_protocol"]], names=["event_id", "plain", "full"]).to_batches()

    return rows.mapInArrow(run, "event_id long, plain string, full string")
