"""Captures in pieces and by columns, against the reader of frames one by one."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from otflow.functions import decode, frame_columns
from otflow.functions.frame_columns import Wanted
from otflow.sources import pcap
from otflow.sources import records as R
from otflow.sources.frame_view import capture, frame
from otflow.sources.schema import PACKET



@pytest.fixture(scope="module", autouse=True)
def arrow(spark):
    global ARROW
    ARROW = to_arrow_schema(StructType.fromDDL(PACKET))


def block(kind: int, body: bytes, order: str = "<") -> bytes:
    body += bytes(-len(body) % 4)
    return struct.pack(order + "2I", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def section(order: str = "<") -> bytes:
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(power: int | None = None, order: str = "<", comment: int = 0) -> bytes:
    options = struct.pack(order + "2H", 1, comment) + b"c" * comment + bytes(-comment % 4)
    options += struct.pack(order + "2HB3x", 9, 1, power) if power is not None else b""
    return block(1, struct.pack(order + "HHI", 1, 0, 65535) + options, order)


def packet(face: int, ticks: int, data: bytes, order: str = "<") -> bytes:
    return block(6, struct.pack(order + "5I", face, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data + bytes(-len(data) % 4), order)


def blocks() -> bytes:
    """Two sections of different byte orders, interfaces told late and of different resolution."""
    frames = [frame(e, e * 7 % 100, e) for e in range(40)]
    out = section() + interface() + b"".join(packet(0, 1_700_000_000_000_000 + k, f) for k, f in enumerate(frames[:12])) + interface(9, comment=30)
    out += b"".join(packet(k % 2, (1_700_000_000_000_000 + k) * (1000 if k % 2 else 1), f) for k, f in enumerate(frames[12:25])) + block(5, bytes(24))
    out += section(">") + interface(3, ">") + b"".join(packet(0, 1_700_000_000_000 + k, f, ">") for k, f in enumerate(frames[25:]))
    return out


def nested() -> bytes:
    """A capture whose frames carry another capture's records and zeros, which look like records themselves."""
    inner = capture([(1_600_000_000_000_000 + k, bytes(20)) for k in range(40)], "<")[24:]
    rows = [(1_700_000_000_000_000 + k, frame(k, k, k) + inner[: 40 * k] + bytes(16 * (k % 5))) for k in range(12)]
    return capture(rows, "<")


FILES = {
    "classic": capture([(1_700_000_000_000_000 + 1000 * k, frame(k, k % 100, k)) for k in range(30)], ">"),
    "blocks": blocks(),
    "nested": nested(),
    "zeros": capture([(0, bytes(k % 3)) for k in range(40)], "<"),
    "cut": capture([(10**15 + k, frame(k, 3, k)) for k in range(20)], "<")[:-3],
    "huge": capture([(10**15, frame(1, 1, 1))], "<") + struct.pack("<4I", 5, 5, 1 << 20, 1 << 20) + bytes(500),
    "empty": capture([], "<"),
    "none": b"",
    "other": b"no capture\n at all" * 9,
}


def in_pieces(data: bytes, cuts: list[int], size: int | None = None) -> list[tuple[int, bytes]]:
    """The frames that the pieces between cuts give, as the tasks of a job do."""
    bounds = [0, *cuts, len(data)]
    pieces = [data[a:z] for a, z in zip(bounds, bounds[1:]) if a < z]
    told = [R.index(p, k == 0) for k, p in enumerate(pieces)]
    for _ in range(len(pieces) + 1):
        parts, wrong = R.joined(told, size)
        if not wrong:
            break
        told[wrong[0]] = R.index(pieces[wrong[0]], wrong[0] == 0, *wrong[1:])
    assert not wrong
    out = []
    for part, piece in zip(parts, pieces):
        if part:
            held = piece[: part.end] + part.more
            found = R.walk(held, part.at, part.layout)
            assert part.first == len(out)
            out += [(int(t), held[a : a + n]) for a, n, t in zip(found.starts, found.sizes, found.times)]
    return out


@pytest.mark.parametrize("name", FILES)
def test_a_cut_at_every_place(name):
    data = FILES[name]
    whole = list(pcap.records(data))
    assert len(whole) == {"classic": 30, "blocks": 40, "nested": 12, "zeros": 40, "cut": 19, "huge": 1}.get(name, 0)
    for cut in range(1, len(data), 1 if len(data) < 3000 else 5):
        assert in_pieces(data, [cut]) == whole


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("width", [1, 13, 100, 1000])
def test_pieces_of_any_width(name, width):
    data = FILES[name][: 500 if width == 1 else 3000]
    assert in_pieces(data, list(range(width, len(data), width))) == list(pcap.records(data))


def test_a_byte_too_many_completes_no_record():
    data = FILES["classic"]
    for whole in (data, data[:-1]):
        assert in_pieces(whole + b"\n", [700], len(whole)) == list(pcap.records(whole))


def test_chunks_of_any_size():
    for data in FILES.values():
        for width in (1, 50, 4096):
            found = [(int(t), held[a : a + n]) for held, w in R.chunks(data[k : k + width] for k in range(0, len(data), width)) for a, n, t in zip(w.starts, w.sizes, w.times)]
            assert found == list(pcap.records(data))


def plain(data: bytes, full: bool, limit=None) -> list[dict]:
    return pa.RecordBatch.from_pylist(list(pcap.packet_rows("f", data, limit, full)), ARROW).to_pylist()


def by_columns(data: bytes, full: bool, wanted: Wanted = Wanted(), limit=None) -> list[dict]:  # noqa: B008
    return [r for b in pcap.packet_batches("f", [data], ARROW, limit, full, wanted) for r in b.to_pylist()]


def odd_frames() -> list[bytes]:
    """Frames cut at every place, tunnels, IPv6, other protocols, odd header lengths."""
    first = [frame(e, k, 5) for e in range(6) for k in range(6)]
    out = first + [f[:n] for f in first[:12] for n in range(len(f))]
    six = bytes(12) + b"\x86\xdd" + bytes(6) + bytes((6, 0)) + bytes(32) + first[0][34:]
    icmp = first[3][:23] + b"\x01" + first[3][24:]
    inside = lambda number, body: bytes(12) + b"\x08\0" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, number, 0) + bytes((9, 9, 9, 9, 8, 8, 8, 8)) + body
    out += [six, icmp, inside(4, first[3][14:]), inside(41, six[14:]), inside(47, b"\0\0\x65\x58" + first[3]), inside(17, bytes((0, 53, 0, 53, 0, 8, 0, 0)) + b"query")]
    out += [first[3][:14] + bytes((0x40 | n,)) + first[3][15:] for n in range(16)] + [first[3][:46] + bytes((n << 4,)) + first[3][47:] for n in range(16)]
    return out


@pytest.mark.parametrize("full", [False, True])
def test_columns_equal_frames(full):
    data = capture([(10**15 + k, f) for k, f in enumerate(odd_frames())], "<")
    assert by_columns(data, full) == plain(data, full)
    assert by_columns(data, full, limit=50) == plain(data, full, 50)


payloads = st.one_of(st.binary(max_size=90), st.builds(lambda a, b: a + b, st.sampled_from([b"MSGF", b"HELF", b"OPNF", b"\x10", b"\x30", b"GET / ", b"HTTP/1.1 200 ", b"\x16\x03\x01", bytes(7), b"\0\0\0\x24\xffSMB", b"\0\7\1\0\0\1\0\0\0\0\0\0\1a\0\0\1\0\1"]), st.binary(max_size=60)))
ports = st.sampled_from([502, 1883, 8883, 4840, 443, 8443, 80, 8080, 53, 5353, 139, 445, 5, 40000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=120), st.builds(lambda p, s, d, n: bytes(12) + b"\x08\0\x45" + bytes(8) + bytes((n,)) + bytes(10) + struct.pack(">HHIIBBHHH", s, d, 1, 2, 5 << 4, 24, 0, 0, 0) + p, payloads, ports, ports, st.sampled_from([6, 6, 17, 47, 4]))), max_size=12), st.booleans())
def test_columns_equal_frames_on_any_input(frames, full):
    data = capture([(10**15 + k, f) for k, f in enumerate(frames)], "<")
    assert by_columns(data, full) == plain(data, full)


def test_only_what_is_wanted(monkeypatch):
    data = capture([(10**15 + k, frame(k, k % 100, k)) for k in range(300)], "<")
    everything = plain(data, False)
    called = []
    for name in ("modbus", "mqtt", "opcua", "http", "sni", "protocol_name"):
        monkeypatch.setattr(decode, name, lambda *a, f=getattr(decode, name), n=name: (called.append(n), f(*a))[1])
    some = by_columns(data, False, Wanted(frozenset(("src_ip", "dst_port", "size"))))
    assert [(r["src_ip"], r["dst_port"], r["size"]) for r in some] == [(r["src_ip"], r["dst_port"], r["size"]) for r in everything]
    assert all(v is None for r in some for c, v in r.items() if c not in ("src_ip", "dst_port", "size")) and not called
    some = by_columns(data, False, Wanted(frozenset(("modbus_function",))))
    assert [r["modbus_function"] for r in some] == [r["modbus_function"] for r in everything] and set(called) <= {"modbus"}
    del called[:]
    some = by_columns(data, False, Wanted(conditions=(("dst_port", "=", 502), ("ts_us", ">", 10**15 + 20), ("src_ip", "in", tuple({r["src_ip"] for r in everything[:250]})))))
    assert some == [r for r in everything if r["dst_port"] == 502 and r["ts_us"] > 10**15 + 20 and r["src_ip"] in {x["src_ip"] for x in everything[:250]}]
    assert some and set(called) <= {"modbus", "protocol_name"}
    assert by_columns(data, False, Wanted(ports=frozenset((1883,)))) == [r for r in everything if 1883 in (r["src_port"], r["dst_port"])]
    assert by_columns(data, False, Wanted(conditions=(("pcap_file", "=", "g"),))) == []


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("captures")
    for name, data in FILES.items():
        (at / f"{name} 1.pcap").write_bytes(data)
    (at / "z.pcapng").write_bytes(blocks())
    (at / "notes.txt").write_text("no capture")
    (at / "sub").mkdir()
    return at


def expected(folder, full=False, limit=None):
    return [str(r) for f in sorted(folder.iterdir()) if ".pcap" in f.name for r in pa.RecordBatch.from_pylist(list(pcap.packet_rows(f.name, f.read_bytes(), limit, full)), ARROW).to_pylist()]


@pytest.mark.parametrize("width", ["700b", "128m"])
def test_read_captures_in_splits(spark, folder, width):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        found = pcap.read_captures(spark, str(folder))
        assert sorted(map(str, found.toArrow().to_pylist())) == sorted(expected(folder))
        if width != "128m":
            assert pcap._bytes(spark, str(folder / "nested 1.pcap")).select("block").distinct().count() > 5
            limited = pcap.read_captures(spark, str(folder), limit=7, full=True)
            assert sorted(map(str, limited.toArrow().to_pylist())) == sorted(expected(folder, True, 7))
        some = pcap.read_captures(spark, str(folder), wanted=Wanted(frozenset(("packet_index", "dst_port")), (("dst_port", "=", 502),)))
        assert some.columns == ["packet_index", "dst_port"] and some.count() == found.where("dst_port = 502").count() > 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_filters_are_pushed(spark, folder):
    spark.dataSource.register(pcap.PcapSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        source = spark.read.format("pcap").option("path", str(folder)).option("pushdown", "true").option("columns", "dst_port,src_ip,pcap_file,size,modbus_function").load()
        found = source.where("dst_port = 502 and size > 80 and modbus_function is not null")
        kept = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line and "RuntimeFilters" not in line]
        assert len(kept) == 1 and "modbus_function" in kept[0] and "dst_port" not in kept[0] and "size" not in kept[0]
        whole = pcap.read_captures(spark, str(folder)).where("dst_port = 502 and size > 80 and modbus_function is not null")
        assert found.count() == whole.count() > 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_numbers_are_gathered_in_both_orders():
    buffer = np.frombuffer(bytes(range(20)), np.uint8)
    assert R.numbers(buffer, np.array([1, 5]), 2, ">").tolist() == [0x0102, 0x0506]
    assert R.numbers(buffer, np.array([1, 5]), 4, "<").tolist() == [0x04030201, 0x08070605]
    assert frame_columns._gather(buffer, np.array([2]), 6).tolist() == [0x020304050607]
