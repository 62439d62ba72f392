"""Frames to columns, many at a time: header fields are gathered from the whole buffer, contents decoded only where they are asked for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from otflow import constants as C
from otflow.functions import decode

#: Columns that the headers tell; the others come from contents.
HEADER = (
    "pcap_file", "packet_index", "ts_us", "size", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "high_level_protocol", "ip_layer_index", "ip_layer_count",
    "src_mac", "dst_mac", "tcp_flags", "tcp_seq", "tcp_ack", "payload_len",
)
#: Columns that decide about a frame before its contents are looked at.
DECIDING = tuple(c for c in HEADER if c not in ("high_level_protocol", "tcp_seq", "tcp_ack"))
OPERATIONS = {"=": pc.equal, "<": pc.less, "<=": pc.less_equal, ">": pc.greater, ">=": pc.greater_equal}

_TCP, _UDP, _OTHER = 1, 2, 3
_PROTOCOLS = np.array(["", "tcp", "udp", "other"], object)
_FLAGS = np.array(["".join(c for k, c in enumerate("FSRPAUEC") if bits >> k & 1) for bits in range(256)], object)
_NAMES = np.array(["", *sorted(set(decode.PORT_PROTOCOLS.values()))], object)
_BY_PORT = np.zeros(65536, np.uint8)
for _port, _name in decode.PORT_PROTOCOLS.items():
    _BY_PORT[_port] = np.flatnonzero(_NAMES == _name)[0]
#: Ports whose messages the full backend reads.
_TELLING = (53, 80, 139, 445, 5353, 8080)
_HTTP = int(np.flatnonzero(_NAMES == "HTTP")[0])
#: First bytes by which contents may tell their protocol off its ports: MQTT's CONNECT, OPC UA's HEL and OPN, HTTP, TLS.
_FIRST_UA = np.isin(np.arange(256), list(b"HO"))
_FIRST_HTTP = np.isin(np.arange(256), [m[0] for m in (*decode.HTTP_METHODS, b"HTTP/")])
_FIRST_MQTT = np.arange(256) == 0x10
_FIRST_TLS = np.isin(np.arange(256), [20, 21, 22, 23])


@dataclass(frozen=True)
class Wanted:
    """What a reader asks for: columns (None: all), and conditions (column of DECIDING, operation, value) that all hold.

    Operations: those of OPERATIONS, and 'in' with a tuple. ports: one of them
    is at either end; None: any.
    """

    columns: frozenset[str] | None = None
    conditions: tuple[tuple[str, str, object], ...] = ()
    ports: frozenset[int] | None = None

    def has(self, *prefixes: str) -> bool:
        return self.columns is None or any(c.startswith(prefixes) for c in self.columns)


def _gather(buffer: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Big-endian numbers of a width of bytes at places of a buffer."""
    out = np.zeros(len(at), np.int64)
    for k in range(width):
        out = out << 8 | buffer[at + k]
    return out


def _named(values: np.ndarray, text) -> np.ndarray:
    """Texts of numbers, made once for each distinct one."""
    distinct, at = np.unique(values, return_inverse=True)
    return np.array([text(int(v)) for v in distinct], object)[at] if len(distinct) else np.zeros(0, object)


def _ip(v: int) -> str:
    return f"{v >> 24}.{v >> 16 & 255}.{v >> 8 & 255}.{v & 255}"


def _mac(v: int) -> str:
    return v.to_bytes(6, "big").hex(":")


def table(name: str, data: bytes, starts: np.ndarray, sizes: np.ndarray, times: np.ndarray, first: int, schema: pa.Schema, full: bool = False, wanted: Wanted = Wanted()) -> pa.RecordBatch:  # noqa: B008
    """The packets of frames in a buffer, in the columns of schema; those that aren't wanted are null.

    first: number of the first frame. The result equals decode.frames and
    decode.details frame by frame. Ethernet with or without a VLAN tag, IPv4,
    TCP and UDP are read by places; tunnels and what else only the full backend
    knows go to decode.frames.
    """
    # Places past the end of a frame are read as zeros and told apart by their bounds.
    buffer = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(64, np.uint8)])
    limit = len(buffer) - 1
    read = lambda at, width: _gather(buffer, np.minimum(at, limit - width), width)
    end = starts + sizes
    kind = np.where(sizes >= 14, read(starts + 12, 2), 0)
    tagged = kind == 0x8100
    kind = np.where(tagged, np.where(sizes >= 18, read(starts + 16, 2), 0), kind)
    ip = starts + np.where(tagged, 18, 14)
    v4 = (kind == 0x0800) & (ip + 20 <= end)
    head = read(ip, 1)
    transport = ip + 4 * (head & 15)
    v4 &= (head >> 4 == 4) & (transport <= end)
    number = np.where(v4, read(ip + 9, 1), -1)
    bits = 4 * (read(transport + 12, 1) >> 4)
    tcp = (number == 6) & (transport + 14 <= end) & (transport + bits <= end)
    udp = (number == 17) & (transport + 8 <= end)
    plain = tcp | udp
    # What needs a closer look, frame by frame.
    closer = (number == 47) | (full & (((kind == 0x86DD) & (sizes > 14)) | (v4 & ~plain & (number != 6) & (number != 17))))
    rows = np.flatnonzero(plain | closer)
    n = len(rows)
    cut = lambda x: x[rows]
    starts_, end_, tcp_, ip_, transport_ = map(cut, (starts, end, tcp, ip, transport))
    code = np.where(tcp_, _TCP, _UDP)
    columns: dict[str, np.ndarray] = {
        "packet_index": first + rows,
        "ts_us": cut(times),
        "size": cut(sizes),
        "src_ip": _named(read(ip_ + 12, 4), _ip),
        "dst_ip": _named(read(ip_ + 16, 4), _ip),
        "src_port": read(transport_, 2),
        "dst_port": read(transport_ + 2, 2),
        "ip_layer_index": np.zeros(n, np.int64),
        "ip_layer_count": np.ones(n, np.int64),
        "tcp_flags": np.where(tcp_, _FLAGS[read(transport_ + 13, 1)], ""),
        "tcp_seq": read(transport_ + 4, 4),
        "tcp_ack": read(transport_ + 8, 4),
    }
    payload = transport_ + np.where(tcp_, cut(bits), 8)
    size = end_ - payload
    kept = np.ones(n, bool)
    contents: dict[int, bytes] = {}
    for k in np.flatnonzero(cut(closer)).tolist():
        found = decode.frames(data[starts_[k] : end_[k]], full)
        kept[k] = bool(found)
        for row in found:
            contents[k] = row["payload"]
            code[k], size[k] = {"tcp": _TCP, "udp": _UDP}.get(row["protocol"], _OTHER), row["payload_len"]
            for c in ("src_ip", "dst_ip", "src_port", "dst_port", "ip_layer_index", "ip_layer_count", "tcp_flags"):
                columns[c][k] = row[c]
            for c in ("tcp_seq", "tcp_ack"):
                columns[c][k] = row.get(c, 0)
    columns |= {"protocol": _PROTOCOLS[code], "payload_len": size}
    for c in ("src_ip", "dst_ip"):
        kept &= ~np.isin(columns[c].astype("U"), list(C.IGNORED_IPS)) if n else kept
    if wanted.has("src_mac", "dst_mac") or any(c.endswith("_mac") for c, _, _ in wanted.conditions):
        columns |= {"dst_mac": _named(read(starts_, 6), _mac), "src_mac": _named(read(starts_ + 6, 6), _mac)}
    kept &= _decided(columns, name, n, wanted)
    at = np.flatnonzero(kept)
    columns = {c: v[at] for c, v in columns.items()}
    contents = {int(np.searchsorted(at, k)): v for k, v in contents.items() if kept[k]}
    payload, size, code = payload[at], size[at], code[at]
    inner = np.zeros(len(at), bool)
    inner[list(contents)] = True
    first_byte = np.where(inner, 0, buffer[np.minimum(payload, limit)]).astype(np.int64)
    for k, content in contents.items():
        first_byte[k] = content[0] if content else 0
    part = lambda k: contents[k] if k in contents else data[payload[k] : payload[k] + size[k]]
    if wanted.has("high_level_protocol"):
        columns["high_level_protocol"] = (_full_protocols if full else _protocols)(columns, code, size, first_byte, part)
    return _batch(name, len(at), columns, code, _details(columns, code, size, first_byte, part, wanted), schema, wanted)


def _decided(columns: dict[str, np.ndarray], name: str, n: int, wanted: Wanted) -> np.ndarray:
    """Which frames meet the conditions."""
    kept = np.ones(n, bool)
    if wanted.ports is not None:
        ports = list(wanted.ports)
        kept &= np.isin(columns["src_port"], ports) | np.isin(columns["dst_port"], ports)
    for column, operation, value in wanted.conditions:
        have = pa.array([name] * n) if column == "pcap_file" else pa.array(columns[column])
        if operation == "in":
            held = pc.is_in(have, pa.array(list(value), have.type))
        else:
            held = OPERATIONS[operation](have, pa.scalar(value))
        kept &= held.to_numpy(zero_copy_only=False).astype(bool)
    return kept


def _protocols(columns: dict[str, np.ndarray], code: np.ndarray, size: np.ndarray, first_byte: np.ndarray, part) -> np.ndarray:
    """decode.protocol_name of each row; contents are looked at where ports don't tell."""
    sp, dp = columns["src_port"].astype(np.int64), columns["dst_port"].astype(np.int64)
    by_port = np.where(_BY_PORT[dp] > 0, _BY_PORT[dp], _BY_PORT[sp])
    out = np.where(by_port > 0, _NAMES[by_port], np.array(["", "TCP", "UDP", "OTHER"], object)[code])
    tls = (by_port == _HTTP) & (size > 2) & _FIRST_TLS[first_byte]
    may = (by_port == 0) & (code == _TCP) & (size > 0) & (_FIRST_UA | _FIRST_HTTP | _FIRST_MQTT | _FIRST_TLS)[first_byte]
    for k in np.flatnonzero(tls | may).tolist():
        out[k] = decode.protocol_name({"payload": part(k), "src_port": int(sp[k]), "dst_port": int(dp[k]), "protocol": "tcp" if code[k] == _TCP else "udp"})
    return out


def _full_protocols(columns: dict[str, np.ndarray], code: np.ndarray, size: np.ndarray, first_byte: np.ndarray, part) -> np.ndarray:
    """decode.full_protocol_name of each row; contents are looked at where they may tell more than ports, or ports tell nothing."""
    sp, dp = columns["src_port"].astype(np.int64), columns["dst_port"].astype(np.int64)
    by_port = np.where(_BY_PORT[sp] > 0, _BY_PORT[sp], _BY_PORT[dp])
    out = np.where(by_port > 0, _NAMES[by_port], np.array(["", "TCP", "UDP", "OTHER"], object)[code])
    closer = np.isin(sp, _TELLING) | np.isin(dp, _TELLING) | ((by_port == 0) & (code == _TCP))
    for k in np.flatnonzero(closer & (size > 0)).tolist():
        out[k] = decode.full_protocol_name({"payload": part(k), "src_port": int(sp[k]), "dst_port": int(dp[k]), "protocol": str(_PROTOCOLS[code[k]])})
    return out


def _details(columns: dict[str, np.ndarray], code: np.ndarray, size: np.ndarray, first_byte: np.ndarray, part, wanted: Wanted) -> dict[str, dict[int, object]]:
    """Columns of contents: of each its values by row. Only contents that may give a wanted column are decoded."""
    sp, dp = columns["src_port"].astype(np.int64), columns["dst_port"].astype(np.int64)
    has = lambda *ports: np.isin(sp, ports) | np.isin(dp, ports)
    may = np.zeros(len(code), bool)
    if wanted.has("modbus_"):
        may |= has(C.MODBUS_PORT)
    if wanted.has("mqtt_"):
        may |= has(*C.MQTT_PORTS) | _FIRST_MQTT[first_byte]
    if wanted.has("opcua_"):
        may |= has(C.OPCUA_PORT) | _FIRST_UA[first_byte]
    if wanted.has("http_"):
        may |= _FIRST_HTTP[first_byte]
    if wanted.has("tls_"):
        may |= has(443, 8443)
    out: dict[str, dict[int, object]] = {}
    for k in np.flatnonzero(may & (code == _TCP) & (size > 0)).tolist():
        for c, v in decode.content(part(k), int(sp[k]), int(dp[k])).items():
            out.setdefault(c, {})[k] = v
    return out


def _batch(name: str, n: int, columns: dict[str, np.ndarray], code: np.ndarray, details: dict[str, dict[int, object]], schema: pa.Schema, wanted: Wanted) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        if wanted.columns is not None and field.name not in wanted.columns:
            arrays.append(pa.nulls(n, field.type))
        elif field.name == "pcap_file":
            arrays.append(pa.array([name], field.type).take(pa.array(np.zeros(n, np.int64))))
        elif field.name in ("tcp_seq", "tcp_ack"):
            arrays.append(pa.array(columns[field.name], field.type, mask=code != _TCP))
        elif field.name in columns:
            arrays.append(pa.array(columns[field.name], field.type))
        elif field.name in details:
            values = [None] * n
            for k, v in details[field.name].items():
                values[k] = v
            arrays.append(pa.array(values, field.type))
        else:
            arrays.append(pa.nulls(n, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def conditions_of(filters: Iterable) -> tuple[list[tuple[str, str, object]], list]:
    """Spark's pushed filters as conditions, and those that can't be told as such."""
    signs = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "In": "in"}
    told, left = [], []
    for f in filters:
        kind, column = type(f).__name__, getattr(f, "attribute", ())
        if len(column) != 1 or column[0] not in DECIDING or getattr(f, "value", 0) is None:
            left.append(f)
        elif kind == "IsNotNull":
            continue  # these columns have no nulls
        elif kind in signs:
            told.append((column[0], signs[kind], tuple(f.value) if kind == "In" else f.value))
        else:
            left.append(f)
    return told, left
