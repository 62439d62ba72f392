"""Packet bytes to columns: frames, HTTP, TLS, Modbus, MQTT and OPC UA.

Every decoder reads through a cursor that raises Short at the end of its data,
so truncated input gives what was complete before.
"""

from __future__ import annotations

import ipaddress
import socket
import json
import math
import struct
import uuid

from otflow import constants as C


class Short(Exception):
    """The data ended before the field did, or the field makes no sense."""


class Cursor:
    """Reads fields off a byte string; big is the byte order."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None, big: bool = True):
        self.data, self.at, self.end, self.order = data, at, len(data) if end is None else min(end, len(data)), ">" if big else "<"

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > self.end:
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str):
        return struct.unpack(self.order + code, self.take(struct.calcsize("=" + code)))[0]

    def u8(self) -> int:
        return self.take(1)[0]

    def u16(self) -> int:
        return self.number("H")

    def u32(self) -> int:
        return self.number("I")

    @property
    def left(self) -> int:
        return self.end - self.at


# Ports by which a packet's protocol is named, the destination's first.
PORT_PROTOCOLS = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 69: "TFTP", 80: "HTTP",
    110: "POP3", 123: "NTP", 135: "RPC", 139: "NetBIOS", 143: "IMAP", 161: "SNMP", 162: "SNMP-TRAP", 443: "HTTPS", 445: "SMB",
    502: "Modbus", 1433: "MSSQL", 1883: "MQTT", 3306: "MySQL", 3389: "RDP", 4840: "OPCUA", 8080: "HTTP", 8443: "HTTPS",
    8883: "MQTT", 44818: "EtherNet/IP",
}
HTTP_METHODS = (b"GET ", b"POST ", b"PUT ", b"DELETE ", b"HEAD ", b"OPTIONS ", b"PATCH ")


def frames(data: bytes, full: bool = False) -> list[dict]:
    """The IP packets of an Ethernet frame that carry TCP or UDP.

    The plain form follows one VLAN tag, IPv4 and GRE; full also IPv6, nested
    IP and other protocols (ports 0), and of several layers keeps the innermost.
    """
    try:
        at = Cursor(data)
        dst, src = at.take(6), at.take(6)
        kind = at.u16()
        if kind == 0x8100:
            at.u16()
            kind = at.u16()
        macs = {"src_mac": src.hex(":"), "dst_mac": dst.hex(":")}
        found = _ip(at, kind, 0, full)
    except Short:
        return []
    if full and found:
        depth = max(f["ip_layer_index"] for f in found) + 1
        found = [f for f in found if f["ip_layer_index"] == depth - 1]
        for f in found:
            f["ip_layer_count"] = depth
    return [f | macs | {"size": len(data)} for f in found if f["src_ip"] not in C.IGNORED_IPS and f["dst_ip"] not in C.IGNORED_IPS]


def _ip(at: Cursor, kind: int, layer: int, full: bool) -> list[dict]:
    if kind == 0x0800:
        head = at.at
        first = at.u8()
        if first >> 4 != 4:
            raise Short
        at.take(8)
        protocol = at.u8()
        at.take(2)
        src, dst = (socket.inet_ntoa(at.take(4)) for _ in range(2))
        at.at = head
        at.take(4 * (first & 15))
    elif kind == 0x86DD and full:
        at.take(6)
        protocol = at.u8()
        at.u8()
        src, dst = (str(ipaddress.IPv6Address(at.take(16))) for _ in range(2))
    else:
        return []
    row = {"src_ip": src, "dst_ip": dst, "ip_layer_index": layer, "ip_layer_count": layer + 1}
    if protocol == 47:
        return _gre(at, layer, full)
    if full and protocol in (4, 41):
        return _ip(at, 0x0800 if protocol == 4 else 0x86DD, layer + 1, full)
    if protocol == 6:
        head = at.at
        sp, dp, seq, ack = at.u16(), at.u16(), at.u32(), at.u32()
        size, bits = at.u8() >> 4, at.u8()
        at.at = head
        at.take(4 * size)
        flags = "".join(c for k, c in enumerate("FSRPAUEC") if bits >> k & 1)
        row |= {"protocol": "tcp", "src_port": sp, "dst_port": dp, "tcp_seq": seq, "tcp_ack": ack, "tcp_flags": flags}
    elif protocol == 17:
        row |= {"protocol": "udp", "src_port": at.u16(), "dst_port": at.u16(), "tcp_flags": ""}
        at.take(4)
    elif full:
        row |= {"protocol": "other", "src_port": 0, "dst_port": 0, "tcp_flags": ""}
    else:
        return []
    payload = at.data[at.at : at.end]
    return [row | {"payload": payload, "payload_len": len(payload)}]


def _gre(at: Cursor, layer: int, full: bool) -> list[dict]:
    flags, kind = at.u16(), at.u16()
    # Checksum with offset, key, sequence number: four bytes each where their bit is set.
    at.take(4 * sum(flags >> bit & 1 for bit in (15, 13, 12)))
    if kind == 0x6558:
        at.take(12)
        kind = at.u16()
    return _ip(at, kind, layer + 1, full)


def is_tls(payload: bytes) -> bool:
    return len(payload) >= 3 and 20 <= payload[0] <= 23 and payload[1] == 3 and payload[2] <= 3


def is_http(payload: bytes) -> bool:
    return payload.startswith((*HTTP_METHODS, b"HTTP/"))


def protocol_name(row: dict) -> str:
    """The application protocol by port, then by content."""
    payload, sp, dp = row["payload"], row["src_port"], row["dst_port"]
    for port in (dp, sp):
        if name := PORT_PROTOCOLS.get(port):
            return "HTTPS" if name == "HTTP" and is_tls(payload) else name
    if row["protocol"] == "tcp" and payload:
        if mqtt(payload, sp, dp).get("mqtt_packet_type_code") is not None:
            return "MQTT"
        if opcua_is_certain(payload):
            return "OPCUA"
        if is_http(payload):
            return "HTTP"
        if is_tls(payload):
            return "TLS"
    return row["protocol"].upper()


def dns_name(data: bytes, at: int) -> tuple[str, int]:
    """A name of a DNS message and the place after it; pointers lead to earlier places only, so none goes in circles."""
    labels, after, least = [], None, at
    while True:
        if at >= len(data):
            raise Short
        size = data[at]
        if size >= 0xC0:
            if at + 2 > len(data):
                raise Short
            to = (size & 0x3F) << 8 | data[at + 1]
            if to >= least:
                raise Short
            after, at, least = after or at + 2, to, to
        elif size >= 0x40 or at + 1 + size > len(data):
            raise Short
        elif not size:
            return ".".join(labels), after or at + 1
        else:
            labels.append(data[at + 1 : at + 1 + size].decode("latin-1"))
            at += 1 + size


def dns_message(payload: bytes) -> dict | None:
    """A DNS message: id, response, operation, code, questions (name, type) and answers (name, type); None if it is none.

    All four sections have to be there; what a datagram cuts off doesn't count
    as a message unless the header says so.
    """
    try:
        at = Cursor(payload)
        ident, flags, *counts = (at.u16() for _ in range(6))
        out: dict = {"id": ident, "response": bool(flags >> 15), "operation": flags >> 11 & 15, "code": flags & 15, "questions": [], "answers": []}
        for _ in range(counts[0]):
            name, at.at = dns_name(payload, at.at)
            out["questions"].append((name, at.u16()))
            at.take(2)
        for k in range(sum(counts[1:])):
            name, at.at = dns_name(payload, at.at)
            kind = at.u16()
            at.take(6)
            at.take(at.u16())
            if k < counts[1]:
                out["answers"].append((name, kind))
    except Short:
        return out if len(payload) >= 12 and flags >> 9 & 1 else None
    return out if sum(counts) else None


#: Packet types of the NetBIOS session service.
NETBIOS_TYPES = (0x00, 0x81, 0x82, 0x83, 0x84, 0x85)


def netbios_session(payload: bytes) -> tuple[int, bytes] | None:
    """Type and body of a NetBIOS session packet, as far as the segment holds it; None if it is none."""
    if len(payload) < 4 or payload[0] not in NETBIOS_TYPES or payload[1] > 1:
        return None
    size = (payload[1] & 1) << 16 | int.from_bytes(payload[2:4], "big")
    return payload[0], payload[4 : 4 + size]


def smb_command(body: bytes) -> int | None:
    """The command of an SMB header of the first version; None if there is none. Later versions begin otherwise."""
    return body[4] if len(body) >= 32 and body[:4] == b"\xffSMB" else None


def full_protocol_name(row: dict) -> str:
    """The application protocol as the full backend tells it: by its message, then by port, the source's first, then by content."""
    payload, sp, dp, tcp = row["payload"], row["src_port"], row["dst_port"], row["protocol"] == "tcp"
    ports = {sp, dp}
    if (53 in ports and dns_message(payload[2:] if tcp else payload)) or (ports == {5353} and not tcp and dns_message(payload)):
        return "DNS"
    http = tcp and (payload.startswith(HTTP_METHODS[:-1]) or any(v in payload[:32] for v in (b"HTTP/1.", b"HTTP/2.")))
    if http and ports & {80, 8080}:
        return "HTTP"
    if tcp and ports & {139, 445} and (session := netbios_session(payload)):
        return "NetBIOS" if smb_command(session[1]) is None else "SMB"
    tls = tcp and len(payload) > 5 and is_tls(payload)
    for port in (sp, dp):
        if name := PORT_PROTOCOLS.get(port):
            return "HTTPS" if name == "HTTP" and tls else name
    if tcp and payload:
        if mqtt(payload, sp, dp).get("mqtt_packet_type_code") is not None:
            return "MQTT"
        if opcua_is_certain(payload):
            return "OPCUA"
        if http:
            return "HTTP"
        if tls:
            return "TLS"
    return row["protocol"].upper()


def details(row: dict, full: bool = False) -> dict:
    """The columns of the one protocol that a packet's ports or content tell, and that protocol's name."""
    out: dict = {"high_level_protocol": full_protocol_name(row) if full else protocol_name(row)}
    if row["protocol"] != "tcp" or not row["payload"]:
        return out
    return out | content(row["payload"], row["src_port"], row["dst_port"])


def content(payload: bytes, src_port: int, dst_port: int) -> dict:
    """The columns that the content of a TCP packet tells."""
    ports = (src_port, dst_port)
    if C.MODBUS_PORT in ports:
        return modbus(payload, dst_port == C.MODBUS_PORT)
    if found := mqtt(payload, *ports):
        return found
    if set(ports) & set(C.MQTT_PORTS):
        return {}
    if C.OPCUA_PORT in ports or opcua_is_certain(payload):
        return opcua(payload)
    if is_http(payload):
        return http(payload)
    if {443, 8443} & set(ports):
        return {"tls_sni": sni(payload)}
    return {}


def http(payload: bytes) -> dict:
    """Method and path or status of the first line; host and content type of the next KiB, in lower case."""
    if len(payload) < 10:
        return {}
    line, _, rest = payload.partition(b"\r\n") if b"\r\n" in payload else payload.partition(b"\n") if b"\n" in payload else (payload[:256], b"", b"")
    first = line.decode("utf-8", "ignore").split(" ", 2)
    out: dict = {}
    if line.startswith(HTTP_METHODS):
        out = {"http_method": first[0], "http_path": first[1]}
    elif line.startswith(b"HTTP/") and len(first) > 1:
        out = {"http_status": int(first[1]) if first[1].isdigit() else None}
    for header in rest[:1024].decode("utf-8", "ignore").lower().split("\r\n"):
        name, _, value = header.partition(":")
        if name in ("host", "content-type"):
            out["http_host" if name == "host" else "http_content_type"] = value.strip()
    return out


def sni(payload: bytes) -> str | None:
    """The first host name of a ClientHello's server_name extension."""
    try:
        at = Cursor(payload)
        if at.u8() != 22:
            return None
        at.take(4)
        if at.u8() != 1:
            return None
        at.take(3 + 2 + 32)
        at.take(at.u8())
        at.take(at.u16())
        at.take(at.u8())
        at.u16()
        while at.left >= 4:
            kind, body = at.u16(), Cursor(at.take(at.u16()))
            if kind == 0:
                body.u16()
                while body.left >= 3:
                    name_kind, name = body.u8(), body.take(body.u16())
                    if name_kind == 0:
                        return name.decode("utf-8", "ignore") or None
    except Short:
        pass
    return None


def _bits(data: bytes, n: int) -> list[int]:
    return [data[k // 8] >> k % 8 & 1 for k in range(min(n, 8 * len(data)))]


def _words(data: bytes) -> list[int]:
    return list(struct.unpack(f">{len(data) // 2}H", data[: len(data) // 2 * 2]))


def modbus(payload: bytes, request: bool) -> dict:
    """Transaction, unit, function, addresses and values of a Modbus/TCP unit."""
    if len(payload) < 8:
        return {}
    reads: list[int] = []
    writes: list[int] = []
    values: list[int] = []
    at = Cursor(payload)
    txid = at.u16()
    at.take(4)
    unit, function = at.u8(), at.u8()
    span = lambda start, n: list(range(start, start + min(n, 512)))
    try:
        if function in (5, 6):
            writes, raw = [at.u16()], at.u16()
            values = [int(raw == 0xFF00)] if function == 5 else [raw]
        elif request and function in (1, 2, 3, 4):
            reads = span(at.u16(), at.u16())
        elif request and function in (15, 16):
            writes = span(at.u16(), at.u16())
            data = at.take(at.u8())
            values = (_bits(data, len(writes)) if function == 15 else _words(data))[: len(writes)]
        elif request and function == 23:
            reads = span(at.u16(), at.u16())
            writes = span(at.u16(), at.u16())
            values = _words(at.take(at.u8()))[: len(writes)]
        elif function in (1, 2):
            data = at.take(at.u8())
            values = _bits(data, 8 * len(data))
        elif function in (3, 4, 23):
            values = _words(at.take(at.u8()))
        elif function in (15, 16):
            writes = span(at.u16(), at.u16())
    except Short:
        pass
    return {
        "modbus_function": function,
        "modbus_unit_id": unit,
        "modbus_transaction_id": txid,
        "modbus_registers": list(dict.fromkeys(reads + writes)),
        "modbus_read_registers": reads,
        "modbus_write_registers": writes,
        "modbus_register_values": values,
    }


MQTT_TYPES = ("CONNECT", "CONNACK", "PUBLISH", "PUBACK", "PUBREC", "PUBREL", "PUBCOMP", "SUBSCRIBE", "SUBACK", "UNSUBSCRIBE", "UNSUBACK", "PINGREQ", "PINGRESP", "DISCONNECT", "AUTH")


def _mqtt_length(at: Cursor) -> int:
    value = 0
    for k in range(4):
        byte = at.u8()
        value |= (byte & 127) << 7 * k
        if byte < 128:
            return value
    raise Short


def _mqtt_text(at: Cursor) -> str | None:
    """A text of at most 1024 characters, 95 % of them printable and none a control; else null."""
    try:
        text = at.take(at.u16()).decode("utf-8").strip()
    except UnicodeDecodeError as e:
        raise Short from e
    if not text or len(text) > 1024 or any(ord(c) < 32 or ord(c) == 127 for c in text):
        return None
    return text if sum(c.isprintable() for c in text) >= 0.95 * len(text) else None


def mqtt(payload: bytes, src_port: int, dst_port: int) -> dict:
    """The fields of one control packet; off the broker's ports only of a CONNECT. Empty where it is none."""
    try:
        at = Cursor(payload)
        first = at.u8()
        code, flags = first >> 4, first & 15
        if code == 0 or (code != 3 and flags != (2 if code in (6, 8, 10) else 0)) or (code == 3 and flags >> 1 & 3 == 3):
            return {}
        size = _mqtt_length(at)
        if size > at.left:
            return {}
        at.end = at.at + size
        out: dict = {"mqtt_packet_type_code": code, "mqtt_packet_type": MQTT_TYPES[code - 1]}
        if code == 1:
            name = at.take(at.u16())
            level, connect = at.u8(), at.u8()
            out["mqtt_keepalive"] = at.u16()
            if connect & 1 or (name, level) not in ((b"MQTT", 4), (b"MQTT", 5), (b"MQIsdp", 3)):
                return {}
            out["mqtt_client_id"] = _mqtt_text(at) if at.left >= 2 else None
        elif code == 3:
            out |= {"mqtt_qos": flags >> 1 & 3, "mqtt_retain": bool(flags & 1), "mqtt_dup": bool(flags & 8), "mqtt_topic": _mqtt_text(at)}
            if out["mqtt_topic"] is None:
                return {}
            if out["mqtt_qos"] and at.left >= 2:
                out["mqtt_packet_id"] = at.u16()
            out |= {"mqtt_payload_size": at.left, "mqtt_payload_values": mqtt_values(at.take(at.left))}
        elif code in (8, 10):
            out |= {"mqtt_dup": False, "mqtt_packet_id": at.u16(), "mqtt_topic": _mqtt_text(at)}
            if out["mqtt_topic"] is None:
                return {}
            if code == 8 and at.left:
                out["mqtt_qos"] = at.u8() & 3
        elif code in (4, 5, 6, 7, 9, 11) and at.left >= 2:
            out["mqtt_packet_id"] = at.u16()
    except Short:
        return {}
    return out if code == 1 or {src_port, dst_port} & set(C.MQTT_PORTS) else {}


def mqtt_values(payload: bytes) -> list[dict]:
    """The numbers of a message of up to 4 KiB: a bare number as 'value', or the numeric fields of a JSON object."""
    if not 0 < len(payload) <= 4096:
        return []
    try:
        text = payload.decode("utf-8").strip()
    except UnicodeDecodeError:
        return []
    try:
        found = {"value": float(text)}
    except ValueError:
        try:
            parsed = json.loads(text)
        except ValueError:
            return []
        found = parsed if isinstance(parsed, dict) else {}
    numbers = {k: float(v) for k, v in found.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
    return [{"name": k, "value": v} for k, v in numbers.items() if math.isfinite(v)]


UA_SERVICES = {527: "BrowseRequest", 530: "BrowseResponse", 631: "ReadRequest", 634: "ReadResponse", 673: "WriteRequest", 676: "WriteResponse"}
UA_OPERATIONS = {"ReadRequest": "read", "WriteRequest": "write"}
#: struct codes of the built-in types 1 to 11.
UA_NUMBERS = "?bBhHiIqQfd"
UA_MOST = 8192


class Ua(Cursor):
    """OPC UA binary encoding."""

    def __init__(self, data: bytes, at: int, end: int):
        super().__init__(data, at, end, big=False)

    def text(self) -> str | None:
        raw = self.binary()
        return None if raw is None else raw.decode("utf-8", "replace")

    def binary(self) -> bytes | None:
        n = self.number("i")
        return None if n < 0 else self.take(n)

    def node_id(self) -> str:
        kind = self.u8()
        form = kind & 0x3F
        if form == 0:
            out = f"ns=0;i={self.u8()}"
        elif form == 1:
            out = f"ns={self.u8()};i={self.u16()}"
        elif form == 2:
            out = f"ns={self.u16()};i={self.u32()}"
        elif form == 3:
            out = f"ns={self.u16()};s={self.text() or ''}"
        elif form == 4:
            out = f"ns={self.u16()};g={uuid.UUID(bytes_le=self.take(16))}"
        elif form == 5:
            out = f"ns={self.u16()};b={(self.binary() or b'').hex()}"
        else:
            raise Short
        if kind & 0x80:
            self.text()
        if kind & 0x40:
            self.u32()
        return out

    def extension(self) -> None:
        self.node_id()
        if self.u8():
            self.binary()

    def request_header(self) -> None:
        self.node_id()
        self.take(8 + 4 + 4)
        self.text()
        self.u32()
        self.extension()

    def diagnostic(self, depth: int = 0) -> None:
        mask = self.u8()
        self.take(4 * sum(mask >> k & 1 for k in range(4)))
        if mask & 0x10:
            self.text()
        if mask & 0x20:
            self.u32()
        if mask & 0x40 and depth < 8:
            self.diagnostic(depth + 1)

    def response_header(self) -> None:
        self.take(8 + 4 + 4)
        self.diagnostic()
        for _ in range(max(0, min(self.number("i"), UA_MOST))):
            self.text()
        self.extension()

    def variant(self) -> float | None:
        mask = self.u8()
        kind = mask & 0x3F
        many = self.number("i") if mask & 0x80 else None
        value = None
        for _ in range(1 if many is None else max(0, min(many, UA_MOST))):
            value = self._scalar(kind)
        if mask & 0x40:
            self.take(4 * max(0, self.number("i")))
        return value if many is None else None

    def _scalar(self, kind: int) -> float | None:
        if kind == 0:
            return None
        if kind <= 11:
            return float(self.number(UA_NUMBERS[kind - 1]))
        if kind in (12, 15, 16):
            self.binary()
        elif kind == 13:
            self.take(8)
        elif kind == 14:
            self.take(16)
        elif kind in (17, 18):
            self.node_id()
        elif kind == 19:
            self.u32()
        elif kind == 20:
            self.u16()
            self.text()
        elif kind == 21:
            mask = self.u8()
            for bit in (1, 2):
                if mask & bit:
                    self.text()
        elif kind == 22:
            self.extension()
        else:
            raise Short
        return None

    def data_value(self) -> float | None:
        """The value; bits 1, 2, 4, 8 of the mask are value, status, source and server time, 16 and 32 their picoseconds."""
        mask = self.u8()
        value = self.variant() if mask & 1 else None
        self.take(4 * (mask >> 1 & 1))
        self.take(8 * (mask >> 2 & 1))
        self.take(2 * (mask >> 4 & 1))
        self.take(8 * (mask >> 3 & 1))
        self.take(2 * (mask >> 5 & 1))
        return value


def opcua(payload: bytes) -> dict:
    """Message fields, and node ids and values of read and write services. Empty where it is no such message."""
    kind, chunk = payload[:3].decode("latin-1"), payload[3:4].decode("latin-1")
    if len(payload) < 8 or kind not in ("HEL", "ACK", "ERR", "RHE", "OPN", "MSG", "CLO") or chunk not in ("F", "C", "A"):
        return {}
    size = int.from_bytes(payload[4:8], "little")
    if not 8 <= size <= 64 << 20:
        return {}
    out: dict = {"opcua_message_type": kind, "opcua_chunk_type": chunk, "opcua_message_size": size}
    at = Ua(payload, 8, size)
    try:
        if kind in ("OPN", "MSG", "CLO"):
            out["opcua_secure_channel_id"] = at.u32()
        if kind == "HEL":
            at.take(20)
            out["opcua_endpoint_url"] = at.text()
        elif kind == "OPN":
            out["opcua_security_policy_uri"] = at.text()
        elif kind == "MSG" and chunk == "F":
            at.take(8)
            out["opcua_request_id"] = at.u32()
            service = at.node_id()
            name = UA_SERVICES.get(int(service[7:])) if service.startswith("ns=0;i=") else None
            out |= {"opcua_service_type": name, "opcua_operation": UA_OPERATIONS.get(name or "")}
            out |= _ua_service(at, name)
    except Short:
        pass
    return out


def _ua_service(at: Ua, name: str | None) -> dict:
    """Node ids in first-seen order, of repeated ones the last value; what was complete before the data ended."""
    nodes: dict[str, float | None] = {}
    values: list[float | None] = []
    try:
        if name == "ReadRequest":
            at.request_header()
            at.take(12)
            for _ in range(min(at.number("i"), UA_MOST)):
                nodes.setdefault(at.node_id())
                at.u32()
                at.text()
                at.u16()
                at.text()
        elif name == "WriteRequest":
            at.request_header()
            for _ in range(min(at.number("i"), UA_MOST)):
                node = at.node_id()
                nodes.setdefault(node)
                at.u32()
                at.text()
                nodes[node] = at.data_value()
        elif name == "ReadResponse":
            at.response_header()
            for _ in range(min(at.number("i"), UA_MOST)):
                values.append(at.data_value())
    except Short:
        pass
    return {"opcua_node_ids": list(nodes), "opcua_values": list(nodes.values()) if name == "WriteRequest" else values}


def opcua_is_certain(payload: bytes) -> bool:
    """Whether a whole frame tells by its content alone: a HEL with an opc.tcp URL or an OPN with a policy URI."""
    found = opcua(payload)
    if not found or len(payload) < found["opcua_message_size"]:
        return False
    url, policy = found.get("opcua_endpoint_url") or "", found.get("opcua_security_policy_uri") or ""
    return url.lower().startswith("opc.tcp://") or "securitypolicy" in policy.lower()
