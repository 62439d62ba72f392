"""Decoders on frames that are built here byte by byte."""

import struct

import pytest

from otflow.functions import decode


def tcp(sp, dp, payload=b"", seq=1, ack=2, flags=0x18):
    return struct.pack(">HHIIBBHHH", sp, dp, seq, ack, 5 << 4, flags, 0, 0, 0) + payload


def ip4(src, dst, protocol, body):
    address = lambda a: bytes(map(int, a.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, 0, 64, protocol, 0) + address(src) + address(dst) + body


def ether(kind, body, vlan=False):
    tag = struct.pack(">HH", 0x8100, 7) if vlan else b""
    return bytes(range(6)) + bytes(range(16, 22)) + tag + struct.pack(">H", kind) + body


def ua_string(text):
    return struct.pack("<i", len(text)) + text.encode()


def test_plain_frame():
    (row,) = decode.frames(ether(0x0800, ip4("10.0.0.1", "10.0.0.2", 6, tcp(40000, 80, b"GET /monitor HTTP/1.1\r\nHost: H1\r\n\r\n"))))
    assert (row["src_ip"], row["dst_port"], row["tcp_flags"], row["tcp_seq"]) == ("10.0.0.1", 80, "PA", 1)
    assert row["src_mac"] == "10:11:12:13:14:15" and row["dst_mac"] == "00:01:02:03:04:05"
    found = decode.details(row)
    assert found["http_method"] == "GET" and found["http_path"] == "/monitor" and found["http_host"] == "h1" and found["high_level_protocol"] == "HTTP"


def test_vlan_and_udp():
    (row,) = decode.frames(ether(0x0800, ip4("10.0.0.1", "10.0.0.2", 17, struct.pack(">HHHH", 5, 53, 8, 0) + b"x"), vlan=True))
    assert row["protocol"] == "udp" and row["dst_port"] == 53 and row["payload_len"] == 1


@pytest.mark.parametrize("flags,extra", [(0, b""), (0x2000, b"\0" * 4), (0xB000, b"\0" * 12)])
def test_gre(flags, extra):
    inner = ip4("1.1.1.1", "2.2.2.2", 6, tcp(1, 502))
    (row,) = decode.frames(ether(0x0800, ip4("10.0.0.1", "10.0.0.2", 47, struct.pack(">HH", flags, 0x0800) + extra + inner)))
    assert row["src_ip"] == "1.1.1.1" and (row["ip_layer_index"], row["ip_layer_count"]) == (1, 2)


def test_gre_bridged_and_ipv6():
    inner = ether(0x0800, ip4("1.1.1.1", "2.2.2.2", 6, tcp(1, 502)))
    (row,) = decode.frames(ether(0x0800, ip4("10.0.0.1", "10.0.0.2", 47, struct.pack(">HH", 0, 0x6558) + inner)))
    assert row["dst_port"] == 502
    six = struct.pack(">IHBB", 6 << 28, 20, 6, 64) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2" + tcp(5, 6)
    assert decode.frames(ether(0x86DD, six)) == []
    (row,) = decode.frames(ether(0x86DD, six), full=True)
    assert row["src_ip"] == "::1" and row["src_port"] == 5


def test_truncated_and_ignored_frames():
    whole = ether(0x0800, ip4("10.0.0.1", "10.0.0.2", 6, tcp(1, 2)))
    assert all(decode.frames(whole[:n]) == [] for n in range(len(whole)))
    assert decode.frames(ether(0x0800, ip4("172.16.142.250", "10.0.0.2", 6, tcp(1, 2)))) == []
    assert decode.frames(ether(0x0806, b"x" * 40)) == []


def modbus_unit(function, body, txid=7, unit=3):
    return struct.pack(">HHHBB", txid, 0, 2 + len(body), unit, function) + body


@pytest.mark.parametrize(
    "function,body,request_,registers,values",
    [
        (1, struct.pack(">HH", 10, 3), True, [10, 11, 12], []),
        (3, struct.pack(">HH", 10, 2), True, [10, 11], []),
        (5, struct.pack(">HH", 4, 0xFF00), True, [4], [1]),
        (6, struct.pack(">HH", 4, 77), True, [4], [77]),
        (6, struct.pack(">HH", 4, 77), False, [4], [77]),
        (15, struct.pack(">HHB", 2, 3, 1) + b"\x05", True, [2, 3, 4], [1, 0, 1]),
        (16, struct.pack(">HHBHH", 2, 2, 4, 8, 9), True, [2, 3], [8, 9]),
        (16, struct.pack(">HH", 2, 2), False, [2, 3], []),
        (23, struct.pack(">HHHHBH", 1, 2, 9, 1, 2, 5), True, [1, 2, 9], [5]),
        (1, b"\x01\x05", False, [], [1, 0, 1, 0, 0, 0, 0, 0]),
        (3, b"\x04" + struct.pack(">HH", 5, 6), False, [], [5, 6]),
    ],
)
def test_modbus(function, body, request_, registers, values):
    found = decode.modbus(modbus_unit(function, body), request_)
    assert (found["modbus_function"], found["modbus_unit_id"], found["modbus_transaction_id"]) == (function, 3, 7)
    assert found["modbus_registers"] == registers and found["modbus_register_values"] == values


def test_modbus_short_and_large():
    assert decode.modbus(b"\0" * 7, True) == {}
    assert len(decode.modbus(modbus_unit(3, struct.pack(">HH", 0, 60000)), True)["modbus_registers"]) == 512


def publish(topic, body, qos=0):
    payload = struct.pack(">H", len(topic)) + topic.encode() + (b"\0\x05" if qos else b"") + body
    return bytes([0x30 | qos << 1, len(payload)]) + payload


def test_mqtt():
    connect = struct.pack(">H", 4) + b"MQTT" + bytes([4, 2]) + struct.pack(">HH", 30, 2) + b"c1"
    found = decode.mqtt(bytes([0x10, len(connect)]) + connect, 5, 6)
    assert found["mqtt_client_id"] == "c1" and found["mqtt_keepalive"] == 30
    assert decode.mqtt(publish("t", b"21.5"), 5, 6) == {}
    found = decode.mqtt(publish("t", b"21.5", qos=1), 5, 1883)
    assert found["mqtt_payload_values"] == [{"name": "value", "value": 21.5}] and found["mqtt_packet_id"] == 5
    assert decode.mqtt_values(b'{"a": 1, "b": true, "c": "x"}') == [{"name": "a", "value": 1.0}]
    assert decode.mqtt_values(b"nan") == [] and decode.mqtt_values(b"1" * 5000) == []
    assert decode.mqtt(b"\x30\xff\xff\xff\xff\x01", 5, 1883) == {} and decode.mqtt(b"\x36\x02\0\0", 5, 1883) == {}


def ua_message(service, body):
    inner = struct.pack("<III", 1, 2, 9) + b"\x01\x00" + struct.pack("<H", service) + body
    return b"MSGF" + struct.pack("<II", 12 + len(inner), 77) + inner


REQUEST_HEADER = b"\0\0" + b"\0" * 16 + struct.pack("<i", -1) + b"\0" * 4 + b"\0\0\0"
NODE = b"\x03\x03\0" + ua_string('"a"."b"')


def test_opcua():
    hello = b"HELF" + struct.pack("<I", 32 + 14) + b"\0" * 20 + ua_string("opc.tcp://h:48")
    assert decode.opcua(hello)["opcua_endpoint_url"] == "opc.tcp://h:48" and decode.opcua_is_certain(hello)
    read = REQUEST_HEADER + b"\0" * 12 + struct.pack("<i", 1) + NODE + struct.pack("<I", 13) + struct.pack("<i", -1) + b"\0\0" + struct.pack("<i", -1)
    found = decode.opcua(ua_message(631, read))
    assert found["opcua_node_ids"] == ['ns=3;s="a"."b"'] and found["opcua_operation"] == "read" and found["opcua_request_id"] == 9
    value = b"\x01\x0b" + struct.pack("<d", 2.5)
    write = REQUEST_HEADER + struct.pack("<i", 2) + 2 * (NODE + struct.pack("<I", 13) + struct.pack("<i", -1) + value)
    found = decode.opcua(ua_message(673, write))
    assert found["opcua_values"] == [2.5] and found["opcua_operation"] == "write"
    response = b"\0" * 16 + b"\0" + struct.pack("<i", 0) + b"\0\0\0" + struct.pack("<i", 2) + value + b"\x09\x06" + struct.pack("<i", 4) + b"\0" * 8
    assert decode.opcua(ua_message(634, response))["opcua_values"] == [2.5, 4.0]
    assert decode.opcua(b"MSGX" + b"\0" * 20) == {} and decode.opcua(b"ab") == {}


def test_sni():
    name = b"\0" + struct.pack(">H", 4) + b"host"
    extension = struct.pack(">HHH", 0, len(name) + 2, len(name)) + name
    body = b"\3\3" + b"\0" * 32 + b"\0" + struct.pack(">H", 2) + b"\0\1" + b"\1\0" + struct.pack(">H", len(extension)) + extension
    hello = b"\x16\3\1" + struct.pack(">H", len(body) + 4) + b"\1" + struct.pack(">I", len(body))[1:] + body
    assert decode.sni(hello) == "host" and decode.sni(hello[:40]) is None and decode.is_tls(hello)


def dns(names, pointers=True, answers=0, flags=0x0100, ident=7):
    """A message of questions, with answers whose names point at the first question's."""
    def name(text):
        return b"".join(bytes((len(p),)) + p.encode() for p in text.split(".")) + b"\0"

    body = b"".join(name(n) + struct.pack(">HH", 1, 1) for n in names)
    body += b"".join((b"\xc0\x0c" if pointers else name(names[0])) + struct.pack(">HHIH", 5, 1, 60, 4) + b"data" for _ in range(answers))
    return struct.pack(">6H", ident, flags, len(names), answers, 0, 0) + body


def test_dns_messages():
    found = decode.dns_message(dns(["plc.example.net", "b"], answers=2, flags=0x8183))
    assert found == {"id": 7, "response": True, "operation": 0, "code": 3, "questions": [("plc.example.net", 1), ("b", 1)], "answers": [("plc.example.net", 5)] * 2}
    whole = dns(["plc.example.net"], answers=1)
    assert all(decode.dns_message(whole[:n]) is None for n in range(len(whole)))
    assert decode.dns_message(dns(["a.b"], flags=0x0300)[:14])["questions"] == []  # cut off, and says so
    circle = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0c" + bytes(4)
    ahead = struct.pack(">6H", 1, 0, 1, 0, 0, 0) + b"\xc0\x0e\xc0\x0c" + bytes(4)
    assert decode.dns_message(circle) is None and decode.dns_message(ahead) is None and decode.dns_message(bytes(12)) is None


def named(payload, sp, dp, protocol="tcp"):
    row = {"payload": payload, "src_port": sp, "dst_port": dp, "protocol": protocol}
    return decode.protocol_name(row), decode.full_protocol_name(row)


def test_full_names_differ_from_plain_ones():
    smb = b"\xffSMB\x72" + bytes(27)
    session = lambda body: b"\0\0" + struct.pack(">H", len(body)) + body
    assert named(dns(["a"]), 5353, 5353, "udp") == ("UDP", "DNS")
    assert named(dns(["a"]), 5353, 5354, "udp") == ("UDP", "UDP")
    assert named(struct.pack(">H", 19) + dns(["a"]), 22, 53) == ("DNS", "DNS")
    assert named(b"", 22, 502) == ("Modbus", "SSH")  # the source's port comes first
    assert named(session(smb), 139, 50000) == ("NetBIOS", "SMB")
    assert named(session(b"\xfeSMB" + bytes(60)), 50000, 445) == ("SMB", "NetBIOS")
    assert named(b"\x85\0\0\0", 50000, 445) == ("SMB", "NetBIOS")
    assert named(b"plain", 50000, 445) == ("SMB", "SMB")
    assert named(b"\x16\x03\x01\0\1\2", 80, 50000) == ("HTTPS", "HTTPS")
    assert named(b"\x16\x03\x01", 80, 50000) == ("HTTPS", "HTTP")
    assert named(b"PATCH /x HTTP/1.1\r\n", 9, 9) == ("HTTP", "HTTP")
    assert named(b"PATCH /" + b"x" * 40 + b" HTTP/1.1\r\n", 9, 9) == ("HTTP", "TCP")
    assert named(b"answer HTTP/1.1 200", 9, 9) == ("TCP", "HTTP")
    assert named(b"", 67, 68, "udp") == ("DHCP", "DHCP") and named(b"", 9, 502, "udp") == ("Modbus", "Modbus")
