"""Decoders and parsers on arbitrary input: they answer, and keep their invariants."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from otflow.functions import decode
from otflow.operators import timeline
from otflow.sources import graph_text, pcap

payloads = st.one_of(st.binary(max_size=200), st.builds(lambda a, b: a + b, st.sampled_from([b"MSGF", b"HELF", b"OPNF", b"\x10", b"\x30", b"GET / ", b"\x16\x03\x01"]), st.binary(max_size=120)))


@settings(max_examples=300, deadline=None)
@given(payloads, st.integers(0, 65535), st.sampled_from([502, 1883, 4840, 443, 80, 5]))
def test_payload_decoders_answer(payload, sp, dp):
    row = {"payload": payload, "src_port": sp, "dst_port": dp, "protocol": "tcp"}
    found = decode.details(row)
    assert found["high_level_protocol"]
    assert all(math.isfinite(v["value"]) for v in found.get("mqtt_payload_values", []))
    assert len(found.get("modbus_registers", [])) <= 1024


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.booleans())
def test_frames_and_captures_answer(data, full):
    for row in decode.frames(bytes(12) + b"\x08\x00\x45" + data, full):
        assert row["payload_len"] == len(row["payload"])
    assert all(len(f) <= len(data) for _, f in pcap.records(b"\xd4\xc3\xb2\xa1" + bytes(20) + data))
    list(pcap.records(b"\x0a\x0d\x0d\x0a" + data))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="MERGE (n:A{guid: '\"\\;})-[]>,1.5true \n", max_size=200))
def test_graph_text_answers(text):
    nodes, edges = graph_text.parse(text)
    assert all("guid" in n["props"] for n in nodes) and len(edges) >= 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(-1000, 1000)), max_size=300), st.integers(2, 50))
def test_corners_are_bounded_and_ordered(points, limit):
    stored = timeline.Corners(limit=limit).after(np.array(sorted(points), float).reshape(-1, 2)).closed()
    assert len(stored) <= limit + 1
    assert all(a[0] <= b[0] for a, b in zip(stored, stored[1:]))
    assert set(stored) <= {(float(t), float(v)) for t, v in points}
    assert len(timeline.decode(timeline.encode(stored))) == len(stored)
