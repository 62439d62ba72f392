"""Capture files, graph text and the command line on small made-up inputs."""

import struct

import pytest

from otflow.sources import graph_text, pcap
from tests.test_decode import ether, ip4, modbus_unit, tcp

GRAPH = """
MERGE (n:NetworkEndpoint {guid: '{e1}', hostname: 'SCADA-01', ipAddresses: ['192.168.42.20']});
MERGE (n:Process {guid: '{p1}', image: 'gw;}.exe', processId: 812});
MERGE (n:NetworkService {guid: '{s1}', host: 'PLC-01', ipAddress: '192.168.43.9', port: 502, protocol: 'TCP'});
MATCH (a:Process {guid: '{p1}'}), (b:NetworkService {guid: '{s1}'}) CREATE (a)-[:CONNECT_TO {SourceIp: '192.168.42.20', sessionPorts: [40001, 40002], sessionTimestamps: [1704067200.0, 1704067260.0]}]->(b);
"""


def capture(frames, order="<"):
    out = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for ts, frame in frames:
        out += struct.pack(order + "4I", ts // 1_000_000, ts % 1_000_000, len(frame), len(frame)) + frame
    return out


def capture_ng(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for ts, frame in frames:
        out += block(6, struct.pack("<5I", 0, ts >> 32, ts & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    return out


def frames(n=4):
    out = []
    for k in range(n):
        ask = modbus_unit(3, struct.pack(">HH", 10, 1), txid=k)
        tell = modbus_unit(3, b"\x02" + struct.pack(">H", 5 + k), txid=k)
        out.append((1_704_067_200_000_000 + k * 1000, ether(0x0800, ip4("192.168.42.20", "192.168.43.9", 6, tcp(40001, 502, ask)))))
        out.append((1_704_067_200_000_500 + k * 1000, ether(0x0800, ip4("192.168.43.9", "192.168.42.20", 6, tcp(502, 40001, tell)))))
    return out


@pytest.mark.parametrize("build", [capture, lambda f: capture(f, ">"), capture_ng])
def test_records(build):
    assert list(pcap.records(build(frames()))) == frames()
    assert len(list(pcap.records(build(frames())[:-5]))) == len(frames()) - 1


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(frames()))
    (tmp_path / "b.pcapng").write_bytes(capture_ng(frames(2)))
    (tmp_path / "other.txt").write_text("x")
    return tmp_path


def test_pcap_source(spark, folder):
    spark.dataSource.register(pcap.PcapSource)
    read = spark.read.format("pcap").option("path", str(folder))
    rows = read.load().collect()
    assert len(rows) == 12 and {r["pcap_file"] for r in rows} == {"a.pcap", "b.pcapng"}
    assert read.option("packetLimit", 3).load().count() == 6
    assert sorted(map(str, pcap.read_captures(spark, str(folder)).collect())) == sorted(map(str, rows))
    assert pcap.read_captures(spark, str(folder), limit=3).count() == 6
    assert pcap.read_captures(spark, str(folder / "b.pcapng")).count() == 4
    (folder / "empty/x=1").mkdir(parents=True)
    assert pcap.read_captures(spark, str(folder / "empty")).count() == 0 and pcap.read_captures(spark, str(folder)).count() == 12
    first = pcap.read_captures(spark, str(folder), total=9).collect()
    assert [(r["pcap_file"], r["packet_index"]) for r in first] == [("a.pcap", k) for k in range(8)] + [("b.pcapng", 0)]


def test_stream_reads_each_file_once(spark, folder, tmp_path_factory):
    """Also one whose name comes before those that were read already."""
    from otflow.streaming import flows as streaming

    out, log = (str(tmp_path_factory.mktemp("stream") / name) for name in ("stats", "log"))
    streaming.run_stats(pcap.stream_captures(spark, str(folder)), out, log)
    (folder / "0.pcap").write_bytes(capture(frames(3)))
    streaming.run_stats(pcap.stream_captures(spark, str(folder)), out, log)
    streaming.run_stats(pcap.stream_captures(spark, str(folder)), out, log)
    (state,) = streaming.latest(spark.read.parquet(out)).collect()
    assert state["packet_count"] == pcap.read_captures(spark, str(folder)).count() == 18


def test_register_observations(spark, folder):
    from otflow.operators import registers

    obs = registers.observations(pcap.read_captures(spark, str(folder)).where("pcap_file = 'a.pcap'")).orderBy("ts_us").collect()
    assert [(r["register"], r["value"], r["access"], r["unit"]) for r in obs] == [(10, 5 + k, "read", 3) for k in range(4)]


def test_graph_text(spark, tmp_path):
    (tmp_path / "g.cypher").write_text(GRAPH)
    nodes, edges = graph_text.read_graph(spark, str(tmp_path / "g.cypher"))
    assert {r["label"] for r in nodes.collect()} == {"NetworkEndpoint", "Process", "NetworkService"} and edges.count() == 1
    (a,) = graph_text.telemetry(nodes, edges).collect()
    assert (a["src_ip"], a["src_port"], a["dst_ip"], a["dst_port"], a["protocol"]) == ("192.168.42.20", 0, "192.168.43.9", 502, "tcp")
    assert [(s["port"], s["ts_us"]) for s in a["sessions"]] == [(40001, 1_704_067_200_000_000), (40002, 1_704_067_260_000_000)]
    assert a["process"]["guid"] == "{p1}" and a["process"]["image"] == "gw;}.exe"


def test_literals():
    assert graph_text.properties("a: 'x,\\'y', b: [1, 2.5, 'q'], c: true, d: null, e: word, `f`: -3") == {"a": "x,\\'y", "b": [1, 2.5, "q"], "c": True, "d": None, "e": "word", "f": -3}
    assert graph_text.split("a 'x;y'; b {c;d}; ;e", ";") == ["a 'x;y'", "b {c;d}", "e"]


def test_assets(spark, tmp_path):
    pytest.importorskip("yaml")
    from otflow.sources.assets import read_assets

    (tmp_path / "a.yaml").write_text("hosts:\n- {hostname: H, ip_addresses: [1.1.1.1, 2.2.2.2], has_logs: false}\n- {hostname: K, ip: 3.3.3.3}\n")
    rows = read_assets(spark, str(tmp_path / "a.yaml")).collect()
    assert [(r["hostname"], r["ip_addresses"], r["is_managed"]) for r in rows] == [("H", ["1.1.1.1", "2.2.2.2"], False), ("K", ["3.3.3.3"], True)]


def written(path):
    """The text of all files in the order of their names."""
    return "".join(f.read_text() for f in sorted(path.glob("part-*")))


def test_command_line(spark, folder, tmp_path):
    from otflow.__main__ import main
    from otflow.operators import augment

    (tmp_path / "g.cypher").write_text(GRAPH)
    base = ["--base-cypher", str(tmp_path / "g.cypher"), "--output-cypher", str(tmp_path / "out"), "--pcap-dir", str(folder)]
    assert main([*base, "--observations", str(tmp_path / "obs"), "--cache", str(tmp_path / "cache")]) == 0
    text = written(tmp_path / "out/statements")
    assert text.lstrip().startswith("MERGE (n:NetworkEndpoint {guid: '{e1}'")
    places = [text.index(h) for h in augment.HEADINGS]
    assert places == sorted(places)
    signal = text[places[4] : places[5]]
    assert "ICSSignal" in signal and "EXPOSED_ON" in signal and "valueRLE: '5:1,6:1,7:1,8:1'" in signal and "valueTimeline: '@" in signal and "meanValue: 6.5" in signal
    assert "LISTENS_ON" in text[places[2] : places[3]] and "OBSERVED" in text[places[5] : places[6]]
    assert "image: 'placeholder'" in text[places[6] : places[7]] and "RUN_ON" in text[places[7] : places[8]] and "BINDS" in text[places[7] : places[8]]
    related = text[places[8] :]
    assert "-[r:READ_SIGNAL]->" in related and "correlationMethod" in related and "{p1}" in related
    assert main([*base, "--verify"]) == 0 and main([*base, "--summary-only"]) == 0


def test_statements_without_telemetry(spark, folder, tmp_path):
    """Edges of unmanaged hosts start at their placeholders and carry a feature row; names come from the export."""
    from otflow.__main__ import main

    (tmp_path / "g.cypher").write_text("MERGE (n:NetworkEndpoint {guid: '{e9}', hostname: 'Pump-9', ipAddresses: ['192.168.43.9']});")
    base = ["--base-cypher", str(tmp_path / "g.cypher"), "--output-cypher", str(tmp_path / "out"), "--pcap-dir", str(folder)]
    assert main([*base, "--min-aggregation-threshold", "1"]) == 0
    text = written(tmp_path / "out/statements")
    assert "hostname: 'Pump-9'" in text and "hostname: 'PLC-01'" not in text
    related = text[text.index("// PCAP-Inferred Network Relationships") :]
    assert "avgPacketSize" in related and "tcpFlags" in related and "attribution: 'placeholder'" in related and "READ_SIGNAL" in related


def test_streamed_command_line(spark, folder, tmp_path_factory):
    """Captures that come in two runs: the second tells the sums over both, in the order of sections, after the export's own text."""
    from otflow.__main__ import main
    from otflow.streaming import graph_steps

    out = tmp_path_factory.mktemp("graph")
    (out / "g.cypher").write_text(GRAPH)
    for n in (6, 9):
        (folder / f"{n}.pcap").write_bytes(capture(frames(n)))
        assert main(["--base-cypher", str(out / "g.cypher"), "--output-cypher", str(out / "o"), "--pcap-dir", str(folder), "--streaming", "--packet-limit", "14"]) == 0
    text = written(out / "o/statements")
    assert text.startswith(GRAPH)
    places = [text.index(h) for h in graph_steps.HEADINGS]
    assert places == sorted(places)
    # Two files of 8 and 4 packets, then one of 12 and one of 18, which is read up to 14.
    assert "packetCount: 38" in text[places[1] : places[2]] and "READ_SIGNAL" in text[places[2] : places[3]] and "LISTENS_ON" in text[places[4] : places[5]]


def test_last_statement_names_an_address(spark, tmp_path):
    from otflow.operators import augment

    (tmp_path / "g.cypher").write_text("".join(f"MERGE (n:NetworkEndpoint {{guid: '{{e{k}}}', hostname: '{name}', ipAddresses: ['10.9.9.9']}});\n" for k, name in enumerate(("B", "C", "A"))))
    assert augment.names_of(graph_text.read_graph(spark, str(tmp_path / "g.cypher"))[0])["10.9.9.9"] == "A"


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_statements_keep_their_order_in_any_number_of_files(spark, tmp_path, coalesced):
    from otflow.operators import graph

    rows = [(k % 7, f"{k * 7919 % 1000:04}", f"s{k % 7} {k * 7919 % 1000:04}") for k in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    try:
        graph.write_text(spark.createDataFrame(rows, "section int, key string, text string"), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = len(list((tmp_path / "t").glob("part-*")))
    assert files == 1 if coalesced == "true" else files > 1
    assert written(tmp_path / "t").split("\n")[:-1] == [r[2] for r in sorted(rows)]
