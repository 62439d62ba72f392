"""The graph that a stream changes step by step, against that of all its packets."""

import pytest

from otflow.operators import flows as fl
from otflow.sources import pcap
from otflow.streaming import graph_steps as G
from tests.test_decode import ether, ip4, modbus_unit, tcp
from tests.test_sources import capture, frames

T0 = 1_704_067_200_000_000
HOSTS = [("SCADA-01", "192.168.42.20", True), ("HMI-02", "192.168.42.30", False), ("PLC-01", "192.168.43.9", False)]


def talk(client: str, port: int, server: str, n: int, at: int):
    """n requests and answers of register 10, the values counting up from 5."""
    out = []
    for k in range(n):
        ask = modbus_unit(3, b"\0\x0a\0\1", txid=k)
        tell = modbus_unit(3, b"\x02" + (5 + k).to_bytes(2, "big"), txid=k)
        out.append((at + k * 1000, ether(0x0800, ip4(client, server, 6, tcp(port, 502, ask)))))
        out.append((at + k * 1000 + 500, ether(0x0800, ip4(server, client, 6, tcp(502, port, tell)))))
    return out


@pytest.fixture
def given(spark):
    told = (1, "192.168.42.20", 0, "192.168.43.9", 502, "tcp", [(40001, T0)], ("{p1}", "gw.exe", 812, None, None), None, None)
    return spark.createDataFrame([told], G.ANCHOR), spark.createDataFrame(HOSTS, "hostname string, ip string, is_managed boolean")


def texts(df) -> dict:
    return {(r["section"], r["key"]): r["text"] for r in df.collect() if r["key"]}


def whole(spark, folder, anchors, hosts) -> dict:
    """Every section but that of signals, told of all packets at once."""
    packets = pcap.read_captures(spark, str(folder))
    flows = fl.assemble(packets)
    named = G.identities_of(flows, anchors, hosts)
    keys = ("edge", "series", "access", "ts_us")
    seen = G.augment.modbus_rows(packets).select(*keys).groupBy(*keys[:3]).agg(G.F.count(G.F.lit(1)).alias("n"), G.F.max("ts_us").alias("last_us"))
    return texts(G.flow_statements(flows, flows, named, anchors, hosts).unionByName(G.access_statements(seen, named)))


def test_steps_give_the_graph_of_the_whole(spark, given, tmp_path_factory):
    """A capture ends between a request and its answer, which the next one brings; a step tells only what it changes."""
    anchors, hosts = given
    data, out = tmp_path_factory.mktemp("data"), tmp_path_factory.mktemp("out")
    run = lambda: G.run_graph(pcap.stream_captures(spark, str(data)), str(out / "g"), str(out / "log"), anchors, hosts)
    first = frames(4) + talk("192.168.42.30", 50001, "192.168.43.9", 4, T0 + 100_000) + talk("192.168.42.30", 50001, "192.168.43.77", 3, T0 + 200_000)
    (data / "1.pcap").write_bytes(capture(first[:-1]))
    run()
    (data / "2.pcap").write_bytes(capture(first[-1:] + talk("192.168.42.30", 50002, "192.168.43.77", 3, T0 + 300_000)))
    run()
    got = texts(G.statements(spark, str(out / "g")))
    assert {k: t for k, t in got.items() if k[0] != G.SIGNALS} == whole(spark, data, anchors, hosts)
    assert {k[0] for k in got} == set(range(2, 10))
    signals = [t for k, t in got.items() if k[0] == G.SIGNALS]
    assert len(signals) == 2 and any("readCount: 6" in t and "192.168.43.77" in t for t in signals) and any("readCount: 8" in t for t in signals)
    changed = spark.read.parquet(str(out / "g/statements_flows/step=1")).collect()
    assert [r["section"] for r in changed] == [G.RELATIONSHIPS] and "flows" not in changed[0]["text"] and "canonicalCount: 2" in changed[0]["text"]

    def refuse(*_):
        raise AssertionError("a run without new captures takes no step")

    before = G.flow_step
    G.flow_step = refuse
    try:
        run()
    finally:
        G.flow_step = before
    assert texts(G.statements(spark, str(out / "g"))) == got


def test_a_repeated_step_changes_nothing(spark, given, tmp_path):
    anchors, hosts = given
    (tmp_path / "c").mkdir()
    (tmp_path / "c/1.pcap").write_bytes(capture(talk("192.168.42.30", 50001, "192.168.43.9", 3, T0)))
    packets = pcap.read_captures(spark, str(tmp_path / "c"))
    seen = []
    for step in (0, 1, 1):
        G.flow_step(fl.assemble(packets), step, str(tmp_path / "g"), anchors, hosts)
        G.signal_step(packets, step, str(tmp_path / "g"))
        told = [G._statements(str(tmp_path / "g"), n).now(spark) for n in ("flows", "signals")]
        seen.append(texts(told[0].unionByName(told[1])))
    assert seen[1] == seen[2] and spark.read.parquet(str(tmp_path / "g/statements_flows/step=1")).count() == 0


@pytest.mark.parametrize("fold", [1, 2])
def test_steps_of_a_table(spark, tmp_path, fold):
    """The last row of a key counts, whatever is folded; a step never meets its own or later folders."""
    steps = G.Steps(str(tmp_path / "t"), ("k",), "k int, v int", fold)
    assert steps.now(spark).count() == 0
    want = {}
    for step in range(4):
        rows = [(k, 10 * step + k) for k in (step, step + 1)]
        for _ in range(1 + step % 2):
            steps.put(spark.createDataFrame(rows, "k int, v int"), step)
        want |= dict(rows)
        assert {r["k"]: r["v"] for r in steps.now(spark).collect()} == want
