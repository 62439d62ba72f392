"""Order-dependent operators against plain Python models, policy cases and streaming."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from otflow.functions import columns as X
from otflow.operators import policy, registers, timeline
from otflow.sources.packet_view import packets
from otflow.streaming import flows as streaming

SF = "/root/testdata/sf0.001"


def plain_corners(points, tolerance=1.0, limit=100):
    """Corners by their definition: every point against every accepted one since the last corner."""
    found, since = [], []
    for i, (t, v) in enumerate(points):
        if not found:
            found, since = [(t, v)], []
        elif t > found[-1][0]:
            t0, v0 = found[-1]
            fits = all(v0 + (y - tolerance - v0) / (x - t0) * (t - t0) - tolerance <= v <= v0 + (y + tolerance - v0) / (x - t0) * (t - t0) + tolerance for x, y in since)
            if fits:
                since.append((t, v))
            else:
                found, since = found + since[-1:] + [(t, v)], []
        if len(found) > limit:
            return plain_corners(found + points[i + 1 :], 2 * tolerance, limit)
    return found + since[-1:], tolerance


def test_corners():
    points = [(0, 0), (1, 0), (2, 0), (3, 9), (3, 5), (4, 9)]
    closed = timeline.Corners().after(np.array(points, float)).closed()
    assert closed == [(0.0, 0.0), (2.0, 0.0), (3.0, 9.0), (4.0, 9.0)]
    assert timeline.encode(closed) == "@0.000|0.00:0,2.00:0,3.00:9,4.00:9"
    assert timeline.decode("@0.000|0.00:0,2.00:x,3.00:9") == [(0.0, 0.0), (3.0, 9.0)]
    assert timeline.encode([]) is None and timeline.encode([(1.0, 2.5)]) == "@1.000|0:2.500"


@pytest.mark.parametrize("limit", [4, 10, 100])
@pytest.mark.parametrize("piece", [1, 7, 1024])
def test_corners_equal_their_definition(monkeypatch, limit, piece):
    """However a series is cut into batches and pieces, and with limits that are passed more than once."""
    monkeypatch.setattr(timeline, "PIECE", piece)
    rng = np.random.default_rng(limit)
    for n in (0, 1, 2, 30, 300):
        points = np.stack([np.cumsum(rng.integers(0, 3, n)) / 2, np.cumsum(rng.integers(-3, 4, n)) * 1.0], 1)
        want, tolerance = plain_corners([tuple(p) for p in points.tolist()], limit=limit)
        state = timeline.Corners(limit=limit)
        for part in np.split(points, sorted(rng.integers(0, n + 1, 3))):
            state = state.after(part)
        assert (state.closed(), state.tolerance) == (want, tolerance)
        assert len(state.closed()) <= limit + 1 and state.tolerance == 2.0**state.doublings


def test_timelines_equal_model(spark):
    obs = registers.with_series(registers.observations(packets(spark, SF)), "server_ip", "register", "kind")
    got = {r["series"]: r for r in timeline.timelines(obs).collect()}
    want = {}
    for r in obs.orderBy("ts_us", "pcap_file", "packet_index").collect():
        want.setdefault(r["series"], []).append((r["ts_us"] / 1e6, float(r["value"])))
    assert {k: timeline.encode(plain_corners(p)[0]) for k, p in want.items()} == {k: r["timeline"] for k, r in got.items()}


def plain_merge(parts):
    """Summaries of one series, merged one after another."""
    known = lambda c: [p[c] for p in parts if p[c] is not None]
    samples = sum(p["samples"] for p in parts)
    late = max(parts, key=lambda p: (p["last_us"], p["last_value"]))
    best = max(parts, key=lambda p: (p["points"] or 0, p["buckets"] or 0, p["runs"] or 0, p["samples"], p["rle"] or ""))
    tops = {}
    for text in known("top_values"):
        for part in text.split(","):
            value, n = map(int, part.split(":"))
            tops[value] = tops.get(value, 0) + n
    points = sorted({(round(t * 1e6) / 1e6, v) for text in known("timeline") for t, v in timeline.decode(text)})
    corners, tolerance = plain_corners(points, min(p["tolerance"] for p in parts if p["timeline"]))
    out = {c: sum(known(c)) if known(c) else None for c in ("reads", "writes", "samples", "changes")}
    out |= {c: max(known(c), default=None) for c in ("max_value", "buckets", "last_us", "last_write_us")}
    out |= {"min_value": min(known("min_value")), "last_value": late["last_value"], "last_function": max(parts, key=lambda p: (p["last_us"], p["last_function"]))["last_function"]}
    out |= {"functions": ",".join(map(str, sorted({int(f) for p in parts for f in p["functions"].split(",")}))), "truncated": any(known("truncated"))}
    out |= {"top_values": ",".join(f"{v}:{n}" for v, n in sorted(tops.items(), key=lambda x: (-x[1], x[0]))[:4]), "rle": best["rle"], "runs": best["runs"], "ratio": round(samples / best["runs"] + 1e-9, 2)}
    return out | {"timeline": timeline.encode(corners), "points": len(corners), "tolerance": tolerance, "timeline_ratio": round(samples / len(corners) + 1e-9, 2)}


def test_merged_summaries(spark):
    """Summaries of six kinds of packets merged, against a loop over them, and counts against those of all packets."""
    from functools import reduce

    from otflow.plans import registry

    obs = registers.with_series(registers.observations(packets(spark, SF)), "server_ip", "register", "kind")
    parts = reduce(lambda a, b: a.unionByName(b), [registry.summaries(obs.where(F.col("packet_index") % 6 == k)) for k in range(6)]).persist()
    by_series = {}
    for r in parts.collect():
        by_series.setdefault(r["series"], []).append(r.asDict())
    got = {r["series"]: r.asDict() for r in timeline.merge_summaries(parts).collect()}
    whole = {r["series"]: r for r in registers.statistics(obs).collect()}
    assert set(got) == set(by_series) == set(whole) and max(map(len, by_series.values())) > 3
    for series, r in got.items():
        want = plain_merge(by_series[series])
        assert {c: r[c] for c in want} == want
        assert r["mean_value"] == pytest.approx(whole[series]["mean_value"], abs=0.002)
        assert (r["samples"], r["min_value"], r["max_value"], r["last_value"]) == tuple(whole[series][c] for c in ("samples", "min_value", "max_value", "last_value"))


def test_float_signals_are_counted_in_whole_values(spark):
    """Halves go to the even neighbour, in runs, buckets and top values."""
    values = [1.2, 1.4, 1.6, 2.5, -0.5, 0.4, 0.5, 1.5, -1.2, -2.4]
    rows = spark.createDataFrame([("s", v, k, "f", k) for k, v in enumerate(values)], "series string, value double, ts_us long, pcap_file string, packet_index long")
    whole = registers.quantised(rows)
    assert [r["value"] for r in whole.orderBy("ts_us").collect()] == [round(v) for v in values] == [1, 1, 2, 2, 0, 0, 0, 2, -1, -2]
    assert registers.run_lengths(whole).first()["rle"] == "1:2,2:2,0:3,2:1,-1:1,-2:1"
    assert registers.top_values(whole).first()["top_values"] == "0:3,2:3,1:2,-1:1"
    assert registers.bucket_distinct(whole).first()["buckets"] == len({hash(round(v)) & 63 for v in values}) == 4


@pytest.mark.parametrize(
    "src,sp,dst,dp,packets,layer,want",
    [
        ("10.0.0.1", 40000, "10.0.0.2", 502, 2, 0, False),
        ("10.0.0.1", 40000, "10.0.0.2", 502, 3, 0, True),
        ("8.8.8.8", 40000, "9.9.9.9", 50000, 1, 1, True),
        ("10.0.0.1", 40000, "10.0.0.255", 502, 9, 1, False),
        ("10.0.0.1", 40000, "224.0.0.9", 502, 9, 0, False),
        ("172.16.0.1", 40000, "172.16.0.2", 502, 9, 0, False),
        ("10.0.0.1", 40000, "10.0.0.2", 40001, 9, 0, False),
        ("10.0.0.1", 1900, "10.0.0.2", 502, 9, 0, False),
        ("8.8.8.8", 40000, "9.9.9.9", 9999, 9, 0, False),
        ("8.8.8.8", 40000, "172.20.1.1", 9999, 9, 0, True),
    ],
)
def test_policy(spark, src, sp, dst, dp, packets, layer, want):
    df = spark.createDataFrame([(src, sp, dst, dp, packets, layer)], "src_ip string, src_port int, dst_ip string, dst_port int, packets long, layer int")
    assert df.select(policy.interesting()).first()[0] is want


def test_time_and_port_texts(spark):
    texts = ["1704067200", "1704067200000", "2024-01-01T00:00:00Z", "datetime('2024-01-01T00:00:00')", "2024-01-01 00:00:00.500000", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.parse_time(F.col("t"))).collect()] == [1704067200.0, 1704067200.0, 1704067200.0, 1704067200.0, 1704067200.5, None, None]
    ports = spark.createDataFrame([(t,) for t in ["any", "502", "80.9", "", None, "x"]], "t string")
    assert [r[0] for r in ports.select(X.coerce_port(F.col("t"))).collect()] == [0, 502, 80, 0, 0, None]
    cells = spark.createDataFrame([(t,) for t in [" 7.9", "None", "", "TRUE", "no", None]], "t string")
    assert [tuple(r) for r in cells.select(X.safe_int(F.col("t")), X.safe_bool(F.col("t"))).collect()] == [(7, None), (None, None), (None, None), (None, True), (None, False), (None, None)]
    ips = spark.createDataFrame([(t,) for t in ["1.2.3.4", "256.1.1.1", "a.b.c.d", "1.2.3"]], "t string")
    assert [r[0] for r in ips.select(X.is_ipv4(F.col("t"))).collect()] == [True, False, False, False]


def test_unknown_stage_takes_nothing(spark):
    from otflow.operators import flows, grouping

    assert grouping.stage("other").oriented(flows.assemble(packets(spark, SF))).count() == 0


def test_rejected_modbus_group_is_consumed(spark):
    from otflow.operators import flows, grouping

    view = packets(spark, SF)
    one = view.where("src_port = 502 or dst_port = 502").limit(2)
    assembled = flows.assemble(one)
    edges, consumed = grouping.run_stages(assembled)
    assert {r["stage"] for r in edges.collect()} <= {"modbus"}
    assert {r["canonical_id"] for r in consumed.where("stage = 'modbus'").collect()} == {r["canonical_id"] for r in assembled.collect()}


def test_stream_equals_batch(spark, tmp_path):
    view = packets(spark, SF)
    source = tmp_path / "packets"
    view.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(view.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    streaming.run_stats(stream, str(tmp_path / "stats"), str(tmp_path / "check"))
    got = streaming.latest(spark.read.parquet(str(tmp_path / "stats")))
    want = streaming.flow_stats(view)
    assert sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in got.select(want.columns).collect()) == sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in want.collect())


def test_stream_closes_windows(spark, tmp_path):
    view = packets(spark, SF).orderBy("ts_us")
    view.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = streaming.traffic_windows(spark.readStream.schema(view.schema).parquet(str(tmp_path / "p")), late="1 hour")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = set(map(tuple, spark.table("windows").collect()))
    assert got and got <= set(map(tuple, streaming.traffic_windows(view).collect()))


def test_stream_pairs_requests(spark, tmp_path):
    view = packets(spark, SF).where("modbus_function is not null")
    view.coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = streaming.pair_requests(spark.readStream.schema(view.schema).parquet(str(tmp_path / "p")))
    query = stream.writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = registers.paired(view).where("not request").selectExpr("ts_us", "asked.ts_us as request_us").collect()
    assert sorted((r["ts_us"], r["request_us"] or 0) for r in spark.table("pairs").collect()) == sorted((r["ts_us"], r["request_us"] or 0) for r in batch)


def test_plans_stay_in_the_jvm(spark):
    """Built-in operators plan no Python, and column pruning reaches the scan."""
    from otflow.plans import registry

    for name in ("group_collapsed", "corr_session_port", "register_rle", "rtt_mean"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    plan = registry.QUERIES["service_port_flag"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("slot_us", [1, 7, 50, 10_000])
@pytest.mark.parametrize("keep", [1, 5, 200])
def test_runs_are_the_same_whatever_the_slots(spark, slot_us, keep):
    from itertools import groupby

    rng = np.random.default_rng(slot_us + keep)
    rows, series = [], {}
    for name, n, values in (("long", 400, 2), ("one value", 90, 1), ("single", 1, 3), ("gaps", 60, 3)):
        times = np.sort(rng.integers(-100, 3000, n)) if name == "gaps" else np.sort(rng.integers(0, 400, n))
        for k, t in enumerate(times.tolist()):
            value = int(rng.integers(0, values))
            rows.append((name, "coil", value, t, "f", k))
            series.setdefault(name, []).append(value)
    obs = spark.createDataFrame(rows, "series string, kind string, value int, ts_us long, pcap_file string, packet_index long").repartition(5)
    want = {}
    for name, values in series.items():
        runs = [(v, len(list(g))) for v, g in groupby(values)]
        want[name] = (",".join(f"{v}:{n}" for v, n in runs[-keep:]), len(runs), len(runs) > keep)
    assert {r["series"]: (r["rle"], r["runs"], r["truncated"]) for r in registers.run_lengths(obs, keep, slot_us).collect()} == want
    assert {r["series"]: r["changes"] for r in registers.state_changes(obs, slot_us).collect()} == {k: v[1] - 1 for k, v in want.items()}
