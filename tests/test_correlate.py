"""Correlation and process lookup on crafted flows and anchors."""

import random

import pytest
from pyspark.sql import functions as F

from otflow.operators import correlate, identity, intervals

FLOW = "canonical_id string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, first_us long, last_us long"
ANCHOR = (
    "anchor_seq long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, sessions array<struct<port:int,ts_us:long>>,"
    "process struct<guid:string,image:string,pid:int,user:string,computer:string>"
)
A, B = "192.168.42.20", "192.168.43.9"


def flow(spark, src=A, sp=40001, dst=B, dp=502, first=100_000_000):
    return spark.createDataFrame([("f", src, sp, dst, dp, "tcp", first, first + 1000)], FLOW)


def anchors(spark, *rows):
    full = [(k, a, ap, b, bp, "TCP", s, ("g" + str(k), "i", 1, None, None) if named else (None, None, None, None, None)) for k, a, ap, b, bp, s, named in rows]
    return spark.createDataFrame(full, ANCHOR)


@pytest.mark.parametrize("offset,confidence,method", [(0, 1.0, "session_port_exact"), (60_000_000, 1.0, "session_port_exact"), (60_001_000, 0.9, "session_port_match")])
def test_tolerance(spark, offset, confidence, method):
    found = correlate.session_matches(flow(spark), anchors(spark, (1, A, 0, B, 502, [(40001, 100_000_000 - offset)], True))).collect()
    assert [(r["confidence"], r["method"]) for r in found] == [(confidence, method)]


def test_time_offset(spark):
    a = anchors(spark, (1, A, 0, B, 502, [(40001, 3_700_000_000)], True))
    assert correlate.session_matches(flow(spark), a).first()["confidence"] == 0.9
    assert correlate.session_matches(flow(spark), a, offset_s=3600).first()["confidence"] == 1.0


def test_tiers_and_order(spark):
    session = [(40001, 100_000_000)]
    rows = [(5, A, 0, B, 502, session, True), (3, A, 0, B, 502, session, True), (9, A, 40001, B, 502, session, True), (1, A, 40001, B, 502, [], True)]
    (r,) = correlate.session_matches(flow(spark), anchors(spark, *rows)).collect()
    assert (r["anchor_seq"], r["tier"]) == (9, 0)
    (r,) = correlate.session_matches(flow(spark), anchors(spark, *rows[:2])).collect()
    assert (r["anchor_seq"], r["tier"]) == (3, 2)


def test_reversed_capture_matches_the_other_port(spark):
    turned = flow(spark, src=B, sp=502, dst=A, dp=40001)
    (r,) = correlate.session_matches(turned, anchors(spark, (1, A, 0, B, 502, [(40001, 100_000_000)], True))).collect()
    assert (r["tier"], r["confidence"]) == (3, 1.0)
    assert correlate.session_matches(turned, anchors(spark, (1, A, 0, B, 502, [(40002, 1)], True))).count() == 0


def test_process_lookup(spark):
    conn = flow(spark).withColumnRenamed("canonical_id", "conn_id")
    rows = [(1, A, 0, B, 502, [(50000, 1)], True), (2, A, 0, B, 502, [(40001, 1)], True), (0, A, 0, B, 502, [], False)]
    assert correlate.process_lookup(conn, anchors(spark, *rows)).first()["process_guid"] == "g2"
    assert correlate.process_lookup(conn, anchors(spark, rows[0])).first()["process_guid"] == "g1"
    assert correlate.process_lookup(conn, anchors(spark, rows[0]), require_port=True).count() == 0
    assert correlate.process_lookup(conn, anchors(spark, rows[2])).count() == 0
    other = flow(spark, dst="192.168.43.11").withColumnRenamed("canonical_id", "conn_id")
    by_host = correlate.process_lookup(other, anchors(spark, (4, A, 0, "192.168.44.11", 502, [], True))).first()
    assert (by_host["stage"], by_host["process_guid"]) == (2, "g4")


def test_best_process(spark):
    rows = [("e", 3, "b"), ("e", 4, "b"), ("e", 1, "a"), ("e", 2, "a"), ("e", 9, "c"), ("x", 1, None)]
    got = correlate.best_process(spark.createDataFrame(rows, "group_id string, port int, process_guid string")).collect()
    assert [tuple(r) for r in got] == [("e", "a", 2, 1)]


def test_verifier_finds_what_sessions_miss(spark):
    late = anchors(spark, (1, A, 0, B, 502, [(50000, 100_000_500)], True)).withColumn("first_us", F.lit(100_000_500).cast("long"))
    (r,) = correlate.verify(flow(spark), late).collect()
    assert (r["verdict"], r["reason"]) == ("missed", "temporal")
    exact = anchors(spark, (1, A, 0, B, 502, [(40001, 100_000_000)], True))
    assert correlate.verify(flow(spark), exact).count() == 0
    counters = {r["counter"]: r["n"] for r in identity.completeness(flow(spark), late).collect()}
    assert counters == {"flows": 1, "logged_hosts": 1, "service_ports": 1, "missed:temporal": 1}


def test_coverage_of_no_anchors(spark):
    (r,) = correlate.session_coverage(anchors(spark, (1, A, 0, B, 502, [], True)).where("false")).collect()
    assert (r["anchors"], r["with_sessions"], r["coverage"]) == (0, 0, None)


def test_one_hot_service_costs_rows_in_proportion(spark):
    """Thousands of flows and anchors between one client and one service: each flow meets a few rows, and the right ones."""
    n = 3000
    flows = spark.createDataFrame([(f"f{k}", A, 30000 + k % 2000, B, 502, "tcp", k * 1_000_000, k * 1_000_000 + 1) for k in range(n)], FLOW)
    many = [(k, A, 0, B, 502, "TCP", [(30000 + (7 * k) % 2500, k * 1_000_000), (30000 + k % 40, 0)], ("g", "i", 1, None, None)) for k in range(n)]
    found = spark.createDataFrame(many, ANCHOR)
    assert correlate.met_sessions(flows, found).count() <= 8 * n
    first = {}
    for k, *_, sessions, _ in many:
        for port, ts in sessions:
            first.setdefault(port, (k, ts))
    got = {r["canonical_id"]: (r["anchor_seq"], r["confidence"]) for r in correlate.session_matches(flows, found).collect()}
    want = {}
    for k in range(n):
        if hit := first.get(30000 + k % 2000):
            want[f"f{k}"] = (hit[0], 1.0 if abs(k * 1_000_000 - hit[1]) <= 60_000_000 else 0.9)
    assert got == want
    named = correlate.process_lookup(flows.withColumnRenamed("canonical_id", "conn_id"), found).collect()
    assert {r["conn_id"]: r["anchor_seq"] for r in named} == {f"f{k}": first.get(30000 + k % 2000, (0,))[0] for k in range(n)}


SPAN = "id long, begin long, end long, k string"


def spans_and_windows(seed):
    """Spans and windows of all sizes: points, parts of a bin, years, ends that touch by a microsecond, nulls and reversed ones."""
    rng = random.Random(seed)
    sizes = [0, 1, 1000, 1 << 26, (1 << 26) - 1, 10**9, 10**12, 10**15]
    places = [0, 1 << 26, 5 << 26, 1_700_000_000_000_000, -(3 << 26)]

    def rows(n):
        out = []
        for k in range(n):
            begin = rng.choice(places) + rng.choice([0, 1, -1, rng.randrange(1 << 28)])
            end = begin + rng.choice([*sizes, rng.randrange(1 << 30), -5])
            out.append((k, *rng.choice([(begin, end)] * 12 + [(None, end), (begin, None)]), rng.choice(["a", "a", "b", None])))
        return out

    return rows(150), [(900 - s, b, e, k) for s, b, e, k in rows(120)]


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_equal_nested_loops(spark, seed):
    spans, held = spans_and_windows(seed)
    got = intervals.first_overlaps(spark.createDataFrame(spans, SPAN), spark.createDataFrame(held, SPAN.replace("id", "seq")), ["k"])
    want = {}
    for i, b, e, k in spans:
        hits = [s for s, x, y, j in held if None not in (b, e, x, y, k, j) and k == j and b <= e and x <= y and x <= e and b <= y]
        if hits:
            want[i] = min(hits)
    assert {r["id"]: r["seq"] for r in got.collect()} == want and len(want) > 30


def test_touching_ends_overlap(spark):
    held = spark.createDataFrame([(1, 100, 200, "k")], SPAN.replace("id", "seq"))
    spans = spark.createDataFrame([(1, 0, 100, "k"), (2, 200, 300, "k"), (3, 0, 99, "k"), (4, 201, 300, "k"), (5, 120, 130, "k"), (6, 0, 1 << 50, "k")], SPAN)
    assert {r["id"] for r in intervals.first_overlaps(spans, held, ["k"]).collect()} == {1, 2, 5, 6}


def test_hot_pair_of_windows_costs_rows_in_proportion(spark):
    """Windows of days over flows of one pair of hosts: 2,000 times 2,000 overlaps, each flow meets less than a hundred rows."""
    n, day = 2000, 86_400_000_000
    flows = spark.createDataFrame([(f"f{k}", A, 30000 + k, B, 502, "tcp", 30 * day + k * 1_000_000_000, 30 * day + k * 1_000_000_000 + 5_000_000) for k in range(n)], FLOW)
    many = [(n - k, A, 0, B, 502, "TCP", [], ("g", "i", 1, None, None), k * day // 100, 60 * day - k) for k in range(n)]
    found = correlate.brute_force(flows, spark.createDataFrame(many, ANCHOR + ", first_us long, last_us long"))
    assert [tuple(r) for r in found.groupBy("reason", "anchor_seq").count().collect()] == [("temporal", 1, n)]
    execution = found._jdf.queryExecution()
    assert "NestedLoop" not in execution.executedPlan().toString() and "CartesianProduct" not in execution.executedPlan().toString()


def test_one_time_alone_is_the_window(spark):
    rows = anchors(spark, (1, A, 0, B, 502, [], True))
    for column, at, hit in (("first_us", 100_001_000 + 60_000_000, True), ("last_us", 100_001_001 + 60_000_000, False), ("last_us", 40_000_000, True), ("first_us", 39_999_999, False)):
        told = rows.withColumn(column, F.lit(at).cast("long"))
        assert correlate.brute_force(flow(spark), told).count() == hit
    assert correlate.brute_force(flow(spark), rows).count() == 0
