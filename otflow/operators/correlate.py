"""Correlation of flows with telemetry anchors, and the processes behind connections.

An anchor is a connection that a host reported: anchor_seq (its place in the
telemetry), src_ip, src_port, dst_ip, dst_port, protocol, sessions (an array of
port and ts_us), process (a struct of guid, image, pid, user, computer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.functions import columns as X
from otflow.operators import intervals


def valid_process() -> Column:
    return (F.coalesce("process.guid", F.lit("")) != "") | (F.coalesce("process.image", F.lit("")) != "")


def has_sessions() -> Column:
    return F.size("sessions") > 0


def anchor_keys(anchors: DataFrame) -> DataFrame:
    """One row per key under which an anchor is found: kind (exact or service), the key's columns, anchor_seq.

    A service key leaves out the client's port; an anchor with a client port is
    also found under the reversed key.
    """
    protocol = F.lower("protocol")
    none = F.lit(None).cast("int")
    key = lambda kind, a, ap, b, bp: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), ap.alias("ap"), F.col(b).alias("b"), F.col(bp).alias("bp"), protocol.alias("proto"))
    keys = F.array(
        key("exact", "src_ip", F.col("src_port"), "dst_ip", "dst_port"),
        key("service", "src_ip", none, "dst_ip", "dst_port"),
        F.when(F.col("src_port") > 0, key("service", "dst_ip", none, "src_ip", "src_port")),
    )
    return anchors.select("anchor_seq", F.explode(F.array_compact(keys)).alias("k")).select("anchor_seq", "k.*").distinct()


def candidates(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """canonical_id, anchor_seq, tier: anchors that share a key with a flow, each with its first tier.

    Tiers: 0 exact, 1 exact reversed, 2 service, 3 service reversed.
    """
    wanted, keys = flow_keys(flows), anchor_keys(anchors)
    return wanted.join(keys, _same(wanted, keys)).groupBy("canonical_id", "anchor_seq").agg(F.min("tier").alias("tier"))


def flow_keys(flows: DataFrame, *more: Column) -> DataFrame:
    """One row per tier under which a flow looks for anchors: canonical_id, more columns, tier and the key's columns."""
    none = F.lit(None).cast("int")
    look = lambda tier, kind, a, ap, b, bp: F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), F.col(a).alias("a"), ap.alias("ap"), F.col(b).alias("b"), F.col(bp).alias("bp"), F.lower("protocol").alias("proto"))
    looks = F.array(
        look(0, "exact", "src_ip", F.col("src_port"), "dst_ip", "dst_port"),
        look(1, "exact", "dst_ip", F.col("dst_port"), "src_ip", "src_port"),
        look(2, "service", "src_ip", none, "dst_ip", "dst_port"),
        look(3, "service", "dst_ip", none, "src_ip", "src_port"),
    )
    return flows.select("canonical_id", *more, F.explode(looks).alias("k")).select("*", "k.*").drop("k")


def _same(wanted: DataFrame, keys: DataFrame) -> list[Column]:
    return [wanted[c] == keys[c] for c in ("kind", "a", "b", "bp", "proto")] + [wanted["ap"].eqNullSafe(keys["ap"])]


KEY = ("kind", "a", "ap", "b", "bp", "proto")


def met_sessions(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The first anchor, with place and time of the session, for each key of a flow and port of its ends: at most eight rows for a flow."""
    # Of the anchors with one key and session port only the first can win, so a flow meets one row for each of its keys and ports.
    ports = anchors.select("anchor_seq", F.posexplode("sessions").alias("place", "s")).select("anchor_seq", "place", F.col("s.port").alias("port"), F.col("s.ts_us").alias("ts_us"))
    keys = anchor_keys(anchors).join(ports, "anchor_seq").groupBy(*KEY, "port").agg(F.min(F.struct("anchor_seq", "place", "ts_us")).alias("first"))
    wanted = flow_keys(flows, F.col("first_us"), F.array("src_port", "dst_port").alias("ports"))
    wanted = wanted.withColumns({"side": F.explode(F.array(F.lit(0), F.lit(1)))}).withColumn("port", F.get("ports", F.col("side"))).drop("ports")
    return wanted.join(keys, [*_same(wanted, keys), wanted["port"] == keys["port"]])


def session_matches(flows: DataFrame, anchors: DataFrame, tolerance_s: float = C.TOLERANCE_S, offset_s: float = 0.0) -> DataFrame:
    """The correlated flows: canonical_id, anchor_seq, tier, confidence, method.

    Candidates are tried by tier, then by the anchors' order; the first one that
    has a session with either origin port wins, the origin's source port being
    looked up first. Confidence is 1.0 within the tolerance of the session's
    time, else 0.9.
    """
    met = met_sessions(flows, anchors)
    best = met.groupBy("canonical_id").agg(F.min(F.struct("tier", "first.anchor_seq", "side", "first.ts_us", "first_us")).alias("best")).select("canonical_id", "best.*")
    near = F.abs(F.col("first_us") + int(offset_s * 1e6) - F.col("ts_us")) <= int(tolerance_s * 1e6)
    return best.select("canonical_id", "anchor_seq", "tier", F.when(near, 1.0).otherwise(0.9).alias("confidence"), F.when(near, "session_port_exact").otherwise("session_port_match").alias("method"))


def correlation_stats(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: attempts, correlated, without candidates."""
    wanted, keys = flow_keys(flows), anchor_keys(anchors).select(*KEY).distinct()
    known = wanted.join(keys, _same(wanted, keys), "left_semi").select("canonical_id").distinct().withColumn("c", F.lit(1))
    tried = flows.select("canonical_id").join(known, "canonical_id", "left")
    tried = tried.join(session_matches(flows, anchors).select("canonical_id", "confidence"), "canonical_id", "left")
    return tried.agg(F.count(F.lit(1)).alias("attempts"), F.count("confidence").alias("correlated"), F.count_if(F.col("c").isNull()).alias("no_candidates"), F.count_if(F.col("confidence") == 1.0).alias("exact"))


def session_coverage(anchors: DataFrame) -> DataFrame:
    """Anchors, those with sessions, their ports and the share of both."""
    return anchors.agg(
        F.count(F.lit(1)).alias("anchors"),
        F.count_if(has_sessions()).alias("with_sessions"),
        F.sum(F.size("sessions")).alias("session_ports"),
        F.round(F.try_divide(F.count_if(has_sessions()), F.count(F.lit(1))), 4).alias("coverage"),
    )


def process_lookup(connections: DataFrame, anchors: DataFrame, require_port: bool = False) -> DataFrame:
    """connections (conn_id, src_ip, src_port, dst_ip, dst_port, protocol) with the process that telemetry names.

    Stages: address, address reversed, host name, host name reversed. Within a
    forward stage an anchor with the connection's source port comes first, and
    with require_port only such a one counts; reversed stages take the first
    anchor. Host names only count where one of both addresses has one.
    """
    good = anchors.where(valid_process())
    host = X.host_name
    ends = good.select("anchor_seq", F.lower("protocol").alias("proto"), "src_ip", "src_port", "dst_ip", "dst_port", "sessions")
    keyed = ends.select("anchor_seq", "proto", F.lit(False).alias("by_host"), F.col("src_ip").alias("a"), F.col("dst_ip").alias("b"), F.col("dst_port").alias("bp"), "src_port", "sessions")
    back = ends.where("src_port > 0").select("anchor_seq", "proto", F.lit(False).alias("by_host"), F.col("dst_ip").alias("a"), F.col("src_ip").alias("b"), F.col("src_port").alias("bp"), "src_port", "sessions")
    both = keyed.unionByName(back)
    both = both.unionByName(both.withColumns({"by_host": F.lit(True), "a": host(F.col("a")), "b": host(F.col("b"))})).distinct()

    named = (host(F.col("src_ip")) != F.col("src_ip")) | (host(F.col("dst_ip")) != F.col("dst_ip"))
    proto = F.lower("protocol").alias("proto")
    look = lambda stage, by_host, a, b, bp: F.struct(F.lit(stage).alias("stage"), F.lit(by_host).alias("by_host"), a.alias("a"), b.alias("b"), F.col(bp).alias("bp"), proto)
    s, d = F.col("src_ip"), F.col("dst_ip")
    looks = F.array_compact(
        F.array(
            look(0, False, s, d, "dst_port"),
            look(1, False, d, s, "src_port"),
            F.when(named, look(2, True, host(s), host(d), "dst_port")),
            F.when(named, look(3, True, host(d), host(s), "src_port")),
        )
    )
    wanted = connections.select("conn_id", F.col("src_port").alias("own_port"), F.explode(looks).alias("k")).select("conn_id", "own_port", "k.*")
    # A connection meets one row for its key, and one for its key and port: the first anchors of those.
    key = ("by_host", "a", "b", "bp", "proto")
    any_port = both.groupBy(*key).agg(F.min("anchor_seq").alias("anchor_seq"))
    ports = F.array_union(F.array("src_port"), F.transform("sessions", lambda x: x["port"]))
    same_port = both.select(*key, "anchor_seq", F.explode(ports).alias("own_port")).where("own_port > 0").groupBy(*key, "own_port").agg(F.min("anchor_seq").alias("anchor_seq"))
    forward = F.col("stage").isin(0, 2)
    exact = wanted.where(forward).join(same_port, [*key, "own_port"]).withColumn("later", F.lit(0))
    other = wanted.join(any_port, list(key)).withColumn("later", F.lit(1))
    if require_port:
        other = other.where(~forward | (F.col("own_port") <= 0))
    met = exact.select("conn_id", "stage", "later", "anchor_seq").unionByName(other.select("conn_id", "stage", "later", "anchor_seq"))
    best = met.groupBy("conn_id").agg(F.min(F.struct("stage", "later", "anchor_seq")).alias("best")).select("conn_id", "best.stage", "best.anchor_seq")
    return best.join(good.select("anchor_seq", "process"), "anchor_seq").select("conn_id", "stage", "anchor_seq", F.col("process.guid").alias("process_guid"), F.col("process.image").alias("process_image"))


def best_process(found: DataFrame) -> DataFrame:
    """Per group (columns group_id, port, process_guid) the process of most ports; of equals that of the smallest port."""
    counts = found.where("process_guid is not null").groupBy("group_id", "process_guid").agg(F.count(F.lit(1)).alias("matches"), F.min("port").alias("port"))
    order = Window.partitionBy("group_id").orderBy(F.col("matches").desc(), "port", "process_guid")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("group_id", "process_guid", "matches", "port")


def windows(anchors: DataFrame) -> DataFrame:
    """anchors with first_us and last_us, their time window: of one time alone it is that time, without any there is none."""
    have = {c: F.col(c) if c in anchors.columns else F.lit(None).cast("long") for c in ("first_us", "last_us")}
    return anchors.withColumns({"first_us": F.coalesce(have["first_us"], have["last_us"]), "last_us": F.coalesce(have["last_us"], have["first_us"])})


def brute_force(flows: DataFrame, anchors: DataFrame, tolerance_s: float = C.TOLERANCE_S) -> DataFrame:
    """The verifier's matches: either address direction, the server's port and protocol, then a session port or overlapping times.

    The first anchor of a flow that has a session with one of its ports, or
    whose window, widened by the tolerance, overlaps the flow's. Ports are
    looked up among the first anchors of each port, windows by
    intervals.first_overlaps, so that a pair that many flows and anchors share
    doesn't meet row by row.
    """
    sp, dp = F.col("src_port"), F.col("dst_port")
    server = F.when(X.is_service_port(dp), dp).when(X.is_service_port(sp), sp).otherwise(dp)
    key = ["x", "y", "server", "proto"]
    ends = [F.least("src_ip", "dst_ip").alias("x"), F.greatest("src_ip", "dst_ip").alias("y")]
    own = flows.select(F.col("canonical_id").alias("id"), "first_us", "last_us", F.array("src_port", "dst_port").alias("ports"), *ends, server.alias("server"), F.lower("protocol").alias("proto"))
    theirs = windows(anchors).select(F.col("anchor_seq").alias("seq"), *ends, F.col("dst_port").alias("server"), F.lower("protocol").alias("proto"), "sessions", "first_us", "last_us")
    first = theirs.select("seq", *key, F.explode("sessions.port").alias("port")).groupBy(*key, "port").agg(F.min("seq").alias("seq"))
    by_port = own.select("id", *key, F.explode(F.array_distinct("ports")).alias("port")).join(first, [*key, "port"]).groupBy("id").agg(F.min("seq").alias("port_seq"))
    wide = int(tolerance_s * 1e6)
    spans = own.select("id", F.col("first_us").alias("begin"), F.col("last_us").alias("end"), *key)
    by_time = intervals.first_overlaps(spans, theirs.select("seq", (F.col("first_us") - wide).alias("begin"), (F.col("last_us") + wide).alias("end"), *key), key)
    hits = by_port.join(by_time, "id", "full_outer")
    anchor = F.least("port_seq", "seq")
    reason = F.when(F.col("port_seq") == anchor, "session_port").otherwise("temporal")
    return hits.select(F.col("id").alias("canonical_id"), reason.alias("reason"), anchor.alias("anchor_seq"))


def verify(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Flows that only one of both finds: canonical_id, verdict ('missed' or 'false_positive'), reason."""
    engine = session_matches(flows, anchors).select("canonical_id", F.col("anchor_seq").alias("engine_anchor"))
    oracle = brute_force(flows, anchors)
    both = engine.join(oracle, "canonical_id", "full_outer")
    verdict = F.when(F.col("engine_anchor").isNull(), "missed").when(F.col("anchor_seq").isNull(), "false_positive")
    return both.withColumn("verdict", verdict).where("verdict is not null").select("canonical_id", "verdict", F.coalesce("reason", F.lit("no anchor")).alias("reason"))
