"""Registered queries: each operator applied to the packet view of a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otflow.functions import columns as X
from otflow.operators import augment, correlate, features, flows, graph, grouping, identity, policy, registers, timeline
from otflow.plans import oracles
from otflow.plans.oracles_decode import DECODE_SQL
from otflow.plans.oracles_graph import GRAPH_SQL
from otflow.sources.frame_view import decoded, names_told, services_told
from otflow.sources.host_view import hosts
from otflow.sources.packet_view import packets as packet_view
from otflow.sources.telemetry_view import anchors as telemetry_anchors
from otflow.streaming import flows as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL | GRAPH_SQL | DECODE_SQL


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.without_ignored(packet_view(spark, sf_dir))


def _register(name: str, prepare: Callable[[DataFrame], DataFrame], run: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(prepare(_view(spark, sf_dir)))


def on_packets(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    _register(name, lambda p: p, run)


def on_flows(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    _register(name, flows.assemble, run)


def on_edges(name: str, run: Callable[[DataFrame], DataFrame]) -> None:
    _register(name, features.edge_packets, run)


def on_anchors(name: str, run: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    _register(name, flows.assemble, lambda f: run(f, telemetry_anchors(f)))


def on_observations(name: str, run: Callable[[DataFrame], DataFrame], *series: str) -> None:
    _register(name, registers.observations, lambda o: run(registers.with_series(o, *series)))


SIDES = ("client.ip client_ip", "client.port client_port", "server.ip server_ip", "server.port server_port")
SHORT = ("server_ip", "register", "kind")

on_flows("flow_assembly", lambda f: f.select("canonical_id", *flows.KEY, "first_us", "last_us", "packets", "bytes"))
on_packets("flow_normalized", lambda p: p.select(X.normalized_tuple().alias("t")).groupBy("t.ip_a", "t.port_a").agg(F.count(F.lit(1)).alias("packets")))
on_flows("orient_client_server", lambda f: flows.orient(f).selectExpr("canonical_id", *SIDES))
on_flows("orient_incremental", lambda f: flows.orient(f, use_syn=False).selectExpr("canonical_id", *SIDES))
on_packets(
    "service_port_flag",
    lambda p: p.groupBy(F.col("dst_port").alias("port"), X.is_service_port(F.col("dst_port")).alias("is_service"), X.is_ephemeral(F.col("dst_port")).alias("is_ephemeral")).agg(F.count(F.lit(1)).alias("packets")),
)
on_flows("policy_interesting", lambda f: f.select("canonical_id", policy.interesting().alias("interesting"), policy.interesting_incremental().alias("incremental")))
on_flows("group_modbus", lambda f: grouping.grouped(grouping.stage("modbus").oriented(f)))
on_flows("group_http_monitor", lambda f: grouping.grouped(grouping.stage("http_monitor").oriented(f)))
on_flows("group_mqtt", lambda f: grouping.grouped(grouping.stage("mqtt").oriented(f)))
on_flows("group_opcua", lambda f: grouping.grouped(grouping.stage("opcua").oriented(f)))
on_flows("group_collapsed", grouping.collapsed)
on_flows("individual_flows", lambda f: grouping.individual(f.where(policy.interesting())).select("client_ip", "server_ip", "server_port", "protocol", "port_min", "packets", "bytes"))
on_flows("stage_edges", lambda f: grouping.run_stages(f)[0])
on_flows("stage_consumed", lambda f: grouping.run_stages(f)[1].groupBy("stage").agg(F.count(F.lit(1)).alias("flows")))

on_edges("feat_totals", features.totals)
on_edges("feat_directional", features.directional)
on_edges("feat_dominant_protocol", lambda e: features.mode_first(e, "edge", "high_level_protocol", "protocol_label"))
on_edges("feat_tcp_flags", lambda e: features.distinct_in_order(e, F.col("tcp_flags"), "tcp_flags"))
on_edges("feat_retransmits", features.retransmits)
on_edges("feat_mac", features.macs)
on_edges("feat_http_first", features.first_values)
on_edges("feat_mqtt", features.mqtt)
on_edges("feat_opcua", features.opcua)
on_edges("rtt_mean", features.mean_rtt)
on_edges("client_ports", features.client_ports)
on_edges("majority_port", lambda e: features.mode_first(e.withColumn("port", F.when(F.col("side") == "out", F.col("src_port")).when(F.col("side") == "in", F.col("dst_port"))), "edge", "port", "port"))
on_edges("edge_features", features.edge_rows)

on_anchors("corr_candidates", correlate.candidates)
on_anchors("corr_exact", lambda f, a: correlate.candidates(f, a).where("tier < 2").drop("tier"))
on_anchors("corr_service_endpoint", lambda f, a: correlate.candidates(f, a).where("tier >= 2").drop("tier"))
on_anchors("corr_session_port", correlate.session_matches)
on_anchors("corr_stats", correlate.correlation_stats)
on_anchors("session_coverage", lambda f, a: correlate.session_coverage(a))
on_anchors("process_lookup", lambda f, a: correlate.process_lookup(f.withColumnRenamed("canonical_id", "conn_id"), a))
on_anchors("verify_bruteforce", correlate.brute_force)
on_anchors("verify_diff", correlate.verify)

on_observations("asof_request", lambda o: o.where("not is_request").select("client_ip", "server_ip", "register", "access", "ts_us", "request_us"))
on_observations("register_stats", registers.statistics)
on_observations("register_state_changes", registers.state_changes, *SHORT)
on_observations("register_bucket_distinct", registers.bucket_distinct, *SHORT)
on_observations("register_top_values", registers.top_values, *SHORT)
on_observations("register_rle", registers.run_lengths, *SHORT)
on_observations("obs_table", lambda o: o.select("series", "access", "value", "function", "ts_us", "packet_index"))
on_observations("obs_stats", registers.observation_statistics)
on_observations("write_ack", registers.acknowledged)
on_packets("signal_opcua", lambda p: registers.signal_statistics(registers.opcua_signals(p)))
on_packets("signal_mqtt", lambda p: registers.signal_statistics(registers.mqtt_signals(p)))

on_flows("guid_node", graph.endpoint_nodes)
on_flows("node_dedupe", lambda f: graph.service_nodes(grouping.run_stages(f, ())[0]))
on_observations("guid_signal", graph.signal_nodes)
on_observations("read_write_edges", graph.access_edges)
on_anchors("edge_staging_merge", lambda f, a: graph.merge_staged(graph.staged_edges(f, a)))
on_flows("summary_before_after", lambda f: graph.summary(f, grouping.run_stages(f)[0]))
on_flows("cypher_text", lambda f: graph.node_statements(graph.service_nodes(grouping.grouped(grouping.stage("modbus").oriented(f))), "NetworkService", 1, {"host": "host", "port": "port", "protocol": "protocol", "service_name": "serviceName", "ip": "ipAddress"}))
on_observations("sdt_timeline", timeline.timelines, *SHORT)
on_observations("value_encoding", lambda o: o.groupBy("series").agg(X.value_text(F.sum("value").cast("double") / 4).alias("quarter_text"), X.value_text(F.max("value").cast("double")).alias("max_text")), *SHORT)


def summaries(obs: DataFrame) -> DataFrame:
    """All that is told of each series, in the columns that merge_summaries takes."""
    lines = timeline.timelines(obs).select("series", "timeline", "points", "tolerance")
    out = registers.statistics(obs)
    for part in (registers.state_changes(obs), registers.bucket_distinct(obs), registers.top_values(obs), registers.run_lengths(obs).drop("ratio"), lines):
        out = out.join(part, "series", "left")
    return out.select("series", *timeline.SUMMARY)


def _halves(obs: DataFrame) -> DataFrame:
    """Summaries of the even and the odd packets, to be merged again."""
    even, odd = (summaries(obs.where(F.col("packet_index") % 2 == k)) for k in (0, 1))
    return even.unionByName(odd)


on_observations("summary_merge", lambda o: timeline.merge_summaries(_halves(o)), *SHORT)
on_packets("best_process", lambda p: correlate.best_process(p.select(F.col("dst_ip").alias("group_id"), F.col("dst_port").alias("port"), F.col("src_mac").alias("process_guid")).where("process_guid <> ''")))
on_packets("tcp_flag_text", lambda p: p.groupBy(X.tcp_flag_text((F.col("packet_index") % 64).cast("int")).alias("flags")).agg(F.count(F.lit(1)).alias("packets")))
on_packets("flow_stats", streaming.flow_stats)
on_anchors("edge_processes", identity.edge_processes)
on_anchors("client_identity", lambda f, a: identity.client_identities(f, a, hosts(f.sparkSession)))
on_anchors("telemetry_rollup", identity.telemetry_rollup)
on_flows("ownership_edges", lambda f: identity.ownership(graph.service_nodes(grouping.grouped(grouping.stage("modbus").oriented(f))), hosts(f.sparkSession)))
on_observations("signal_containers", identity.containers)
on_anchors("completeness", identity.completeness)
on_packets("packet_sample", lambda p: identity.sample(p, 3).select("canonical_id", "place", "packet_index", "ts_us"))
on_flows("asset_scope", lambda f: policy.in_scope(f, hosts(f.sparkSession).where("not is_managed")).select("canonical_id", "src_ip", "dst_ip"))
on_flows("group_incremental", lambda f: grouping.grouped(flows.orient(f.where(policy.interesting_incremental()), use_syn=False)))


def _attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = _view(spark, sf_dir)
    assembled = flows.assemble(packets)
    return identity.signal_attribution(assembled, telemetry_anchors(assembled), registers.observations(packets))


QUERIES["signal_attribution"] = _attribution


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """READ_SIGNAL and WRITE_SIGNAL edges from each client's process, or its stand-in, to registers and float signals."""
    packets = _view(spark, sf_dir)
    assembled = flows.assemble(packets)
    identities = identity.client_identities(assembled, telemetry_anchors(assembled), hosts(spark))
    keys = ("series", "edge", "access", "ts_us")
    told = augment.modbus_rows(packets).select(*keys).unionByName(augment.float_rows(packets).select(*keys))
    return augment.accesses(told, identities)


QUERIES["access_by_process"] = _accesses
on_observations("encoded_decode", lambda o: timeline.decode_counts(registers.top_values(o), "top_values"), *SHORT)
on_packets("traffic_windows", streaming.traffic_windows)


def on_frames(name: str, condition: str, *columns: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: decoded(spark, sf_dir).where(condition).selectExpr("tcp_seq", *columns)


_HEAD = ("tcp_ack", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "high_level_protocol", "tcp_flags", "ip_layer_index", "ip_layer_count", "src_mac", "dst_mac")
on_frames("decode_headers", "true", *_HEAD)
on_frames("decode_modbus", "modbus_function is not null", "modbus_function function", "modbus_unit_id unit", "modbus_transaction_id transaction", "array_join(modbus_registers, ',') registers", "array_join(modbus_register_values, ',') values")
on_frames("decode_http", "http_method is not null or http_status is not null", "http_method", "http_path", "http_host", "http_status", "http_content_type")
on_frames("decode_mqtt", "mqtt_packet_type is not null", "mqtt_packet_type", "mqtt_topic", "mqtt_qos", "mqtt_retain", "mqtt_packet_id", "mqtt_client_id", "mqtt_keepalive", "mqtt_payload_values[0].value value")
on_frames("decode_opcua", "opcua_message_type is not null", "opcua_message_type", "opcua_chunk_type", "opcua_endpoint_url", "opcua_secure_channel_id", "opcua_security_policy_uri")
on_frames("decode_tls", "443 in (src_port, dst_port)", "tls_sni")
QUERIES["decode_names"] = names_told
QUERIES["decode_opcua_services"] = services_told
on_packets("service_port_inferred", lambda p: p.groupBy(X.inferred_service_port(F.col("src_port"), F.col("dst_port")).alias("port")).agg(F.count(F.lit(1)).alias("packets")))
on_packets("guid_running", lambda p: p.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().select("ip", X.running_guid(F.lit("NetworkEndpoint"), X.host_name(F.col("ip"))).alias("guid")))
on_packets("signal_mqtt_encoded", lambda p: _float_encodings(registers.mqtt_signals(p)))


def _float_encodings(rows: DataFrame) -> DataFrame:
    """Runs, distinct and top values of float signals."""
    whole = registers.quantised(rows)
    return registers.run_lengths(whole).select("series", "runs", "ratio", "truncated").join(registers.bucket_distinct(whole), "series").join(registers.top_values(whole), "series")


def _existing(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Updates of edges that telemetry has, where no edge of the stages for other flows has their ends."""
    left = flows.join(correlate.session_matches(flows, anchors), "canonical_id", "left_anti")
    groups, _ = grouping.run_stages(left)
    known = augment.known_groups(groups, identity.client_identities(flows, anchors, hosts(flows.sparkSession)))
    return augment.existing_edges(flows, anchors, augment.staged_relationships(known))


on_anchors("existing_edges", _existing)
