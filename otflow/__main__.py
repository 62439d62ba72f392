"""Command line: captures and a graph export in, an augmented graph out."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.functions import columns as X
from otflow.operators import augment, correlate, flows, graph, grouping, policy, registers
from otflow.sources import assets, graph_text, pcap
from otflow.streaming import flows as streaming
from otflow.streaming import graph_steps


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="otflow", description=__doc__)
    a.add_argument("--base-cypher", required=True, help="graph export to read")
    a.add_argument("--output-cypher", required=True, help="folder of ordered statement files to write")
    a.add_argument("--pcap-dir", required=True)
    a.add_argument("--cache", default=None, help="Parquet folder of decoded packets")
    a.add_argument("--force-rebuild", action="store_true")
    a.add_argument("--assets", default=None)
    a.add_argument("--packet-limit", type=int, default=None, help="frames per capture")
    a.add_argument("--total-packet-limit", type=int, default=None, help="packets of all captures together")
    a.add_argument("--backend", choices=("plain", "full"), default="plain")
    a.add_argument("--streaming", action="store_true", help="read captures as a stream and tell what the new ones change, instead of all at once")
    a.add_argument("--summary-only", action="store_true")
    a.add_argument("--min-aggregation-threshold", type=int, default=C.MIN_CLIENT_PORTS)
    a.add_argument("--min-correlation-confidence", type=float, default=0.5)
    a.add_argument("--temporal-tolerance", type=float, default=C.TOLERANCE_S)
    a.add_argument("--disable-process-attribution", action="store_true")
    a.add_argument("--pcap-time-offset", type=float, default=0.0, help="hours added to capture times for correlation")
    a.add_argument("--observations", "--signal-db", default=None, help="Parquet folder of register observations")
    a.add_argument("--summary-fast", "--summary-progress", action="store_true", help="accepted; summaries never measure more than they show")
    a.add_argument("--verify", action="store_true", help="compare with brute force; exit code 1 on a difference")
    return a


def packets_of(spark: SparkSession, o: argparse.Namespace):
    found = pcap.read_captures(spark, o.pcap_dir, o.packet_limit, o.backend == "full", o.total_packet_limit)
    if not o.cache:
        return found
    path = spark._jvm.org.apache.hadoop.fs.Path(o.cache)
    if o.force_rebuild or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        found.write.mode("overwrite").partitionBy("pcap_file").parquet(o.cache)
    return spark.read.parquet(o.cache)


def known_hosts(spark: SparkSession, inventory):
    """hostname, ip, is_managed: the inventory, or without one the addresses with fixed names, none of them managed."""
    if inventory is not None:
        return inventory
    return spark.createDataFrame([(name, ip, False) for ip, name in C.HOST_NAMES.items()], "hostname string, ip string, is_managed boolean")


def base_text(spark: SparkSession, path: str):
    """section, key and text of the lines of a graph export, in their order."""
    place = lambda c: F.lpad(c.cast("string"), 20, "0")
    lines = spark.read.text(path).withColumns({"start": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()})
    return lines.select(F.lit(0).alias("section"), F.concat(place(F.col("start")), place(F.col("line"))).alias("key"), F.col("value").alias("text"))


def stream(spark: SparkSession, o: argparse.Namespace, names: dict[str, str], anchors, hosts) -> int:
    """Take over the captures that are new since the last run, and write the graph as told so far; each step's changes stay beside it."""
    packets = flows.without_ignored(pcap.stream_captures(spark, o.pcap_dir, o.backend == "full", o.packet_limit))
    streaming.run_stats(packets, f"{o.output_cypher}/flow_stats", f"{o.output_cypher}/_checkpoint")
    with X.naming(names):
        graph_steps.run_graph(packets, f"{o.output_cypher}/stream", f"{o.output_cypher}/_checkpoint_graph", anchors, hosts)
    graph.write_text(base_text(spark, o.base_cypher).unionByName(graph_steps.statements(spark, f"{o.output_cypher}/stream")), f"{o.output_cypher}/statements")
    return 0


def main(argv: list[str] | None = None) -> int:
    o = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("otflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    nodes, edges = graph_text.read_graph(spark, o.base_cypher)
    anchors = graph_text.telemetry(nodes, edges)
    inventory = assets.read_assets(spark, o.assets).select("hostname", F.explode("ip_addresses").alias("ip"), "is_managed") if o.assets else None
    if o.streaming:
        return stream(spark, o, augment.names_of(nodes, inventory), anchors if not o.disable_process_attribution else anchors.limit(0), known_hosts(spark, inventory))
    packets = flows.without_ignored(packets_of(spark, o)).persist()
    assembled = flows.assemble(packets).persist()
    if inventory is not None:
        assembled = policy.in_scope(assembled, inventory.select("ip"))
    matches = correlate.session_matches(assembled, anchors, o.temporal_tolerance, o.pcap_time_offset * 3600).where(F.col("confidence") >= o.min_correlation_confidence)
    if o.verify:
        found = correlate.verify(assembled, anchors).groupBy("verdict", "reason").count().collect()
        for r in found:
            print(r["verdict"], r["reason"], r["count"])
        return int(any(r["verdict"] == "false_positive" or r["reason"] == "session_port" for r in found))
    if o.summary_only:
        groups, _ = grouping.run_stages(assembled.join(matches, "canonical_id", "left_anti"), min_ports=o.min_aggregation_threshold)
        graph.summary(assembled, groups).show(truncate=False, vertical=True)
        return 0
    if o.observations:
        registers.observations(packets).write.mode("overwrite").partitionBy("access").parquet(o.observations)
    with X.naming(augment.names_of(nodes, inventory)):
        hosts = known_hosts(spark, inventory)
        found = augment.statements(packets, assembled, anchors, hosts, matches, o.min_aggregation_threshold, not o.disable_process_attribution)
    graph.write_text(base_text(spark, o.base_cypher).unionByName(found), f"{o.output_cypher}/statements")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
