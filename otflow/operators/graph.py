"""Nodes and edges of the provenance graph as tables, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.functions import columns as X


def endpoint_guid(host: Column) -> Column:
    return X.guid(F.lit("NetworkEndpoint"), host)


def service_guid(host: Column, port: Column) -> Column:
    """Host and port name a service; its protocol takes no part."""
    return X.guid(F.lit("NetworkService"), host, F.greatest(F.coalesce(port, F.lit(0)), F.lit(0)))


def dedupe_nodes(nodes: DataFrame, *order: str) -> DataFrame:
    """One row per guid: the first writer's, by the order columns."""
    first = Window.partitionBy("guid").orderBy(*order)
    return nodes.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def endpoint_nodes(flows: DataFrame) -> DataFrame:
    """guid, host and addresses of every endpoint of flows, with the time it was first seen."""
    ends = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "first_us")
    host = X.host_name(F.col("ip"))
    return ends.groupBy(host.alias("host")).agg(F.array_join(F.sort_array(F.collect_set("ip")), ",").alias("addresses"), F.min("first_us").alias("first_us")).withColumn("guid", endpoint_guid(F.col("host")))


def service_nodes(edges: DataFrame) -> DataFrame:
    """guid, host, port, protocol, service_name, ip of the services that edges lead to; the earliest edge describes a service."""
    host = X.host_name(F.col("server_ip"))
    rows = edges.select(service_guid(host, F.col("server_port")).alias("guid"), host.alias("host"), F.col("server_port").alias("port"), F.upper("protocol").alias("protocol"), X.service_name(F.col("server_port")).alias("service_name"), F.col("server_ip").alias("ip"), "first_us", "client_ip")
    return dedupe_nodes(rows, "first_us", "ip", "client_ip").drop("first_us", "client_ip")


def signal_nodes(obs: DataFrame) -> DataFrame:
    """guid and key of every Modbus register."""
    host = X.host_name(F.col("server_ip"))
    key = F.concat_ws("|", F.lit("modbus"), F.lower(host), F.lit(str(C.MODBUS_PORT)), F.col("unit").cast("string"), "kind", F.col("register").cast("string"))
    guid = X.signal_guid(F.lit("modbus"), host, F.lit(C.MODBUS_PORT), F.col("unit"), F.col("kind"), F.col("register"))
    return obs.groupBy(guid.alias("guid"), key.alias("signal_key")).agg(F.count(F.lit(1)).alias("samples"))


def access_edges(obs: DataFrame) -> DataFrame:
    """READ_SIGNAL and WRITE_SIGNAL edges per client and register: counts and last time, where there were any."""
    host = X.host_name(F.col("server_ip"))
    guid = X.signal_guid(F.lit("modbus"), host, F.lit(C.MODBUS_PORT), F.col("unit"), F.col("kind"), F.col("register"))
    kind = F.when(F.col("access") == "read", "READ_SIGNAL").otherwise("WRITE_SIGNAL")
    return obs.groupBy(X.host_name(F.col("client_ip")).alias("source"), guid.alias("target"), kind.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us"))


SUMMED = ("packets", "bytes", "flows")


def merge_staged(staged: DataFrame) -> DataFrame:
    """One edge per (src, dst, rel) from staged ones with seq: sums, first and last times, ored flags, else the last non-null value.

    Client ports are unioned, and what derives from them is computed anew: a
    single port stays, several read 'aggregated', up to eight are listed. Of
    protocols several read 'mixed'.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    key = ["src", "dst", "rel"]
    # A set of ports has a bound, a list of all flows' ports has none.
    ports = staged.select(*key, F.explode("ports").alias("port")).groupBy(*key).agg(F.sort_array(F.collect_set("port")).alias("_ports"))
    sums = staged.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in SUMMED],
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.coalesce(F.bool_or("correlated"), F.lit(False)).alias("correlated"),
        last("stage").alias("stage"),
        F.sort_array(F.collect_set("protocol")).alias("_protocols"),
    )
    merged = sums.join(ports, key, "left").withColumn("_ports", F.coalesce("_ports", F.array().cast("array<int>")))
    n = F.size("_ports")
    return merged.select(
        "src", "dst", "rel", *SUMMED, "first_us", "last_us", "correlated", "stage",
        n.cast("long").alias("unique_ports"), F.try_element_at("_ports", F.lit(1)).alias("port_min"), F.try_element_at("_ports", F.lit(-1)).alias("port_max"),
        F.when(n == 1, F.element_at("_ports", 1).cast("string")).when(n > 1, "aggregated").alias("source_port"),
        F.when((n > 1) & (n <= 8), F.array_join(F.col("_ports").cast("array<string>"), ",")).alias("port_set"),
        F.when(F.size("_protocols") > 1, "mixed").otherwise(F.try_element_at("_protocols", F.lit(1))).alias("protocol"),
        F.round(F.col("bytes") / F.col("flows"), 2).alias("mean_bytes"),
    )


def staged_edges(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Flows as staged edges between a client's host and a service, for merging."""
    from otflow.operators.correlate import session_matches
    from otflow.operators.flows import orient

    known = orient(flows).where("client is not null").join(session_matches(flows, anchors).select("canonical_id", F.lit(True).alias("correlated")), "canonical_id", "left")
    host = X.host_name(F.col("server.ip"))
    return known.select(
        X.host_name(F.col("client.ip")).alias("src"), service_guid(host, F.col("server.port")).alias("dst"), F.lit("CONNECT_TO").alias("rel"), "packets", "bytes", F.lit(1).cast("long").alias("flows"),
        "first_us", "last_us", F.coalesce("correlated", F.lit(False)).alias("correlated"), X.service_name(F.col("server.port")).alias("stage"), "protocol", F.array("client.port").alias("ports"), F.col("first_index").alias("seq"),
    )


def summary(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Before and after aggregation: nodes and edges of raw flows, of edges, and what was saved."""
    raw = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).agg(F.count_distinct("ip").alias("raw_endpoints"))
    counts = flows.agg(F.count(F.lit(1)).alias("raw_edges"), F.count_distinct("dst_ip", "dst_port").alias("raw_services"))
    after = edges.agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_distinct("server_ip", "server_port").alias("services"),
        *[F.count_if(F.col("stage") == s).alias(f"{s}_edges") for s in ("modbus", "http_monitor", "mqtt", "opcua", "collapsed", "individual")],
    )
    one = lambda df: df.withColumn("_k", F.lit(1))
    joined = one(raw).join(one(counts), "_k").join(one(after), "_k").drop("_k")
    return joined.withColumns({"edges_saved": F.col("raw_edges") - F.col("edges"), "services_saved": F.col("raw_services") - F.col("services")})


def literal(value: Column, kind: str) -> Column:
    """A property value in graph text; quotes and backslashes are escaped."""
    if kind == "boolean":
        return F.when(value, "true").otherwise("false")
    if kind in ("tinyint", "smallint", "int", "bigint", "double", "float"):
        return value.cast("string")
    text = value.cast("string")
    for c in ("\\", "'", '"'):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return F.concat(F.lit("'"), text, F.lit("'"))


def property_map(df: DataFrame, names: dict[str, str]) -> Column:
    """'{key: value, ...}' of columns by property name; nulls are left out."""
    kinds = dict(df.dtypes)
    parts = [F.concat(F.lit(f"{key}: "), literal(F.col(c), kinds[c])) for c, key in names.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def node_statements(nodes: DataFrame, label: str, section: int, names: dict[str, str]) -> DataFrame:
    """section, key and text of one idempotent statement per node."""
    guid = literal(F.col("guid"), "string")
    text = F.concat(F.lit(f"MERGE (n:{label} {{guid: "), guid, F.lit("})\nON CREATE SET n += "), property_map(nodes, names), F.lit("\nSET n.pcapAugmented = true;"))
    return nodes.select(F.lit(section).alias("section"), F.col("guid").alias("key"), text.alias("text"))


def edge_statements(edges: DataFrame, section: int, names: dict[str, str]) -> DataFrame:
    """section, key and text of one idempotent statement per edge of src, dst (guids) and rel."""
    text = F.concat(
        F.lit("MATCH (a {guid: "), literal(F.col("src"), "string"), F.lit("}), (b {guid: "), literal(F.col("dst"), "string"), F.lit("})\nMERGE (a)-[r:"), F.col("rel"), F.lit("]->(b)\nSET r += "), property_map(edges, names), F.lit(";"),
    )
    return edges.select(F.lit(section).alias("section"), F.concat_ws("|", "src", "dst", "rel").alias("key"), text.alias("text"))


def write_text(statements: DataFrame, path: str) -> None:
    """Write statements in the order of section and key, as text files whose names keep that order; how many depends on their size."""
    statements.repartitionByRange("section", "key").sortWithinPartitions("section", "key").select("text").write.mode("overwrite").text(path)
