"""The whole augmented graph as ordered statements: nodes, ownership and relationships that captures tell."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.functions import columns as X
from otflow.operators import correlate, features, graph, grouping, identity, registers, timeline

#: The headings of the sections, in their order.
HEADINGS = (
    "// === PCAP Augmentation (Missing Traffic) ===",
    "// PCAP-Inferred NetworkEndpoint Nodes",
    "// PCAP-Inferred NetworkService Nodes",
    "// PCAP-Inferred External NetworkEndpoint Nodes",
    "// PCAP-Inferred ICSSignal Nodes",
    "// PCAP-Inferred SignalContainer Nodes",
    "// Virtual Process Nodes for PLCs/RTUs",
    "// Process Ownership Relationships (RUN_ON/BINDS)",
    "// PCAP-Inferred Network Relationships",
)
ENDPOINTS, SERVICES, EXTERNAL, SIGNALS, CONTAINERS, PROCESSES, OWNERSHIP, RELATIONSHIPS = range(2, 10)

SIGNAL_PROPERTIES = {
    "protocol": "protocol", "name": "name", "reads": "readCount", "writes": "writeCount", "samples": "valueSamples", "mean_value": "meanValue", "min_value": "minValue", "max_value": "maxValue",
    "last_value": "lastValue", "last_us": "lastSeenMicros", "last_write_us": "lastWriteMicros", "functions": "functionCodes", "changes": "stateChanges", "buckets": "distinctValuesApprox",
    "top_values": "topValues", "rle": "valueRLE", "runs": "rleRuns", "ratio": "rleCompressionRatio", "truncated": "rleTruncated",
    "timeline": "valueTimeline", "points": "timelinePoints", "tolerance": "timelineTolerance", "timeline_ratio": "timelineCompressionRatio",
}


def names_of(nodes: DataFrame, inventory: DataFrame | None = None) -> dict[str, str]:
    """Host names by address: the inventory's, else those of the graph's endpoints, else the fixed ones.

    One entry for each address of an inventory or export reaches the driver. Of
    several names in a graph the last statement's counts, in an inventory the
    first in order.
    """
    told = nodes.where("label = 'NetworkEndpoint' and host is not null").select(F.explode("ips").alias("ip"), "host", "seq")
    found = [told.groupBy("ip").agg(F.max_by("host", F.struct("seq", "host")).alias("host"))]
    if inventory is not None:
        found.append(inventory.where("hostname is not null").groupBy("ip").agg(F.min("hostname").alias("host")))
    out = dict(C.HOST_NAMES)
    for source in found:
        out |= {r["ip"]: r["host"] for r in source.collect()}
    return out


def _server(to_server: Column) -> list[Column]:
    ends = {"client_ip": ("src_ip", "dst_ip"), "server_ip": ("dst_ip", "src_ip"), "server_port": ("dst_port", "src_port")}
    return [F.when(to_server, F.col(a)).otherwise(F.col(b)).alias(c) for c, (a, b) in ends.items()]


def _edge() -> Column:
    return F.concat("client_ip", F.lit(">"), "server_ip", F.lit(":"), F.col("server_port").cast("string"), F.lit("/tcp"))


def modbus_rows(packets: DataFrame) -> DataFrame:
    """Register observations with the signal's guid as series, its host, name and the edge that they belong to."""
    obs = registers.observations(packets).withColumn("server_port", F.lit(C.MODBUS_PORT))
    host = X.host_name(F.col("server_ip"))
    guid = X.signal_guid(F.lit("modbus"), host, F.lit(C.MODBUS_PORT), F.col("unit"), F.col("kind"), F.col("register"))
    name = F.concat_ws("|", F.lit("modbus"), F.lower(host), F.lit(str(C.MODBUS_PORT)), F.col("unit").cast("string"), "kind", F.col("register").cast("string"))
    return obs.withColumns({"series": guid, "host": host, "name": name, "protocol": F.lit("modbus"), "edge": _edge()})


def float_rows(packets: DataFrame) -> DataFrame:
    """The same for numeric fields of MQTT messages and values of OPC UA nodes."""
    parts = []
    for protocol, rows, to_server in (("mqtt", registers.mqtt_signals(packets), F.col("dst_port").isin(*C.MQTT_PORTS)), ("opcua", registers.opcua_signals(packets), F.col("dst_port") == C.OPCUA_PORT)):
        told = rows.select(F.col("series").alias("name"), "access", "value", "ts_us", "pcap_file", "packet_index", *_server(to_server))
        host = X.host_name(F.col("server_ip"))
        told = told.withColumns({"host": host, "protocol": F.lit(protocol), "edge": _edge()})
        parts.append(told.withColumn("series", X.signal_guid(F.lit(protocol), host, F.col("server_port"), F.col("name"))))
    return parts[0].unionByName(parts[1])


def signal_summary(rows: DataFrame, statistics: DataFrame) -> DataFrame:
    """guid, host and all that is told of each series: statistics, distinct and top values, runs and timeline.

    Counted and run are whole values; the timeline keeps the values as they are.
    """
    whole = registers.quantised(rows)
    named = rows.groupBy(F.col("series").alias("guid")).agg(F.min("host").alias("host"), F.min("name").alias("name"), F.min("protocol").alias("protocol"))
    whole = whole.persist(StorageLevel.MEMORY_AND_DISK)
    lines = timeline.timelines(rows).select("series", "timeline", "points", "tolerance", F.col("ratio").alias("timeline_ratio"))
    out = statistics
    for part in (registers.bucket_distinct(whole), registers.top_values(whole), registers.run_lengths(whole), lines):
        out = out.join(part, "series", "left")
    return named.join(out.withColumnRenamed("series", "guid"), "guid")


def signals(modbus: DataFrame, floats: DataFrame) -> DataFrame:
    """The summaries of all signals."""
    numbers = signal_summary(modbus, registers.statistics(modbus).join(registers.state_changes(modbus), "series", "left"))
    counts = floats.groupBy("series").agg(F.count(F.lit(1)).alias("samples"), F.max("ts_us").alias("last_us"))
    return numbers.unionByName(signal_summary(floats, registers.signal_statistics(floats).join(counts, "series")), allowMissingColumns=True)


def attached(nodes: DataFrame, label: str, section: int, names: dict[str, str], target: Column, target_label: str, pattern: str, update: bool = True) -> DataFrame:
    """section, key and text of one idempotent statement per node that also ties it to a target; pattern is of n and m."""
    guid, props = graph.literal(F.col("guid"), "string"), graph.property_map(nodes, names)
    parts = [F.lit(f"MATCH (m:{target_label} {{guid: "), graph.literal(target, "string"), F.lit(f"}})\nMERGE (n:{label} {{guid: "), guid, F.lit("})\nON CREATE SET n += "), props]
    parts += [F.lit("\nSET n += "), props] if update else []
    return nodes.select(F.lit(section).alias("section"), F.col("guid").alias("key"), F.concat(*parts, F.lit(f"\nSET n.pcapAugmented = true\nMERGE {pattern};")).alias("text"))


def tied(edges: DataFrame, section: int) -> DataFrame:
    """section, key and text of one statement per edge of src, dst and rel without properties."""
    text = F.concat(F.lit("MATCH (a {guid: "), graph.literal(F.col("src"), "string"), F.lit("}), (b {guid: "), graph.literal(F.col("dst"), "string"), F.lit("})\nMERGE (a)-[:"), F.col("rel"), F.lit("]->(b);"))
    return edges.select(F.lit(section).alias("section"), F.concat_ws("|", "src", "dst", "rel").alias("key"), text.alias("text"))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(p.capitalize() for p in rest)


EDGE_PROPERTIES_OF_GROUPS = {
    "packets": "packetCount", "bytes": "totalBytes", "flows": "canonicalCount", "unique_ports": "uniqueSourcePorts", "source_port": "SourcePort", "port_min": "sourcePortMin", "port_max": "sourcePortMax",
    "port_set": "sourcePortSet", "mean_bytes": "meanBytesPerFlow", "protocol": "Protocol", "stage": "highLevelProtocol",
}
#: Features whose properties aren't named like their columns.
FEATURE_PROPERTIES = {"mean_size": "avgPacketSize", "duration_s": "durationSeconds", "mean_gap_s": "meanInterArrivalPacketTime", "directionality": "directionalityIndex", "tls_sni": "tlsSNI"}
EDGE_PROPERTIES = EDGE_PROPERTIES_OF_GROUPS | {"confidence": "correlationConfidence", "kind": "attribution"}


def staged_relationships(known: DataFrame) -> DataFrame:
    """The merged edges of the stages' groups; known: groups with src, dst, edge, confidence and kind."""
    # Stages don't overlap within a pair of ends and a time, so their order is that of the stage's name and first packet.
    order = F.struct("first_us", "stage", "edge")
    return graph.merge_staged(known.select("src", "dst", F.lit("CONNECT_TO").alias("rel"), "packets", "bytes", "flows", "first_us", "last_us", F.lit(False).alias("correlated"), "stage", "protocol", F.array("port_min", "port_max").alias("ports"), order.alias("seq")))


def known_groups(groups: DataFrame, identities: DataFrame) -> DataFrame:
    """Groups whose client has an identity, as edges from its process (src) to a service (dst)."""
    edge = identity.edge_key("client_ip", "server_ip", "server_port")
    named = groups.withColumns({"edge": edge, "dst": graph.service_guid(X.host_name(F.col("server_ip")), F.col("server_port"))})
    return named.join(identities.select("edge", F.col("guid").alias("src"), "confidence", "kind"), "edge")


def existing_edges(flows: DataFrame, anchors: DataFrame, staged: DataFrame) -> DataFrame:
    """Updates of edges that telemetry has already: src, dst, rel and what its flows tell.

    Where an edge of the stages has the same ends, that one stays and the
    update is left out, as the staged edge creates or updates the edge itself.
    """
    rollup = identity.telemetry_rollup(flows, anchors).select(F.col("process_guid").alias("src"), F.col("service").alias("dst"), F.lit("CONNECT_TO").alias("rel"), "flows", "packets", "bytes", "confidence", "method", F.col("majority_port").cast("string").alias("source_port"))
    return rollup.join(staged.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti")


def relationships(packets: DataFrame, flows: DataFrame, anchors: DataFrame, identities: DataFrame, groups: DataFrame) -> DataFrame:
    """Statements of CONNECT_TO edges from a client's process to a service.

    What telemetry correlates is told as an update of its edge, unless an edge of
    the stages has the same ends. Each edge carries the feature row of its most
    frequent client and service pair.
    """
    known = known_groups(groups, identities)
    told = known.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.min("kind").alias("kind"), F.max_by("edge", F.struct("packets", "edge")).alias("edge"))
    rows = features.edge_rows(features.edge_packets(packets))
    extra = [c for c in rows.columns if c not in ("edge", "packets", "bytes", "protocol", "first_us", "last_us")]
    staged = staged_relationships(known).persist(StorageLevel.MEMORY_AND_DISK)
    updates = existing_edges(flows, anchors, staged)
    merged = staged.join(told, ["src", "dst"]).join(rows.select("edge", *extra), "edge", "left")
    names = EDGE_PROPERTIES | {c: _camel(c) for c in extra} | FEATURE_PROPERTIES
    return graph.edge_statements(merged, RELATIONSHIPS, names).unionByName(graph.edge_statements(updates, RELATIONSHIPS, {"flows": "canonicalCount", "packets": "packetCount", "bytes": "totalBytes", "confidence": "correlationConfidence", "method": "correlationMethod", "source_port": "SourcePort"}))


def accesses(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """READ_SIGNAL and WRITE_SIGNAL edges from a client's process: counts and last time."""
    kind = F.when(F.col("access") == "read", "READ_SIGNAL").otherwise("WRITE_SIGNAL")
    own = rows.join(identities.select("edge", F.col("guid").alias("src")), "edge")
    return own.groupBy("src", F.col("series").alias("dst"), kind.alias("rel")).agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us"))


def statements(packets: DataFrame, flows: DataFrame, anchors: DataFrame, hosts: DataFrame, matches: DataFrame, min_ports: int = C.MIN_CLIENT_PORTS, attribute: bool = True) -> DataFrame:
    """section, key and text of all statements. hosts: hostname, ip, is_managed; matches: flows that telemetry names already.

    What several sections read is kept, in memory or on disk, so that it is
    neither planned nor computed for each of them anew.
    """
    kept = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    flows, anchors, matches = kept(flows), kept(anchors), kept(matches)
    groups = kept(grouping.run_stages(flows.join(matches, "canonical_id", "left_anti"), min_ports=min_ports)[0])
    everything = grouping.run_stages(flows, min_ports=1)[0]
    identities = kept(identity.client_identities(flows, anchors if attribute else anchors.limit(0), hosts))
    modbus, floats = kept(modbus_rows(packets)), kept(float_rows(packets))
    endpoints = graph.endpoint_nodes(flows).withColumn("internal", F.exists(F.split("addresses", ","), X.is_internal))
    services = kept(graph.service_nodes(everything))
    names = {"host": "hostname", "addresses": "ipAddresses"}
    containers = identity.containers(modbus)
    loose = hosts.groupBy(F.col("hostname").alias("host")).agg(F.bool_or("is_managed").alias("m")).where("not m").join(endpoints.select("host"), "host", "left_semi")
    processes = loose.select(identity.placeholder_guid(F.col("host")).alias("guid"), "host", F.lit("placeholder").alias("image"))
    owned = identity.ownership(services, hosts).where("rel <> 'LISTENS_ON'")
    container_names = {"role": "role", "register": "address", "unit": "unitId", "reads": "readCount", "writes": "writeCount", "min_value": "minValue", "max_value": "maxValue"}
    seen = containers.where("role = 'client'").groupBy("guid").agg(*[F.first(c).alias(c) for c in container_names])
    parts = [
        graph.node_statements(endpoints.where("internal"), "NetworkEndpoint", ENDPOINTS, names),
        attached(services, "NetworkService", SERVICES, {"host": "host", "port": "port", "protocol": "protocol", "service_name": "serviceName", "ip": "ipAddress"}, graph.endpoint_guid(F.col("host")), "NetworkEndpoint", "(n)-[:LISTENS_ON]->(m)", update=False),
        graph.node_statements(endpoints.where("not internal").withColumn("external", F.lit(True)), "NetworkEndpoint", EXTERNAL, names | {"external": "external"}),
        attached(signals(modbus, floats), "ICSSignal", SIGNALS, SIGNAL_PROPERTIES, graph.endpoint_guid(F.col("host")), "NetworkEndpoint", "(n)-[:EXPOSED_ON]->(m)"),
        attached(containers.where("role = 'server'"), "SignalContainer", CONTAINERS, container_names, graph.service_guid(X.host_name(F.col("ip")), F.lit(C.MODBUS_PORT)), "NetworkService", "(m)-[:OBSERVED]->(n)"),
        graph.node_statements(seen, "SignalContainer", CONTAINERS, container_names),
        graph.node_statements(processes, "Process", PROCESSES, {"host": "hostname", "image": "image"}),
        tied(owned, OWNERSHIP),
        relationships(packets, flows, anchors if attribute else anchors.limit(0), identities, groups),
    ]
    keys = ("series", "edge", "access", "ts_us")
    reached = accesses(modbus.select(*keys).unionByName(floats.select(*keys)), identities)
    parts.append(graph.edge_statements(reached, RELATIONSHIPS, {"n": "accessCount", "last_us": "lastSeenMicros"}))
    out = flows.sparkSession.createDataFrame([(k + 1, "", text) for k, text in enumerate(HEADINGS)], "section int, key string, text string")
    for part in parts:
        out = out.unionByName(part)
    return out
