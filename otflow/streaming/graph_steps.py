"""The graph of a stream, step by step: what a step changes is told anew, everything else stays as it was written."""

from __future__ import annotations

import contextvars
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from otflow import constants as C
from otflow.functions import columns as X
from otflow.operators import augment, correlate, graph, grouping, identity, policy, timeline
from otflow.operators import flows as fl

#: Headings of the sections of a streamed graph, in their order.
HEADINGS = (
    "// === PCAP Augmentation (Streaming Mode with Correlation) ===",
    "// Edge updates for correlated telemetry connections",
    "// READ/WRITE_SIGNAL relationships for process attribution",
    "// NetworkEndpoint nodes for PCAP-only connections",
    "// NetworkService nodes for PCAP-only connections",
    "// PCAP-Inferred ICSSignal Nodes",
    "// Virtual Process Nodes for inferred services",
    "// Process Ownership Relationships (RUN_ON/BINDS)",
    "// New relationships for PCAP-only connections",
)
UPDATES, ACCESSES, ENDPOINTS, SERVICES, SIGNALS, PROCESSES, OWNERSHIP, RELATIONSHIPS = range(2, 10)

STATEMENT = "section int, key string, text string"
ACCESS = "edge string, series string, access string, n long, last_us long"
IDENTITY = "edge string, guid string"
ANCHOR = (
    "anchor_seq long, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, sessions array<struct<port:int,ts_us:long>>, "
    "process struct<guid:string,image:string,pid:int,user:string,computer:string>, first_us long, last_us long"
)
#: How long requests without an answer are kept from one step to the next, in a capture's own time.
FORGET_US = 3_600_000_000


@dataclass(frozen=True)
class Steps:
    """Rows by key that the steps of a stream change, under path; a key's last row counts.

    Each step writes what it changes as a folder of its own, and each fold-th
    everything as of then, so that no reader meets more than fold folders. A
    step reads only folders of the steps before it: repeated after a failure,
    it finds what it found the first time and overwrites its own folder.
    """

    path: str
    keys: tuple[str, ...]
    schema: str | StructType
    fold: int = 16

    def before(self, spark: SparkSession, step: int) -> DataFrame:
        """The rows as the steps before this one have left them."""
        first = max((step - 1) // self.fold * self.fold, 0)
        folders = [f"{self.path}/step={k}" for k in range(first, step)]
        if not folders:
            return spark.createDataFrame([], self.schema)
        schema = StructType.fromDDL(self.schema) if isinstance(self.schema, str) else self.schema
        rows = spark.read.schema(schema).option("basePath", self.path).parquet(*folders)
        others = [c for c in schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "step").alias("s"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"s.{c}") for c in schema.names])

    def put(self, changed: DataFrame, step: int) -> None:
        """Write what this step changes."""
        rows = changed
        if step and step % self.fold == 0:
            rows = changed.unionByName(self.before(changed.sparkSession, step).join(changed.select(*self.keys), list(self.keys), "left_anti"))
        rows.write.mode("overwrite").parquet(f"{self.path}/step={step}")

    def next_step(self, spark: SparkSession) -> int:
        """The number after the last step written."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        return spark.read.option("basePath", self.path).parquet(self.path).agg(F.max("step")).first()[0] + 1

    def now(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, self.next_step(spark))


def _statements(folder: str, name: str) -> Steps:
    return Steps(f"{folder}/statements_{name}", ("section", "key"), STATEMENT)


def _accesses(folder: str) -> Steps:
    return Steps(f"{folder}/accesses", ("edge", "series", "access"), ACCESS)


def _identities(folder: str) -> Steps:
    return Steps(f"{folder}/identities", ("edge",), IDENTITY)


def _tell(steps: Steps, told: DataFrame, step: int) -> None:
    """Write those statements that aren't written yet, or read otherwise."""
    steps.put(told.join(steps.before(told.sparkSession, step), ["section", "key", "text"], "left_anti"), step)


def _written(df: DataFrame, path: str) -> DataFrame:
    """df as a table that this step writes and all its parts read, so that none of them plans or computes it anew."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_ports(flows: DataFrame) -> DataFrame:
    """flows without what SYNs tell, as those of running flows may have been missed; service ports alone orient them."""
    return flows.withColumn("syn", F.lit(None).cast(flows.schema["syn"].dataType))


def _service(flows: DataFrame) -> DataFrame:
    """flows with the host and port of their service, null where ports don't tell."""
    return fl.orient(flows, use_syn=False).withColumns({"_host": X.host_name(F.col("server.ip")), "_port": F.col("server.port")}).drop("client", "server")


def identities_of(flows: DataFrame, anchors: DataFrame, hosts: DataFrame) -> DataFrame:
    """edge and guid of the edges whose client has an identity."""
    return identity.client_identities(by_ports(flows), anchors, hosts).select("edge", "guid")


def flow_statements(flows: DataFrame, ends: DataFrame, identities: DataFrame, anchors: DataFrame, hosts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """section, key and text of what flows tell: updates, services, ownership and relationships; of ends: endpoints and processes.

    flows hold all flows of a service if they hold one, and ends all of the
    hosts in only (of all hosts, without it). Edges start at the client's
    process, else at its placeholder, else at its host. Statements are
    idempotent, so later ones of the same key may be applied after earlier ones.
    """
    flows = by_ports(flows)
    wanted = flows.where(policy.interesting_incremental())
    services = graph.service_nodes(grouping.grouped(fl.orient(wanted)))
    edges = grouping.grouped(fl.orient(wanted.join(correlate.session_matches(flows, anchors), "canonical_id", "left_anti")))
    edges = edges.withColumn("edge", identity.edge_key("client_ip", "server_ip", "server_port")).join(identities, "edge", "left")
    staged = graph.merge_staged(
        edges.select(
            F.coalesce("guid", graph.endpoint_guid(X.host_name(F.col("client_ip")))).alias("src"), graph.service_guid(X.host_name(F.col("server_ip")), F.col("server_port")).alias("dst"), F.lit("CONNECT_TO").alias("rel"),
            "packets", "bytes", "flows", "first_us", "last_us", F.lit(False).alias("correlated"), X.service_name(F.col("server_port")).alias("stage"), "protocol",
            F.array("port_min", "port_max").alias("ports"), F.struct("first_us", "client_ip", "server_ip", "server_port").alias("seq"),
        )
    )
    updates = augment.existing_edges(flows, anchors, staged)
    endpoints = graph.endpoint_nodes(ends)
    endpoints = endpoints if only is None else endpoints.join(only, "host", "left_semi")
    loose = hosts.groupBy(F.col("hostname").alias("host")).agg(F.bool_or("is_managed").alias("m")).where("not m").join(endpoints.select("host"), "host", "left_semi")
    processes = loose.select(identity.placeholder_guid(F.col("host")).alias("guid"), "host", F.lit("placeholder").alias("image"))
    owned = identity.ownership(services, hosts).where("rel <> 'LISTENS_ON'")
    described = {"host": "host", "port": "port", "protocol": "protocol", "service_name": "serviceName", "ip": "ipAddress"}
    parts = (
        graph.edge_statements(updates, UPDATES, {"flows": "canonicalCount", "packets": "packetCount", "bytes": "totalBytes", "confidence": "correlationConfidence", "method": "correlationMethod", "source_port": "SourcePort"}),
        graph.node_statements(endpoints, "NetworkEndpoint", ENDPOINTS, {"host": "hostname", "addresses": "ipAddresses"}),
        augment.attached(services, "NetworkService", SERVICES, described, graph.endpoint_guid(F.col("host")), "NetworkEndpoint", "(n)-[:LISTENS_ON]->(m)", update=False),
        graph.node_statements(processes, "Process", PROCESSES, {"host": "hostname", "image": "image"}),
        augment.tied(owned, OWNERSHIP),
        graph.edge_statements(staged, RELATIONSHIPS, augment.EDGE_PROPERTIES_OF_GROUPS),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def flow_step(batch: DataFrame, step: int, folder: str, anchors: DataFrame, hosts: DataFrame) -> None:
    """Take over the flows that a step changes, as they are now, and tell what follows for their services and hosts."""
    spark, work = batch.sparkSession, f"{folder}/work_flows"
    batch = _written(batch, f"{work}/changed")
    states = Steps(f"{folder}/flows", ("canonical_id",), batch.schema)
    states.put(batch, step)
    now = states.before(spark, step + 1)
    touched = _service(batch).select("_host", "_port").where("_port is not null").distinct()
    hosts_touched = batch.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).select(X.host_name(F.col("ip")).alias("host")).distinct()
    members = _written(_service(now).join(touched, ["_host", "_port"], "left_semi").drop("_host", "_port"), f"{work}/members")
    named = _written(identities_of(members, anchors, hosts), f"{work}/named")
    _identities(folder).put(named, step)
    _tell(_statements(folder, "flows"), flow_statements(members, now, named, anchors, hosts, hosts_touched), step)


def pending(packets: DataFrame, since_us: int) -> DataFrame:
    """The packets since a time that later ones may answer: Modbus requests not used up, and the latest OPC UA request of each key."""
    order, row = X.order_key(), F.struct(*packets.columns)
    modbus = packets.where("modbus_function is not null and modbus_transaction_id is not null").groupBy(X.modbus_key().alias("k")).agg(F.max_by(row, order).alias("p")).where(F.col("p.dst_port") == C.MODBUS_PORT)
    asked = packets.where((F.col("dst_port") == C.OPCUA_PORT) & F.col("opcua_request_id").isNotNull())
    opcua = asked.groupBy("src_ip", F.coalesce("opcua_secure_channel_id", F.lit(-1)).alias("c"), "opcua_request_id").agg(F.max_by(row, order).alias("p"))
    return modbus.select("p.*").unionByName(opcua.select("p.*")).where(F.col("ts_us") >= since_us).dropDuplicates(["pcap_file", "packet_index"])


def _signal_schema() -> str:
    whole = ("reads", "writes", "samples", "last_us", "last_write_us", "changes", "runs", "points")
    kinds = dict.fromkeys(whole, "long") | dict.fromkeys(("functions", "top_values", "rle", "timeline"), "string") | {"last_function": "int", "buckets": "int", "truncated": "boolean"}
    return "series string, host string, name string, protocol string, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in timeline.SUMMARY) + ", ratio double, timeline_ratio double"


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def signal_step(batch: DataFrame, step: int, folder: str, forget_us: int = FORGET_US) -> None:
    """Merge what a step's packets tell of signals, and of who read and wrote them, with what the steps before told.

    Counts, extremes, means and last values are those of all packets; runs and
    timelines are merged as timeline.merge_summaries says. Requests that wait
    for an answer go on to the next step.
    """
    spark, work = batch.sparkSession, f"{folder}/work_signals"
    waiting = spark.read.schema(batch.schema).parquet(f"{folder}/pending/step={step - 1}") if step else batch.limit(0)
    packets = _written(batch.unionByName(waiting), f"{work}/packets")
    latest = packets.agg(F.max("ts_us")).first()[0] or 0
    pending(packets, latest - forget_us).write.mode("overwrite").parquet(f"{folder}/pending/step={step}")
    new = lambda rows, name: _written(rows.join(waiting.select("pcap_file", "packet_index"), ["pcap_file", "packet_index"], "left_anti"), f"{work}/{name}")
    modbus, floats = new(augment.modbus_rows(packets), "modbus"), new(augment.float_rows(packets), "floats")
    schema = _signal_schema()
    fresh = _written(_typed(augment.signals(modbus, floats).withColumnRenamed("guid", "series"), schema), f"{work}/fresh")
    states = Steps(f"{folder}/signals", ("series",), schema)
    both = states.before(spark, step).join(fresh.select("series"), "series", "left_semi").unionByName(fresh)
    names = both.groupBy("series").agg(*[F.min(c).alias(c) for c in ("host", "name", "protocol")])
    states.put(_typed(timeline.merge_summaries(both).withColumn("functions", F.nullif("functions", F.lit(""))).join(names, "series"), schema), step)
    merged = states.before(spark, step + 1).join(fresh.select("series"), "series", "left_semi")
    told = augment.attached(merged.withColumnRenamed("series", "guid"), "ICSSignal", SIGNALS, augment.SIGNAL_PROPERTIES, graph.endpoint_guid(F.col("host")), "NetworkEndpoint", "(n)-[:EXPOSED_ON]->(m)")
    _tell(_statements(folder, "signals"), told, step)
    key = ["edge", "series", "access"]
    seen = modbus.select(*key, "ts_us").unionByName(floats.select(*key, "ts_us")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us"))
    reached = _accesses(folder)
    earlier = reached.before(spark, step).join(seen.select(*key), key, "left_semi")
    reached.put(seen.unionByName(earlier).groupBy(*key).agg(F.sum("n").alias("n"), F.max("last_us").alias("last_us")), step)


def access_statements(reached: DataFrame, identities: DataFrame) -> DataFrame:
    """READ_SIGNAL and WRITE_SIGNAL statements from a client's process: counts and last time."""
    kind = F.when(F.col("access") == "read", "READ_SIGNAL").otherwise("WRITE_SIGNAL")
    rows = reached.join(identities, "edge").groupBy(F.col("guid").alias("src"), F.col("series").alias("dst"), kind.alias("rel")).agg(F.sum("n").alias("n"), F.max("last_us").alias("last_us"))
    return graph.edge_statements(rows, ACCESSES, {"n": "accessCount", "last_us": "lastSeenMicros"})


def _as_far_as_now(rows: DataFrame, mode: str, checkpoint: str, step: Callable[[DataFrame, int], None]) -> None:
    # Steps run in a thread of their own, which would not see the host names in use here.
    context = contextvars.copy_context()
    run = lambda batch, k: context.run(step, batch, k)
    rows.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_graph(packets: DataFrame, folder: str, checkpoint: str, anchors: DataFrame | None = None, hosts: DataFrame | None = None) -> None:
    """Read what a stream has now, and write under folder the statements that it changes.

    anchors: telemetry (see operators.correlate); hosts: hostname, ip, is_managed.
    An edge once told stays told, though its flows be correlated later.
    """
    spark = packets.sparkSession
    anchors = spark.createDataFrame([], ANCHOR) if anchors is None else anchors
    hosts = spark.createDataFrame([], "hostname string, ip string, is_managed boolean") if hosts is None else hosts
    _as_far_as_now(fl.assemble(packets), "update", f"{checkpoint}/flows", lambda batch, k: flow_step(batch, k, folder, anchors, hosts))
    _as_far_as_now(packets, "append", f"{checkpoint}/signals", lambda batch, k: signal_step(batch, k, folder))
    told = _statements(folder, "accesses")
    _tell(told, access_statements(_accesses(folder).now(spark), _identities(folder).now(spark)), told.next_step(spark))


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """section, key and text of the whole graph as it has been told so far, with headings."""
    out = spark.createDataFrame([(k + 1, "", text) for k, text in enumerate(HEADINGS)], STATEMENT)
    for name in ("flows", "signals", "accesses"):
        out = out.unionByName(_statements(folder, name).now(spark))
    return out
