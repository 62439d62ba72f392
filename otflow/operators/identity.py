"""Who is behind an edge: processes, placeholders of unmanaged hosts, ownership and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.functions import columns as X
from otflow.operators import correlate, graph
from otflow.operators import flows as fl


def edge_key(client: str, server: str, port: str) -> Column:
    return F.concat(F.col(client), F.lit(">"), F.col(server), F.lit(":"), F.col(port).cast("string"), F.lit("/"), F.col("protocol"))


def correlated(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Oriented flows that a session names, with edge, confidence and the anchor's process."""
    known = fl.orient(flows).where("client is not null").selectExpr("*", "client.ip client_ip", "client.port client_port", "server.ip server_ip", "server.port server_port")
    named = known.withColumn("edge", edge_key("client_ip", "server_ip", "server_port"))
    processes = anchors.where(correlate.valid_process()).select("anchor_seq", F.col("process.guid").alias("process_guid"), F.col("process.image").alias("process_image"))
    return named.join(correlate.session_matches(flows, anchors), "canonical_id").join(processes, "anchor_seq")


def edge_processes(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The process of each edge: that of most of its flows, of equals that of the smallest client port."""
    found = correlated(flows, anchors).select(F.col("edge").alias("group_id"), F.col("client_port").alias("port"), "process_guid")
    return correlate.best_process(found).withColumnRenamed("group_id", "edge")


def placeholder_guid(host: Column) -> Column:
    return X.guid(F.lit("Process"), host, F.lit("placeholder"))


def client_identities(flows: DataFrame, anchors: DataFrame, hosts: DataFrame) -> DataFrame:
    """edge, client_host, guid, confidence, kind of every oriented edge that has a client identity.

    hosts: hostname, ip, is_managed. The telemetry's process counts 1.0, the
    placeholder process of a known but unmanaged host 0.5; managed and unknown
    hosts without a process give no identity, hence no edge.
    """
    edges = fl.orient(flows).where("client is not null").select(edge_key("client.ip", "server.ip", "server.port").alias("edge"), F.col("client.ip").alias("ip")).distinct()
    known = hosts.groupBy("ip").agg(F.min("hostname").alias("hostname"), F.bool_or("is_managed").alias("is_managed"))
    told = edges.join(edge_processes(flows, anchors).select("edge", "process_guid"), "edge", "left").join(known, "ip", "left")
    stands_in = F.when(~F.col("is_managed"), placeholder_guid(F.col("hostname")))
    return told.select(
        "edge",
        F.coalesce("hostname", "ip").alias("client_host"),
        F.coalesce("process_guid", stands_in).alias("guid"),
        F.when(F.col("process_guid").isNotNull(), 1.0).otherwise(0.5).alias("confidence"),
        F.when(F.col("process_guid").isNotNull(), "telemetry").otherwise("placeholder").alias("kind"),
    ).where("guid is not null")


def telemetry_rollup(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per process and service: flows, packets, bytes, times, the best confidence and the majority client port."""
    rows = correlated(flows, anchors).withColumn("service", graph.service_guid(X.host_name(F.col("server_ip")), F.col("server_port")))
    key = ["process_guid", "service"]
    ports = rows.groupBy(*key, "client_port").agg(F.count(F.lit(1)).alias("n"), F.min("first_index").alias("first"))
    order = Window.partitionBy(*key).orderBy(F.col("n").desc(), "first")
    port = ports.withColumn("r", F.row_number().over(order)).where("r = 1").select(*key, F.col("client_port").alias("majority_port"))
    sums = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.max("confidence").alias("confidence"),
        F.max_by("method", F.struct("confidence", (-F.col("first_index")).alias("i"))).alias("method"),
    )
    return sums.join(port, key)


def signal_attribution(flows: DataFrame, anchors: DataFrame, obs: DataFrame) -> DataFrame:
    """Reads and writes of registers by the process behind the client's edge."""
    owners = edge_processes(flows, anchors).select("edge", "process_guid")
    seen = obs.select(F.concat(F.col("client_ip"), F.lit(">"), F.col("server_ip"), F.lit(f":{C.MODBUS_PORT}/tcp")).alias("edge"), "server_ip", "unit", "kind", "register", "access", "ts_us")
    guid = X.signal_guid(F.lit("modbus"), X.host_name(F.col("server_ip")), F.lit(C.MODBUS_PORT), F.col("unit"), F.col("kind"), F.col("register"))
    return seen.join(owners, "edge").groupBy("process_guid", guid.alias("signal_guid"), "access").agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("last_us"))


def ownership(services: DataFrame, hosts: DataFrame) -> DataFrame:
    """LISTENS_ON edges of services to endpoints, and BINDS and RUN_ON edges of unmanaged hosts' placeholders."""
    endpoint = graph.endpoint_guid(F.col("host"))
    listens = services.select(F.col("guid").alias("src"), endpoint.alias("dst"), F.lit("LISTENS_ON").alias("rel"))
    loose = hosts.groupBy(F.col("hostname").alias("host")).agg(F.bool_or("is_managed").alias("m")).where("not m").drop("m")
    owned = services.join(loose, "host", "left_semi")
    binds = owned.select(placeholder_guid(F.col("host")).alias("src"), F.col("guid").alias("dst"), F.lit("BINDS").alias("rel"))
    runs = owned.select(placeholder_guid(F.col("host")).alias("src"), endpoint.alias("dst"), F.lit("RUN_ON").alias("rel"))
    return listens.unionByName(binds).unionByName(runs).distinct()


def containers(obs: DataFrame) -> DataFrame:
    """Signal containers per address and unit for both roles of a conversation: counts, values and times."""
    roles = F.explode(F.array(F.struct(F.lit("client").alias("role"), F.col("client_ip").alias("ip")), F.struct(F.lit("server").alias("role"), F.col("server_ip").alias("ip"))))
    rows = obs.withColumn("r", roles).select("r.role", "r.ip", "register", "unit", "access", "value", "ts_us")
    counted = rows.groupBy("role", "ip", "register", "unit").agg(
        F.count_if(F.col("access") == "read").alias("reads"),
        F.count_if(F.col("access") == "write").alias("writes"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    return counted.withColumn("guid", X.guid(F.lit("SignalContainer"), X.host_name(F.col("ip")), F.col("register"), F.col("unit")))


def completeness(flows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Counters of a verification run: flows, those of logged hosts and of service ports, methods, and differences by reason."""
    logged = F.col("src_ip").isin(*C.LOGGED_HOSTS) | F.col("dst_ip").isin(*C.LOGGED_HOSTS)
    served = F.col("src_port").isin(*C.VERIFIED_PORTS) | F.col("dst_port").isin(*C.VERIFIED_PORTS)
    totals = flows.agg(F.count(F.lit(1)).alias("flows"), F.count_if(logged).alias("logged_hosts"), F.count_if(served).alias("service_ports"))
    counts = totals.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in totals.columns]), F.array(*totals.columns))).alias("counter", "n"))
    methods = correlate.session_matches(flows, anchors).groupBy(F.concat(F.lit("method:"), "method").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    reasons = correlate.verify(flows, anchors).groupBy(F.concat("verdict", F.lit(":"), "reason").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(methods).unionByName(reasons)


def sample(packets: DataFrame, n: int = 100) -> DataFrame:
    """The first n packets of each flow; the sample itself is the feature."""
    order = Window.partitionBy("canonical_id").orderBy(X.order_key())
    return fl.with_canonical_id(packets).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
