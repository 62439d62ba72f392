"""Features of edges, each one aggregation over packets that carry their edge's key.

Input rows are packets with an edge column and a side: 'out' where the packet
goes from client to server, 'in' where it goes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otflow.functions import columns as X
from otflow.operators import flows as fl


def edge_packets(packets: DataFrame) -> DataFrame:
    """Packets with edge ('client>server:port/protocol') and side, for flows that can be oriented."""
    tagged = fl.with_canonical_id(packets)
    oriented = fl.orient(fl.assemble(packets)).where("client is not null").select("canonical_id", F.col("client.ip").alias("client_ip"), F.col("server.ip").alias("server_ip"), F.col("server.port").alias("server_port"))
    joined = tagged.join(oriented, "canonical_id")
    edge = F.concat("client_ip", F.lit(">"), "server_ip", F.lit(":"), F.col("server_port").cast("string"), F.lit("/"), "protocol")
    side = F.when((F.col("src_ip") == F.col("client_ip")) & (F.col("dst_ip") == F.col("server_ip")), "out").when((F.col("src_ip") == F.col("server_ip")) & (F.col("dst_ip") == F.col("client_ip")), "in")
    return joined.withColumns({"edge": edge, "side": side})


def _totals() -> list[Column]:
    span = F.max("ts_us") - F.min("ts_us")
    n = F.count(F.lit(1))
    gap = F.floor((2 * span + n - 1).cast("decimal(38,0)") / (2 * (n - 1)).cast("decimal(38,0)"))  # whole microseconds, half up
    return [
        n.alias("packets"),
        F.sum("size").alias("bytes"),
        F.round(F.avg("size"), 2).alias("mean_size"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        (span / 1e6).alias("duration_s"),
        F.when(n > 1, gap.cast("long") / 1e6).otherwise(F.lit(0.0)).alias("mean_gap_s"),
    ]


def totals(p: DataFrame) -> DataFrame:
    """packets, bytes, mean size, times, duration and mean gap of each edge."""
    return p.groupBy("edge").agg(*_totals())


def _directional() -> list[Column]:
    out, back = F.col("side") == "out", F.col("side") == "in"
    out_bytes, in_bytes = (F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)) for side in (out, back))
    return [
        out_bytes.alias("bytes_out"),
        in_bytes.alias("bytes_in"),
        F.count_if(out).alias("packets_out"),
        F.count_if(back).alias("packets_in"),
        F.round(X.directionality(out_bytes, in_bytes), 6).alias("directionality"),
    ]


def directional(p: DataFrame) -> DataFrame:
    """Bytes and packets of both sides, and the ratio of bytes out to bytes in."""
    return p.groupBy("edge").agg(*_directional())


def mode_first(p: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first. Nulls don't count."""
    counts = p.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(X.order_key()).alias("first"))
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), "first")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select(by, F.col(value).alias(out))


def distinct_in_order(p: DataFrame, value: Column, out: str, limit: int | None = None, cut: int | None = None) -> DataFrame:
    """Comma list of an edge's distinct values in first-seen order, of at most limit values of at most cut characters."""
    seen = p.select("edge", value.alias("v"), X.order_key().alias("o")).where("v is not null and v <> ''").groupBy("edge", "v").agg(F.min("o").alias("o"))
    if limit is not None:
        order = Window.partitionBy("edge").orderBy("o")
        seen = seen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("o", "v")))
    values = F.transform(listed, lambda s: s["v"] if cut is None else F.substring(s["v"], 1, cut))
    return seen.groupBy("edge").agg(F.array_join(values, ",").alias(out))


def retransmits(p: DataFrame) -> DataFrame:
    """TCP segments with payload whose sequence number and length the same sender has sent before."""
    sent = p.where("protocol = 'tcp' and tcp_seq is not null and payload_len > 0")
    counted = sent.groupBy("edge").agg((F.count(F.lit(1)) - F.count_distinct("src_ip", "dst_ip", "tcp_seq", "payload_len")).alias("retransmits"))
    return p.select("edge").distinct().join(counted, "edge", "left").select("edge", F.coalesce("retransmits", F.lit(0).cast("long")).alias("retransmits"))


def _macs() -> list[Column]:
    both = (F.col("side") == "out") & (F.col("src_mac") != "") & (F.col("dst_mac") != "")
    pair = fl.first_of(F.struct("src_mac", "dst_mac"), both)
    return [F.coalesce(pair[c], fl.first_of(F.col(c), F.col(c) != "")).alias(c) for c in ("src_mac", "dst_mac")]


def macs(p: DataFrame) -> DataFrame:
    """MACs of the first packet from client to server that has both; else the first non-empty ones."""
    return p.groupBy("edge").agg(*_macs())


def _first_values() -> list[Column]:
    first = lambda c: fl.first_of(F.col(c), F.col(c).isNotNull())
    place = F.concat(F.coalesce(first("http_host"), F.lit("")), F.coalesce(first("http_path"), F.lit("")))
    content = F.coalesce(F.nullif(place, F.lit("")), first("http_content_type"))
    return [first("http_method").alias("http_method"), first("http_status").alias("http_status"), content.alias("http_content"), first("tls_sni").alias("tls_sni")]


def first_values(p: DataFrame) -> DataFrame:
    """The first non-null HTTP method, status, host, path, content type and TLS name; content is host and path, else the type."""
    return p.groupBy("edge").agg(*_first_values())


def mqtt(p: DataFrame) -> DataFrame:
    """Packet types, topics, client ids, QoS levels, counts and retain flag of edges with MQTT packets."""
    own = p.where("mqtt_packet_type is not null")
    kind = F.col("mqtt_packet_type")
    counts = own.groupBy("edge").agg(
        F.count_if(kind == "PUBLISH").alias("publishes"),
        F.count_if(kind.isin("SUBSCRIBE", "UNSUBSCRIBE")).alias("subscribes"),
        F.coalesce(F.bool_or("mqtt_retain"), F.lit(False)).alias("retain"),
        F.array_join(F.sort_array(F.collect_set("mqtt_qos")).cast("array<string>"), ",").alias("qos"),
    )
    for name, column, limit, cut in (("types", "mqtt_packet_type", 8, None), ("topics", "mqtt_topic", 8, 120), ("clients", "mqtt_client_id", 4, None)):
        counts = counts.join(distinct_in_order(own, F.col(column), name, limit, cut), "edge", "left")
    return counts


def opcua(p: DataFrame) -> DataFrame:
    """Message and chunk types, endpoints, policies, channels and counts of edges with OPC UA packets."""
    own = p.where("opcua_message_type is not null")
    kind = F.col("opcua_message_type")
    counts = own.groupBy("edge").agg(
        F.count_if(kind == "OPN").alias("opens"),
        F.count_if(kind == "MSG").alias("messages"),
        F.count_if(kind == "CLO").alias("closes"),
        F.array_join(F.slice(F.sort_array(F.collect_set("opcua_secure_channel_id")), 1, 8).cast("array<string>"), ",").alias("channels"),
    )
    for name, column, limit, cut in (("types", "opcua_message_type", 8, None), ("chunks", "opcua_chunk_type", 3, None), ("urls", "opcua_endpoint_url", 4, 200), ("policies", "opcua_security_policy_uri", 4, None)):
        counts = counts.join(distinct_in_order(own, F.col(column), name, limit, cut), "edge", "left")
    return counts


def mean_rtt(p: DataFrame) -> DataFrame:
    """Mean time in ms from a segment to the exact acknowledgement of its end by the other side.

    A pending end keeps its first sending; an acknowledgement takes it away, so
    acknowledgements cut each (side, value) into islands.
    """
    tcp = p.where("protocol = 'tcp' and side is not null")
    bump = F.when(F.contains(F.col("tcp_flags"), F.lit("S")) | F.contains(F.col("tcp_flags"), F.lit("F")), 1).otherwise(0)
    end = F.col("tcp_seq") + F.greatest(F.coalesce("payload_len", F.lit(0)), F.lit(0)) + bump
    other = F.when(F.col("side") == "out", "in").otherwise("out")
    o = X.order_key().alias("o")
    sent = tcp.where(end > F.col("tcp_seq")).select("edge", F.col("side").alias("d"), end.alias("v"), "ts_us", o, F.lit(1).alias("sent"))
    acked = tcp.where("tcp_ack is not null").select("edge", other.alias("d"), F.col("tcp_ack").alias("v"), "ts_us", o, F.lit(0).alias("sent"))
    # Of one packet the acknowledgement is looked at after its own sending was noted.
    order = Window.partitionBy("edge", "d", "v").orderBy("o", F.col("sent").desc())
    island = F.coalesce(F.sum(1 - F.col("sent")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = sent.unionByName(acked).withColumn("island", island).groupBy("edge", "d", "v", "island").agg(F.min(F.when(F.col("sent") == 1, F.col("ts_us"))).alias("s"), F.max(F.when(F.col("sent") == 0, F.col("ts_us"))).alias("a"))
    return pairs.groupBy("edge").agg(F.sum(F.col("a") - F.col("s")).alias("total_us"), F.count(F.col("a") - F.col("s")).alias("samples")).where("samples > 0").withColumn("rtt_ms", F.round(F.col("total_us") / F.col("samples") / 1000, 3))


def client_ports(p: DataFrame) -> DataFrame:
    """Ports seen on the client's side, in either direction."""
    port = F.when(F.col("side") == "out", F.col("src_port")).when(F.col("side") == "in", F.col("dst_port"))
    found = p.select("edge", port.alias("port")).where("port is not null").groupBy("edge").agg(F.sort_array(F.collect_set("port")).alias("ports"))
    return found.select("edge", F.size("ports").cast("long").alias("n_ports"), F.array_join(F.slice(F.col("ports"), 1, 8).cast("array<string>"), ",").alias("port_set"))


#: Lists of an edge's row: column, condition, and how many values of how many characters they hold.
LISTED = {
    "tcp_flags": ("tcp_flags", "true", None, None),
    "mqtt_packet_types": ("mqtt_packet_type", "true", 8, None),
    "mqtt_topics": ("mqtt_topic", "mqtt_packet_type is not null", 8, 120),
    "mqtt_client_ids": ("mqtt_client_id", "mqtt_packet_type is not null", 4, None),
    "opcua_message_types": ("opcua_message_type", "true", 8, None),
    "opcua_chunk_types": ("opcua_chunk_type", "opcua_message_type is not null", 3, None),
    "opcua_endpoint_urls": ("opcua_endpoint_url", "opcua_message_type is not null", 4, 200),
    "opcua_security_policies": ("opcua_security_policy_uri", "opcua_message_type is not null", 4, None),
}


def _shortened(cut: int):
    return lambda v: F.substring(v, 1, cut)


def listed_values(p: DataFrame) -> DataFrame:
    """The lists of LISTED, each of distinct values in first-seen order, by one aggregation over (edge, list, value)."""
    told = [F.when(F.expr(condition) & (F.col(column) != ""), F.struct(F.lit(name).alias("name"), F.col(column).alias("v"))) for name, (column, condition, _, _) in LISTED.items()]
    seen = p.select("edge", X.order_key().alias("o"), F.explode(F.array_compact(F.array(*told))).alias("f")).groupBy("edge", "f.name", "f.v").agg(F.min("o").alias("o"))
    order = Window.partitionBy("edge", "name").orderBy("o")
    most = F.create_map(*[F.lit(x) for name, (_, _, limit, _) in LISTED.items() if limit for x in (name, limit)])
    kept = seen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.coalesce(most[F.col("name")], F.col("r")))
    lists = []
    for name, (_, _, _, cut) in LISTED.items():
        values = F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("r", "v"))))
        texts = values["v"] if cut is None else F.transform(values["v"], _shortened(cut))
        lists.append(F.when(F.size(values) > 0, F.array_join(texts, ",")).alias(name))
    return kept.groupBy("edge").agg(*lists)


def _protocol_counts() -> list[Column]:
    """Counts of an edge's row that only edges with such packets have."""
    m, u = F.col("mqtt_packet_type"), F.col("opcua_message_type")
    numbers = lambda c, of, n: F.array_join(F.slice(F.sort_array(F.collect_set(F.when(of.isNotNull(), F.col(c)))), 1, n).cast("array<string>"), ",")
    mqtt_ = {
        "mqtt_qos_levels": numbers("mqtt_qos", m, 3),
        "mqtt_publish_count": F.count_if(m == "PUBLISH"),
        "mqtt_subscribe_count": F.count_if(m.isin("SUBSCRIBE", "UNSUBSCRIBE")),
        "mqtt_retain_seen": F.coalesce(F.bool_or(F.when(m.isNotNull(), F.col("mqtt_retain"))), F.lit(False)),
    }
    opcua_ = {"opcua_secure_channel_ids": numbers("opcua_secure_channel_id", u, 8)} | {f"opcua_{name}_count": F.count_if(u == kind) for name, kind in (("open", "OPN"), ("msg", "MSG"), ("close", "CLO"))}
    return [F.when(F.count(of) > 0, value).alias(name) for of, columns in ((m, mqtt_), (u, opcua_)) for name, value in columns.items()]


def edge_rows(p: DataFrame) -> DataFrame:
    """The feature row of every edge: one aggregation for what sums and firsts tell, one for its lists, joined with what needs an order of its own."""
    out = p.groupBy("edge").agg(*_totals(), *_directional(), *_macs(), *_first_values(), *_protocol_counts())
    for part in (mode_first(p, "edge", "high_level_protocol", "protocol_label"), listed_values(p), retransmits(p), mean_rtt(p).select("edge", "rtt_ms")):
        out = out.join(part, "edge", "left")
    return out
