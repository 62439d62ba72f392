"""Flows: packets grouped by canonical id, their origin direction, and who is client and server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.functions import columns as X

KEY = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")


def with_canonical_id(packets: DataFrame) -> DataFrame:
    return packets.withColumn("canonical_id", X.canonical_id())


def without_ignored(packets: DataFrame) -> DataFrame:
    """Packets of ignored addresses are dropped at the source."""
    return packets.where(~F.col("src_ip").isin(*C.IGNORED_IPS) & ~F.col("dst_ip").isin(*C.IGNORED_IPS))


def first_of(value: Column, where: Column) -> Column:
    """value of the first packet, in time order, for which where holds."""
    return F.min_by(value, F.when(where, X.order_key()))


def assemble(packets: DataFrame) -> DataFrame:
    """One row per flow: canonical_id, the origin's five columns, times, sums and what grouping needs.

    The origin is the direction of the earliest packet. Everything is one
    partially aggregated pass; packets are never gathered.
    """
    key = F.struct(*KEY)
    syn = F.contains(F.col("tcp_flags"), F.lit("S")) & ~F.contains(F.col("tcp_flags"), F.lit("A"))
    opening_mqtt = F.col("mqtt_packet_type") == "CONNECT"
    hello = (F.col("opcua_message_type") == "HEL") & F.col("opcua_endpoint_url").isNotNull()
    opened = (F.col("opcua_message_type") == "OPN") & F.col("opcua_security_policy_uri").isNotNull()
    words = F.concat_ws(" ", F.lower("http_path"), F.lower("http_host"))
    monitor = (F.lower("high_level_protocol") == "http") & (F.contains(words, F.lit("monitor")) | F.contains(words, F.lit("mb_port")))
    flows = (
        with_canonical_id(packets)
        .groupBy("canonical_id")
        .agg(
            F.min_by(key, X.order_key()).alias("origin"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.count(F.lit(1)).alias("packets"),
            F.sum("size").alias("bytes"),
            F.max("ip_layer_index").alias("layer"),
            F.min("packet_index").alias("first_index"),
            first_of(key, syn).alias("syn"),
            first_of(key, opening_mqtt).alias("mqtt_connect"),
            first_of(key, hello).alias("opcua_hello"),
            first_of(key, opened).alias("opcua_open"),
            F.bool_or(F.lower("high_level_protocol") == "modbus").alias("modbus_label"),
            F.coalesce(F.bool_or(monitor), F.lit(False)).alias("monitor"),
        )
    )
    return flows.select("canonical_id", "origin.*", *[c for c in flows.columns if c not in ("canonical_id", "origin")])


def orient(flows: DataFrame, use_syn: bool = True) -> DataFrame:
    """flows with client and server (structs of ip and port), null where neither SYN nor ports tell.

    The first SYN without ACK decides; else the side with the service port, if
    only one has it. The incremental variant leaves SYNs out.
    """
    a, b = X.is_service_port(F.col("src_port")), X.is_service_port(F.col("dst_port"))
    source, target = _end("src_ip", "src_port"), _end("dst_ip", "dst_port")
    client = F.when(~a & b, source).when(a & ~b, target)
    server = F.when(~a & b, target).when(a & ~b, source)
    if use_syn:
        client = F.when(F.col("syn").isNotNull(), _end("syn.src_ip", "syn.src_port")).otherwise(client)
        server = F.when(F.col("syn").isNotNull(), _end("syn.dst_ip", "syn.dst_port")).otherwise(server)
    return flows.withColumns({"client": client, "server": server})


def _end(ip: str, port: str) -> Column:
    return F.struct(F.col(ip).alias("ip"), F.col(port).alias("port"))


def port_ends(ports: tuple[int, ...], opened: Column | None = None) -> tuple[Column, Column]:
    """client and server by the side that holds one of the ports.

    Where both or none do: the side that opened (a struct of a connection's
    columns, null if unknown), or without such a struct the origin's source.
    """
    to, back = F.col("dst_port").isin(*ports), F.col("src_port").isin(*ports)
    source, target = _end("src_ip", "src_port"), _end("dst_ip", "dst_port")
    if opened is None:
        reverse = back & ~to
        return F.when(reverse, target).otherwise(source), F.when(reverse, source).otherwise(target)
    pick = lambda side: F.when(opened.isNotNull(), F.struct(opened[f"{side}_ip"].alias("ip"), opened[f"{side}_port"].alias("port")))
    client = F.when(to & ~back, source).when(back & ~to, target).otherwise(pick("src"))
    server = F.when(to & ~back, target).when(back & ~to, source).otherwise(pick("dst"))
    return client, server


def mqtt_ends() -> tuple[Column, Column]:
    """The broker's port, else who sent the first CONNECT."""
    return port_ends(C.MQTT_PORTS, F.col("mqtt_connect"))


def opcua_ends() -> tuple[Column, Column]:
    """The server's port, else who sent the first HEL, else the first OPN."""
    return port_ends((C.OPCUA_PORT,), F.coalesce("opcua_hello", "opcua_open"))


def is_modbus() -> Column:
    return (F.col("src_port") == C.MODBUS_PORT) | (F.col("dst_port") == C.MODBUS_PORT) | F.col("modbus_label")


def is_monitor() -> Column:
    return ((F.col("src_port") == C.MONITOR_PORT) | (F.col("dst_port") == C.MONITOR_PORT)) & F.col("monitor")


def is_mqtt() -> Column:
    return F.col("src_port").isin(*C.MQTT_PORTS) | F.col("dst_port").isin(*C.MQTT_PORTS) | F.col("mqtt_connect").isNotNull()


def is_opcua() -> Column:
    return (F.col("src_port") == C.OPCUA_PORT) | (F.col("dst_port") == C.OPCUA_PORT) | F.col("opcua_hello").isNotNull() | F.col("opcua_open").isNotNull()
