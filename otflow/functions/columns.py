"""Column expressions on addresses, ports and identifiers; all stay inside Spark's own functions."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from otflow import constants as C


def order_key() -> Column:
    """The total order of packets: time, then file, then index."""
    return F.struct("ts_us", "pcap_file", "packet_index")


def endpoint_id(a: str, ap: str, b: str, bp: str, protocol: str) -> Column:
    return F.concat_ws("", F.col(a), F.lit(":"), F.col(ap).cast("string"), F.lit("->"), F.col(b), F.lit(":"), F.col(bp).cast("string"), F.lit(":"), F.col(protocol))


def canonical_id(a: str = "src_ip", ap: str = "src_port", b: str = "dst_ip", bp: str = "dst_port", protocol: str = "protocol") -> Column:
    """The same text for both directions of a connection: the lesser of both spellings."""
    return F.least(endpoint_id(a, ap, b, bp, protocol), endpoint_id(b, bp, a, ap, protocol))


def normalized_tuple(a: str = "src_ip", ap: str = "src_port", b: str = "dst_ip", bp: str = "dst_port") -> Column:
    """The lesser of both directions as a struct; ports compare as numbers."""
    def one(x, xp, y, yp):
        return F.struct(F.col(x).alias("ip_a"), F.col(xp).alias("port_a"), F.col(y).alias("ip_b"), F.col(yp).alias("port_b"))

    return F.least(one(a, ap, b, bp), one(b, bp, a, ap))


def is_service_port(port: Column) -> Column:
    """Privileged, or one of the well-known ports under the ephemeral range."""
    return (port < C.PRIVILEGED_LIMIT) | ((port < C.EPHEMERAL_FROM) & port.isin(*C.SERVICE_PORTS))


def is_ephemeral(port: Column) -> Column:
    return port.between(32768, 60999) | port.between(49152, 65535)


def is_outer(ip: Column) -> Column:
    return ip.startswith("172.16.")


def is_internal(ip: Column) -> Column:
    """Private IPv4 ranges, loopback and link-local included."""
    return ip.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.)")


def is_broadcast(ip: Column) -> Column:
    """Ends in .255, multicast or unspecified."""
    return ip.rlike(r"\.255$|^(22[4-9]|23\d)\.|^0\.0\.0\.0$|^[fF][fF]")


def is_ipv4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x.cast("int") <= 255)


def guid(*parts: Column) -> Column:
    """Braced UUID text of the md5 of the lower-cased parts, joined by '|'; empty and null parts are left out."""
    h = F.md5(F.lower(F.concat_ws("|", *[F.nullif(p.cast("string"), F.lit("")) for p in parts])))
    return F.concat(F.lit("{"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit("}"))


def signal_guid(protocol: Column, host: Column, port: Column, *ids: Column) -> Column:
    """Like guid, but ids keep their case."""
    named = [F.nullif(i.cast("string"), F.lit("")) for i in ids]
    h = F.md5(F.concat_ws("|", F.lit("ICSSignal"), F.lower(F.trim(protocol)), F.lower(F.trim(host)), port.cast("string"), *named))
    return F.concat(F.lit("{"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit("}"))


def running_guid(*parts: Column) -> Column:
    """The UUID text that running flows' endpoints have: md5 of the parts joined by ':', without braces, in their own case."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def inferred_service_port(src_port: Column, dst_port: Column) -> Column:
    """The service port of a packet of a running flow: Modbus on either side, else a port under 1024, the target's first; else null."""
    modbus = (src_port == C.MODBUS_PORT) | (dst_port == C.MODBUS_PORT)
    return F.when(modbus, C.MODBUS_PORT).when(dst_port < 1024, dst_port).when(src_port < 1024, src_port)


def map_of(values: dict, key: Column) -> Column:
    """values[key], or null, from a literal map."""
    pairs = [F.lit(x) for kv in sorted(values.items()) for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def service_name(port: Column) -> Column:
    return F.when(port <= 0, "Ephemeral Service").otherwise(F.coalesce(map_of(C.SERVICE_NAMES, port), F.concat(F.lit("Port "), port.cast("string"))))


#: Host names by address that expressions are built with; bounded by an inventory's size.
_names: ContextVar[dict[str, str]] = ContextVar("names", default=C.HOST_NAMES)


@contextlib.contextmanager
def naming(names: dict[str, str]) -> Iterator[None]:
    """Within it host_name uses these names."""
    token = _names.set(names)
    try:
        yield
    finally:
        _names.reset(token)


def host_name(ip: Column) -> Column:
    """The name of an address, or the address itself."""
    return F.coalesce(map_of(_names.get(), ip), ip)


def register_type(function: Column) -> Column:
    """The kind of register that a Modbus function code addresses."""
    return F.when(function.isin(1, 5, 15), "coil").when(function == 2, "discreteInput").when(function.isin(3, 6, 16, 23), "holdingRegister").when(function == 4, "inputRegister")


def directionality(out_bytes: Column, in_bytes: Column) -> Column:
    """out/in; 0 without any bytes, null where only the inbound side is empty."""
    return F.when((out_bytes == 0) & (in_bytes == 0), F.lit(0.0)).when(in_bytes == 0, None).otherwise(out_bytes.cast("double") / in_bytes)


def value_text(value: Column) -> Column:
    """Whole numbers without a fraction, others with three digits."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string("%.3f", value))


def parse_time(text: Column) -> Column:
    """Epoch seconds of numbers (milliseconds above 1e12), of six text formats and of datetime('...'); else null.

    Texts without a zone are UTC.
    """
    bare = F.trim(F.regexp_replace(F.trim(text), r"^datetime\(\s*['\"]?(.*?)['\"]?\s*\)$", "$1"))
    number = bare.try_cast("double")
    utc = F.concat(F.regexp_replace(bare, "Z$", ""), F.lit("+00:00"))
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]xxx", "yyyy-MM-dd HH:mm:ss[.SSSSSS]xxx")
    stamps = [F.unix_micros(F.try_to_timestamp(utc, F.lit(f))) / 1e6 for f in formats]
    return F.coalesce(F.when(number > 1e12, number / 1000).otherwise(number), *stamps)


def coerce_port(text: Column) -> Column:
    """A port as int; names for 'any' are 0, fractions are cut, other texts null."""
    t = F.lower(F.trim(text))
    return F.when(t.isNull() | t.isin("", "aggregated", "any", "unknown", "none"), 0).otherwise(t.try_cast("double").cast("int"))


def safe_int(text: Column) -> Column:
    """A number's whole part; empty texts, 'None' and words are null."""
    return F.trim(text).try_cast("double").cast("long")


def safe_bool(text: Column) -> Column:
    """true, yes, 1 and false, no, 0 in any case; else null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


def transport(text: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(text)), F.lit("")), F.lit("tcp"))


def tcp_flag_text(bits: Column) -> Column:
    """Letters of the set flag bits in the order F S R P A U E C."""
    return F.concat(*[F.when(bits.bitwiseAND(1 << k) != 0, c).otherwise("") for k, c in enumerate("FSRPAUEC")])


def display_tag(node_id: Column) -> Column:
    """What follows ';s=' of a node id, with '"a"."b"' as a.b; other ids as they are."""
    tail = F.when(F.contains(node_id, F.lit(";s=")), F.substring_index(node_id, ";s=", -1)).otherwise(node_id)
    return F.replace(tail, F.lit('"'), F.lit(""))


def modbus_key() -> Column:
    """What ties a Modbus response to its request; the server is the side of the service port."""
    to_server = F.col("dst_port") == C.MODBUS_PORT
    pick = lambda a, b: F.when(to_server, F.col(a)).otherwise(F.col(b))
    return F.struct(pick("src_ip", "dst_ip").alias("client"), pick("src_port", "dst_port").alias("client_port"), pick("dst_ip", "src_ip").alias("server"), F.coalesce("modbus_unit_id", F.lit(-1)).alias("unit"), F.col("modbus_transaction_id").alias("txid"))
