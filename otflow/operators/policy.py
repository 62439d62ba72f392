"""Which flows are worth an edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.functions import columns as X


def interesting(min_packets: int = C.MIN_PACKETS) -> Column:
    """The policy on a flow's row; the order of the tests matters."""
    src, dst, sp, dp = (F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port"))
    either = lambda test, a, b: test(a) | test(b)
    return (
        F.when(F.col("packets") == 0, False)
        .when(either(X.is_broadcast, src, dst), False)
        .when(F.col("layer") >= 1, True)
        .when(X.is_outer(src) & X.is_outer(dst), False)
        .when(F.col("packets") < min_packets, False)
        .when(X.is_ephemeral(sp) & X.is_ephemeral(dp), False)
        .when(sp.isin(*C.IGNORED_PORTS) | dp.isin(*C.IGNORED_PORTS), False)
        .when(sp.isin(*C.INTERESTING_PORTS) | dp.isin(*C.INTERESTING_PORTS), True)
        .otherwise(either(X.is_internal, src, dst))
    )


def interesting_incremental(min_packets: int = C.MIN_PACKETS) -> Column:
    """The simpler policy of incremental runs."""
    quiet = lambda ip: ip.endswith(".255") | ip.startswith("224.") | ip.startswith("239.")
    ports = (137, 138, 5353, 1900)
    return (F.col("packets") >= min_packets) & ~quiet(F.col("src_ip")) & ~quiet(F.col("dst_ip")) & ~F.col("src_port").isin(*ports) & ~F.col("dst_port").isin(*ports)


def in_scope(flows: DataFrame, asset_ips: DataFrame | None) -> DataFrame:
    """Flows with either address among asset_ips (column ip); all where there is no inventory."""
    if asset_ips is None:
        return flows
    wanted = asset_ips.select(F.col("ip").alias("_ip")).distinct()
    ends = flows.select("canonical_id", F.explode(F.array("src_ip", "dst_ip")).alias("_ip"))
    return flows.join(ends.join(wanted, "_ip", "left_semi").select("canonical_id").distinct(), "canonical_id", "left_semi")
