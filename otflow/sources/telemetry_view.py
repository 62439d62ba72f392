"""Telemetry anchors derived from the packet view, as hosts would have reported them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otflow.operators import flows as fl


def anchors(flows: DataFrame) -> DataFrame:
    """An anchor for every flow whose first packet's number is divisible by 3.

    Half of them know the client's port, a quarter report the session two
    minutes late, a fifth have no sessions, and some no process.
    """
    known = fl.orient(flows).where("client is not null and first_index % 3 = 0")
    n = F.col("first_index")
    session = F.struct(F.col("client.port").alias("port"), (F.col("first_us") + F.when(n % 4 == 0, 120_000_000).otherwise(0)).alias("ts_us"))
    text = lambda c: F.concat(F.lit(c), (n % 7).cast("string"))
    process = F.struct(
        F.when(n % 5 != 0, text("g")).alias("guid"), F.when(n % 5 != 0, text("image")).alias("image"), (n % 7).cast("int").alias("pid"), F.lit("svc").alias("user"), F.lit(None).cast("string").alias("computer")
    )
    opened = F.when(n % 5 < 3, F.col("first_us") + (n % 7 - 3) * 50_000_000)
    return known.select(
        n.alias("anchor_seq"),
        F.col("client.ip").alias("src_ip"),
        F.when(n % 2 == 0, F.col("client.port")).otherwise(0).alias("src_port"),
        F.col("server.ip").alias("dst_ip"),
        F.col("server.port").alias("dst_port"),
        "protocol",
        F.when(n % 15 == 0, F.array().cast("array<struct<port:int,ts_us:bigint>>")).otherwise(F.array(session)).alias("sessions"),
        process.alias("process"),
        opened.alias("first_us"),
        F.when(n % 5 < 2, opened + (n % 4) * 40_000_000).alias("last_us"),
    )
