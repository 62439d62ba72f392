"""Incremental runs: the same operators over packet streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from otflow import constants as C
from otflow.functions import columns as X
from otflow.operators import flows as fl


def flow_stats(packets: DataFrame) -> DataFrame:
    """Running statistics of every flow, of a table or a stream.

    One aggregation, so a stream keeps sums, extremes and small sets as state
    and no packets. Directions are judged against the final origin: sums are
    kept for both directions and named when the origin is known.
    """
    p = fl.with_canonical_id(packets)
    a_first = F.col("canonical_id") == X.endpoint_id("src_ip", "src_port", "dst_ip", "dst_port", "protocol")
    flag = lambda c: F.count_if(F.contains(F.col("tcp_flags"), F.lit(c)))
    distinct = lambda c: F.sort_array(F.collect_set(c))
    text = lambda c, n=None: F.array_join((distinct(c) if n is None else F.slice(distinct(c), 1, n)).cast("array<string>"), ",")
    client_port = F.when(X.is_service_port(F.col("dst_port")), F.col("src_port")).when(X.is_service_port(F.col("src_port")), F.col("dst_port"))
    kept = p.withColumns({"ahead": a_first, "client_port": client_port})
    stats = kept.groupBy("canonical_id").agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum("size").alias("total_bytes"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min_by("ahead", X.order_key()).alias("_origin_ahead"),
        F.count_if("ahead").alias("_ahead"),
        text("high_level_protocol").alias("protocols_seen"),
        flag("S").alias("syn_packets"),
        flag("F").alias("fin_packets"),
        flag("R").alias("rst_packets"),
        F.count_if(F.col("payload_len") > 0).alias("with_payload"),
        F.sum("payload_len").alias("payload_bytes"),
        text("modbus_function").alias("modbus_functions"),
        text("modbus_unit_id").alias("modbus_units"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("modbus_registers")))), 1, 50).alias("_registers"),
        text("http_method").alias("http_methods"),
        text("http_host", 5).alias("http_hosts"),
        text("tls_sni", 5).alias("tls_snis"),
        F.size(F.collect_set("client_port")).cast("long").alias("client_ports"),
        F.size(F.collect_set("pcap_file")).cast("long").alias("files"),
    )
    forward = F.when(F.col("_origin_ahead"), F.col("_ahead")).otherwise(F.col("packet_count") - F.col("_ahead"))
    return stats.withColumns(
        {
            "forward_packets": forward,
            "reverse_packets": F.col("packet_count") - forward,
            "directionality_ratio": F.round(forward / F.col("packet_count"), 6),
            "mean_payload": F.round(F.try_divide(F.col("payload_bytes"), F.col("with_payload")), 2),
            "duration_s": (F.col("last_us") - F.col("first_us")) / 1e6,
            "modbus_registers": F.array_join(F.col("_registers").cast("array<string>"), ","),
        }
    ).drop("_origin_ahead", "_ahead", "_registers")


PAIR_SCHEMA = "key string, ts_us long, function int, request_us long, registers string"
PAIR_STATE = "ts_us long, registers string"


def pair_requests(packets: DataFrame, watermark: str | None = None) -> DataFrame:
    """Modbus responses of a stream with the request that each one uses up.

    State is the latest request of a key. With a watermark, requests without
    an answer are forgotten after it; without, they stay.
    """
    key = F.concat_ws("|", *[F.coalesce(X.modbus_key()[c].cast("string"), F.lit("none")) for c in ("client", "client_port", "server", "unit", "txid")])
    rows = packets.where("modbus_transaction_id is not null").select(
        key.alias("key"), "ts_us", "packet_index", F.col("modbus_function").alias("function"), (F.col("dst_port") == C.MODBUS_PORT).alias("request"),
        F.array_join(F.col("modbus_registers").cast("array<string>"), ",").alias("registers"), F.timestamp_micros("ts_us").alias("at"),
    )
    timeout = GroupStateTimeout.NoTimeout
    if watermark:
        rows, timeout = rows.withWatermark("at", watermark), GroupStateTimeout.EventTimeTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pending = state.get if state.exists else None
        out = []
        frame = pd.concat(list(batches)).sort_values(["ts_us", "packet_index"])
        for row in frame.itertuples():
            if row.request:
                pending = (int(row.ts_us), row.registers)
            else:
                out.append((key[0], int(row.ts_us), int(row.function), pending[0] if pending else None, pending[1] if pending else row.registers))
                pending = None
        if pending:
            state.update(pending)
            if watermark:
                # Also past a watermark that has moved on meanwhile.
                state.setTimeoutTimestamp(max(int(pending[0]) // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "ts_us", "function", "request_us", "registers"]).astype({"request_us": "Int64"})

    return rows.groupBy("key").applyInPandasWithState(run, PAIR_SCHEMA, PAIR_STATE, "append", timeout)


def run_stats(packets: DataFrame, table_path: str, checkpoint: str, of: Callable[[DataFrame], DataFrame] = flow_stats) -> None:
    """Read what a stream has now, and write each step's changed flows as a table of its own under table_path.

    A repeated step overwrites its own folder, so results hold after a failure;
    latest() gives each flow's last state.
    """

    def write(batch: DataFrame, step: int) -> None:
        batch.withColumn("step", F.lit(step).cast("long")).write.mode("overwrite").parquet(f"{table_path}/batch={step}")

    of(packets).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(states: DataFrame) -> DataFrame:
    """The last state of each flow from the tables that run_stats has written."""
    columns = [c for c in states.columns if c not in ("canonical_id", "step", "batch")]
    return states.groupBy("canonical_id").agg(F.max_by(F.struct(*columns), "step").alias("s")).select("canonical_id", "s.*")


def traffic_windows(packets: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Packets and bytes per service port in tumbling windows, of a table or a stream.

    late: how far packets may come after the latest one, which lets a stream
    close its windows; without it every window stays open.
    """
    rows = packets.select(F.timestamp_micros("ts_us").alias("at"), "size", F.least("src_port", "dst_port").alias("port"))
    rows = rows.withWatermark("at", late) if late else rows
    counted = rows.groupBy(F.window("at", width).alias("w"), "port").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))
    return counted.select(F.unix_micros("w.start").alias("start_us"), "port", "packets", "bytes")
