"""Flows of a stream as keyed state: sums, bounded sets and samples, which leave when a flow is idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from otflow.functions import columns as X
from otflow.operators import flows as fl

#: The state store that holds several states of a key; a query needs it as spark.sql.streaming.stateStore.providerClass.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Sets that a flow keeps, each with how many of its smallest values; None: all, as there are few.
SETS = {"protocols_seen": None, "modbus_functions": None, "modbus_units": None, "http_methods": None, "http_hosts": 5, "tls_snis": 5, "modbus_registers": 50, "client_ports": None, "files": None}
NUMBERS = ("modbus_functions", "modbus_units", "modbus_registers")
SUMS = ("packet_count", "total_bytes", "ahead", "syn_packets", "fin_packets", "rst_packets", "with_payload", "payload_bytes")
#: Packets of a flow that are kept as a sample, the first ones.
SAMPLE = 100

_TOTALS = ", ".join(f"{c} long" for c in SUMS) + ", first_us long, last_us long, origin_us long, origin_file string, origin_index long, origin_ahead boolean"
OUTPUT = (
    "canonical_id string, packet_count long, total_bytes long, first_us long, last_us long, protocols_seen string, syn_packets long, fin_packets long, rst_packets long, with_payload long, "
    "payload_bytes long, modbus_functions string, modbus_units string, http_methods string, http_hosts string, tls_snis string, client_ports long, files long, forward_packets long, "
    "reverse_packets long, directionality_ratio double, mean_payload double, duration_s double, modbus_registers string, sampled int, closed boolean"
)


def _inputs(packets: DataFrame) -> DataFrame:
    """What a flow's state takes of a packet: numbers and flags made by Spark, so that the state only adds."""
    client_port = F.when(X.is_service_port(F.col("dst_port")), F.col("src_port")).when(X.is_service_port(F.col("src_port")), F.col("dst_port"))
    flag = lambda c: F.contains(F.col("tcp_flags"), F.lit(c)).cast("long")
    one = lambda c: F.array_compact(F.array(F.col(c).cast("string")))
    return fl.with_canonical_id(packets).select(
        "canonical_id", "ts_us", "pcap_file", "packet_index",
        F.timestamp_micros("ts_us").alias("at"),
        F.col("size").cast("long").alias("total_bytes"),
        (F.col("canonical_id") == X.endpoint_id("src_ip", "src_port", "dst_ip", "dst_port", "protocol")).alias("is_ahead"),
        flag("S").alias("syn_packets"), flag("F").alias("fin_packets"), flag("R").alias("rst_packets"),
        (F.col("payload_len") > 0).cast("long").alias("with_payload"), F.col("payload_len").cast("long").alias("payload_bytes"),
        one("high_level_protocol").alias("protocols_seen"), one("modbus_function").alias("modbus_functions"), one("modbus_unit_id").alias("modbus_units"),
        one("http_method").alias("http_methods"), one("http_host").alias("http_hosts"), one("tls_sni").alias("tls_snis"),
        F.coalesce(F.col("modbus_registers").cast("array<string>"), F.array().cast("array<string>")).alias("modbus_registers"),
        F.array_compact(F.array(client_port.cast("string"))).alias("client_ports"), one("pcap_file").alias("files"),
    )


def _smallest(name: str, values: set[str]) -> list[str]:
    ordered = sorted(values, key=int if name in NUMBERS else str)
    return ordered[: SETS[name]]


class FlowState(StatefulProcessor):
    """A flow's totals (a value), sets (a map of name and value) and sample (a list of packets), and a timer that ends it."""

    def __init__(self, idle_ms: int, sample: int):
        self.idle_ms, self.sample = idle_ms, sample

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _TOTALS)
        self.sets = handle.getMapState("sets", "name string, value string", "seen boolean")
        self.packets = handle.getListState("sample", "ts_us long, pcap_file string, packet_index long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip(_NAMES, self.totals.get())) if self.totals.exists() else dict.fromkeys(SUMS, 0)
        sets = self._sets()
        before = {name: set(values) for name, values in sets.items()}
        sample = list(self.packets.get()) if held["packet_count"] else []
        for frame in rows:
            held["packet_count"] += len(frame)
            for name in SUMS[1:]:
                held[name] += int(frame["is_ahead" if name == "ahead" else name].sum())
            held["first_us"] = min(held.get("first_us", 1 << 62), int(frame["ts_us"].min()))
            held["last_us"] = max(held.get("last_us", -(1 << 62)), int(frame["ts_us"].max()))
            order = frame.sort_values(["ts_us", "pcap_file", "packet_index"]).head(max(self.sample, 1))
            first = order.iloc[0]
            origin = (int(first["ts_us"]), first["pcap_file"], int(first["packet_index"]), bool(first["is_ahead"]))
            if "origin_us" not in held or origin[:3] < (held["origin_us"], held["origin_file"], held["origin_index"]):
                held.update(zip(("origin_us", "origin_file", "origin_index", "origin_ahead"), origin))
            sample += [(int(t), f, int(i)) for t, f, i in zip(order["ts_us"], order["pcap_file"], order["packet_index"])]
            sample = sorted(sample)[: self.sample]
            for name in SETS:
                found = sets.setdefault(name, set())
                for values in frame[name]:
                    found.update(values)
                sets[name] = set(_smallest(name, found))
        self.totals.update(tuple(held[c] for c in _NAMES))
        self.packets.put(sample)
        for name, values in sets.items():
            for value in before.get(name, set()) - values:
                self.sets.removeKey((name, value))
            for value in values - before.get(name, set()):
                self.sets.updateValue((name, value), (True,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(held["last_us"] // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key[0], held, sets, len(sample), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = dict(zip(_NAMES, self.totals.get()))
        row = self._row(key[0], held, self._sets(), len(list(self.packets.get())), True)
        self.totals.clear()
        self.sets.clear()
        self.packets.clear()
        yield row

    def close(self) -> None:
        pass

    def _sets(self) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for (name, value), _ in self.sets.iterator() if self.sets.exists() else ():
            out.setdefault(name, set()).add(value)
        return out

    def _row(self, name: str, held: dict, sets: dict[str, set[str]], sampled: int, closed: bool) -> pd.DataFrame:
        ahead, n = held["ahead"], held["packet_count"]
        forward = ahead if held["origin_ahead"] else n - ahead
        row = {c: held[c] for c in ("packet_count", "total_bytes", "first_us", "last_us", *SUMS[3:])}
        row |= {c: ",".join(_smallest(c, sets.get(c, set()))) for c in SETS if c not in ("client_ports", "files")}
        row |= {c: len(sets.get(c, set())) for c in ("client_ports", "files")}
        row |= {"canonical_id": name, "forward_packets": forward, "reverse_packets": n - forward, "directionality_ratio": round(forward / n, 6), "duration_s": (held["last_us"] - held["first_us"]) / 1e6}
        row |= {"mean_payload": round(held["payload_bytes"] / held["with_payload"], 2) if held["with_payload"] else None, "sampled": sampled, "closed": closed}
        return pd.DataFrame([[row[c] for c in _COLUMNS]], columns=_COLUMNS).astype({"mean_payload": float, "sampled": "int32"})


_NAMES = [c.split()[0] for c in _TOTALS.split(", ")]
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def running_flows(packets: DataFrame, idle: str = "10 minutes", idle_ms: int = 600_000, sample: int = SAMPLE) -> DataFrame:
    """The statistics of flow_stats for each flow of a stream that a step changes, and once more, closed, when it has been idle.

    idle is the watermark's delay and idle_ms how long after its last packet a
    flow ends, both in event time. A flow's state has a bound: sums, sets of
    few values or of the smallest ones, and its first packets as a sample; it
    is dropped as the flow ends, and a later packet of the same ends begins a
    new one. Packets that come after the watermark are left out.
    """
    rows = _inputs(packets).withWatermark("at", idle)
    return rows.groupBy("canonical_id").transformWithStateInPandas(FlowState(idle_ms, sample), OUTPUT, "Update", "EventTime")


def run_flows(packets: DataFrame, folder: str, checkpoint: str, **of) -> None:
    """Read what a stream has now, and write each step's flows as a table of its own under folder; a repeated step overwrites its own."""
    found = packets.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    if found != PROVIDER:
        raise ValueError(f"running flows need spark.sql.streaming.stateStore.providerClass={PROVIDER}")

    def write(batch: DataFrame, step: int) -> None:
        batch.withColumn("step", F.lit(step).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={step}")

    running_flows(packets, **of).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """canonical_id, packet_count, total_bytes, first_us and last_us of the flows that a stream's state holds now."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "totals").load()
    return held.select(F.col("key.canonical_id").alias("canonical_id"), "value.packet_count", "value.total_bytes", "value.first_us", "value.last_us")


def samples(spark: SparkSession, checkpoint: str) -> DataFrame:
    """canonical_id, ts_us, pcap_file and packet_index of the packets that a stream's state keeps of its open flows."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "sample").load()
    return held.select(F.col("key.canonical_id").alias("canonical_id"), "list_element.ts_us", "list_element.pcap_file", "list_element.packet_index")
