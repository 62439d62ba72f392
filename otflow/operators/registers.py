"""Register and signal observations, their statistics and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.functions import columns as X


def paired(packets: DataFrame) -> DataFrame:
    """Modbus packets with request (bool), key and, on responses, the request's registers (null for an orphan).

    A request is used up by its first response, so a response pairs exactly
    where the packet before it with its key is a request. Packets without a
    transaction id never pair.
    """
    p = packets.where("modbus_function is not null").withColumns({"request": F.col("dst_port") == C.MODBUS_PORT, "key": X.modbus_key()})
    before = Window.partitionBy("key").orderBy(X.order_key())
    asked = F.lag(F.when(F.col("request"), F.struct("modbus_registers", "ts_us"))).over(before)
    return p.withColumn("asked", F.when(~F.col("request") & F.col("modbus_transaction_id").isNotNull(), asked))


def observations(packets: DataFrame) -> DataFrame:
    """One row per register value seen: client, server, unit, register, kind, access, value, ts_us, ts of the request.

    Requests give the values they write; responses give values at the request's
    registers: reads for reading functions, writes for the echoes of functions
    5 and 6 and for orphans.
    """
    p = paired(packets)
    reading = F.col("modbus_function").isin(1, 2, 3, 4, 23)
    at = F.coalesce(F.when(~F.col("request"), F.col("asked.modbus_registers")), F.col("modbus_registers"))
    access = F.when(F.col("request"), "write").when(reading & F.col("asked").isNotNull(), "read").otherwise("write")
    pairs = F.explode(F.arrays_zip(at.alias("register"), F.col("modbus_register_values").alias("value")))
    rows = p.where("modbus_register_values is not null").withColumn("access", access).withColumn("pair", pairs).where("pair.value is not null and pair.register is not null")
    return rows.select(
        F.col("key.client").alias("client_ip"), F.col("key.server").alias("server_ip"), F.col("modbus_unit_id").alias("unit"), F.col("pair.register").alias("register"),
        X.register_type(F.col("modbus_function")).alias("kind"), "access", F.col("pair.value").alias("value"), F.col("modbus_function").alias("function"), "modbus_transaction_id",
        "ts_us", "pcap_file", "packet_index", F.col("request").alias("is_request"), F.col("asked.ts_us").alias("request_us"),
    )


SERIES = ("client_ip", "server_ip", "unit", "register", "kind")


def with_series(obs: DataFrame, *parts: str) -> DataFrame:
    """obs with a text key of its series; a missing unit reads 'none'."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in parts or SERIES]
    return obs.withColumn("series", F.concat_ws("|", *texts))


def statistics(obs: DataFrame) -> DataFrame:
    """Counts, mean, extremes, last value, last write and functions of each series."""
    return obs.groupBy("series").agg(
        F.count_if(F.col("access") == "read").alias("reads"),
        F.count_if(F.col("access") == "write").alias("writes"),
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg("value"), 3).alias("mean_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.max_by("value", X.order_key()).alias("last_value"),
        F.max("ts_us").alias("last_us"),
        F.max(F.when(F.col("access") == "write", F.col("ts_us"))).alias("last_write_us"),
        F.max_by("function", X.order_key()).alias("last_function"),
        F.array_join(F.sort_array(F.collect_set("function")).cast("array<string>"), ",").alias("functions"),
    )


#: Microseconds of a slot of time, within which a task looks at a series row by row.
SLOT = 3_600_000_000


def slot_runs(obs: DataFrame, slot_us: int = SLOT) -> DataFrame:
    """Runs of equal successive values within slots of time: series, slot, run (from 1), value and n."""
    order = Window.partitionBy("series", "slot").orderBy(X.order_key())
    placed = obs.withColumn("slot", F.floor(F.col("ts_us") / slot_us))
    new = (F.row_number().over(order) == 1) | ~F.col("value").eqNullSafe(F.lag("value").over(order))
    marked = placed.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("series", "slot", "run").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n"))


def run_edges(runs: DataFrame) -> DataFrame:
    """How the slots of a series meet: series, slot, goes_on (1 if its first run goes on that of the slot before), before (runs up to there), after and total.

    A slot is summed up by its first and last value and its number of runs, and
    such sums add up in the order of slots; so a series of any length costs one
    row a slot here, and tasks of even size before.
    """
    edges = runs.groupBy("series", "slot").agg(F.min_by("value", "run").alias("first"), F.max_by("value", "run").alias("last"), F.max("run").alias("n"))
    order = Window.partitionBy("series").orderBy("slot")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.when((F.row_number().over(order) > 1) & F.col("first").eqNullSafe(F.lag("last").over(order)), 1).otherwise(0)
    summed = edges.withColumn("goes_on", goes_on).withColumn("after", F.sum(F.col("n") - F.col("goes_on")).over(upto))
    return summed.select("series", "slot", "goes_on", (F.col("after") - F.col("n") + F.col("goes_on")).alias("before"), "after", F.max("after").over(Window.partitionBy("series")).alias("total"))


def state_changes(obs: DataFrame, slot_us: int = SLOT) -> DataFrame:
    """Changes between successive values of coils and discrete inputs: one less than their runs."""
    states = obs.where(F.col("kind").isin("coil", "discreteInput"))
    return run_edges(slot_runs(states, slot_us)).groupBy("series").agg((F.max("total") - 1).alias("changes"))


def quantised(rows: DataFrame) -> DataFrame:
    """rows with whole values, halves to the even neighbour: the form in which float signals are counted and run."""
    return rows.withColumn("value", F.rint("value").cast("long"))


def bucket_distinct(obs: DataFrame) -> DataFrame:
    """Number of used buckets of 64 of whole values, an estimate of distinct ones that is full at 64; -1 counts as -2."""
    v = F.col("value").cast("long")
    v = F.when(v == -1, -2).otherwise(v)
    bit = F.expr("1L").cast("long")
    bucket = F.call_function("shiftleft", bit, F.pmod(v, F.lit(64)).cast("int"))
    return obs.groupBy("series").agg(F.bit_count(F.bit_or(bucket)).cast("int").alias("buckets"))


def top_values(obs: DataFrame, n: int = C.TOP_VALUES) -> DataFrame:
    """Counts of the first n distinct values seen: 'value:count,...' by count, then value."""
    counts = obs.groupBy("series", "value").agg(F.count(F.lit(1)).alias("n"), F.min(X.order_key()).alias("first"))
    order = Window.partitionBy("series").orderBy("first")
    kept = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value", "n")))
    return kept.groupBy("series").agg(F.array_join(F.transform(listed, lambda s: F.concat(s["value"].cast("string"), F.lit(":"), s["n"].cast("string"))), ",").alias("top_values"))


def run_lengths(obs: DataFrame, keep: int = C.RLE_RUNS, slot_us: int = SLOT) -> DataFrame:
    """Runs of equal successive values as 'value:length,...', the last keep of them.

    Runs are found within slots of time and joined where slots meet; only slots
    that hold some of the last ones are listed, so a list has at most keep
    entries.
    """
    runs = slot_runs(obs, slot_us)
    edges = run_edges(runs)
    samples = obs.groupBy("series").agg(F.count(F.lit(1)).alias("samples"))
    late = edges.where(F.col("after") > F.col("total") - keep)
    placed = runs.join(late, ["series", "slot"]).select("series", "value", "n", "total", (F.col("before") + F.col("run") - F.col("goes_on")).alias("run"))
    # The first of the last runs may begin in a slot before them, which then has it as its own last one.
    kept = placed.where(F.col("run") > F.col("total") - keep).groupBy("series", "run").agg(F.first("value").alias("value"), F.sum("n").alias("n"), F.first("total").alias("total"))
    listed = F.array_sort(F.collect_list(F.struct("run", "value", "n")))
    texts = kept.groupBy("series").agg(
        F.array_join(F.transform(listed, lambda s: F.concat(s["value"].cast("string"), F.lit(":"), s["n"].cast("string"))), ",").alias("rle"),
        F.first("total").alias("runs"),
    )
    return texts.join(samples, "series").select("series", "rle", "runs", F.round(F.col("samples") / F.col("runs"), 2).alias("ratio"), (F.col("runs") > keep).alias("truncated"))


def acknowledged(obs: DataFrame) -> DataFrame:
    """Writes that were requested, with whether and when a later response of client, server and transaction came.

    What counts is the next response after the write: going backwards it is the
    last one seen, so the frame only grows. Writes without a transaction id are
    never acknowledged, and share no group.
    """
    alone = F.when(F.col("modbus_transaction_id").isNull(), F.struct("pcap_file", "packet_index"))
    order = Window.partitionBy("client_ip", "server_ip", "modbus_transaction_id", alone).orderBy(X.order_key().desc())
    answer = F.last(F.when(~F.col("is_request"), F.col("ts_us")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return obs.withColumn("response_us", answer).where("is_request and access = 'write'").select("series", "modbus_transaction_id", "ts_us", "packet_index", "value", "response_us", F.col("response_us").isNotNull().alias("acknowledged"))


def observation_statistics(obs: DataFrame) -> DataFrame:
    """Rows by access and kind with distinct series and registers."""
    return obs.groupBy("access", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series").alias("series_n"), F.count_distinct("server_ip", "register").alias("registers"))


def opcua_pairs(packets: DataFrame) -> DataFrame:
    """OPC UA responses with the node ids of the latest request of their key; requests are not used up."""
    p = packets.where("opcua_request_id is not null")
    to_server = F.col("dst_port") == C.OPCUA_PORT
    client = F.when(to_server, F.col("src_ip")).otherwise(F.col("dst_ip"))
    key = F.struct(client.alias("client"), F.coalesce("opcua_secure_channel_id", F.lit(-1)).alias("channel"), F.col("opcua_request_id").alias("request"))
    order = Window.partitionBy("key").orderBy(X.order_key()).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("to_server"), F.struct("opcua_node_ids", "opcua_operation", "ts_us")), ignorenulls=True)
    return p.withColumns({"key": key, "to_server": to_server}).withColumn("asked", asked.over(order))


def opcua_signals(packets: DataFrame) -> DataFrame:
    """One row per value of a node: node, access, value; namespaces 0 and 1 and TD_ names are left out."""
    p = opcua_pairs(packets)
    agree = F.col("asked.opcua_operation") == F.col("opcua_operation")
    nodes = F.when(F.col("to_server"), F.col("opcua_node_ids")).when(agree, F.col("asked.opcua_node_ids"))
    rows = p.where("opcua_values is not null").withColumn("pair", F.explode(F.arrays_zip(nodes.alias("node"), F.col("opcua_values").alias("value"))))
    rows = rows.where("pair.node is not null and pair.value is not null").select(F.col("pair.node").alias("node"), F.col("opcua_operation").alias("access"), F.col("pair.value").alias("value"), "ts_us", "pcap_file", "packet_index", "src_ip", "dst_ip", "src_port", "dst_port")
    tag = X.display_tag(F.col("node"))
    return rows.where(~F.col("node").startswith("ns=0;") & ~F.col("node").startswith("ns=1;") & ~tag.startswith("TD_")).withColumn("series", tag)


def mqtt_signals(packets: DataFrame) -> DataFrame:
    """One row per numeric field of a published message; to the broker is a write, from it a read."""
    rows = packets.where("mqtt_packet_type = 'PUBLISH' and mqtt_topic is not null").withColumn("f", F.explode("mqtt_payload_values"))
    access = F.when(F.col("dst_port").isin(*C.MQTT_PORTS), "write").otherwise("read")
    return rows.select(F.concat_ws(".", "mqtt_topic", "f.name").alias("series"), access.alias("access"), F.col("f.value").alias("value"), "ts_us", "pcap_file", "packet_index", "src_ip", "dst_ip", "src_port", "dst_port").where("not isnan(value) and abs(value) < double('infinity')")


def signal_statistics(rows: DataFrame) -> DataFrame:
    """Counts, mean, extremes and last value of float signals."""
    return rows.groupBy("series").agg(
        F.count_if(F.col("access") == "read").alias("reads"),
        F.count_if(F.col("access") == "write").alias("writes"),
        F.round(F.avg("value"), 3).alias("mean_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.max_by("value", X.order_key()).alias("last_value"),
    )
