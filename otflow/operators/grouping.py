"""Grouping flows into client-service edges, stage by stage.

Stages run in order: modbus, http_monitor, mqtt, opcua, collapsed, individual.
What a stage has consumed is an explicit table (canonical_id, stage); Modbus and monitor stages consume every flow they group, even
where policy or scope rejects the group, MQTT and OPC UA only what they emit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow import constants as C
from otflow.operators import flows as fl
from otflow.operators import policy

GROUP = ("client_ip", "server_ip", "server_port", "protocol")


def grouped(oriented: DataFrame, *also: str) -> DataFrame:
    """Edges of oriented flows: one row per client, server, port and protocol, and of the columns also."""
    sides = oriented.where("client is not null").select(
        F.col("client.ip").alias("client_ip"), F.col("client.port").alias("client_port"), F.col("server.ip").alias("server_ip"), F.col("server.port").alias("server_port"),
        "protocol", "canonical_id", "packets", "bytes", "layer", "first_us", "last_us", *also,
    )
    return sides.groupBy(*GROUP, *also).agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_distinct("client_port").alias("client_ports"),
        F.min("client_port").alias("port_min"),
        F.max("client_port").alias("port_max"),
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.max("layer").alias("layer"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )


def accepted(groups: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Groups that are exempt or that the policy accepts as one connection from client port 0."""
    as_flow = groups.withColumns({"src_ip": F.col("client_ip"), "dst_ip": F.col("server_ip"), "src_port": F.lit(0), "dst_port": F.col("server_port")})
    return as_flow.where(policy.interesting() if exempt is None else exempt | policy.interesting()).select(*groups.columns)


@dataclass(frozen=True)
class Stage:
    """A protocol's way to pick flows and to tell client from server, as expressions on a flow's row.

    always: takes its flows even where an earlier stage has consumed them;
    checked: the policy is applied to the group; else to each flow.
    """

    name: str
    where: Callable[[], Column]
    ends: Callable[[], tuple[Column, Column]]
    always: bool = False
    checked: bool = False

    def oriented(self, flows: DataFrame) -> DataFrame:
        client, server = self.ends()
        picked = flows.where(self.where() if self.checked else self.where() & policy.interesting())
        return picked.withColumns({"client": client, "server": server})


def _holds(port: int) -> Column:
    return (F.col("src_port") == port) | (F.col("dst_port") == port)


#: Protocol stages in their order. New protocols are further entries.
STAGES = (
    Stage("modbus", lambda: fl.is_modbus() & _holds(C.MODBUS_PORT), lambda: fl.port_ends((C.MODBUS_PORT,)), always=True, checked=True),
    Stage("http_monitor", lambda: fl.is_monitor() & _holds(C.MONITOR_PORT), lambda: fl.port_ends((C.MONITOR_PORT,)), always=True, checked=True),
    Stage("mqtt", fl.is_mqtt, fl.mqtt_ends),
    Stage("opcua", fl.is_opcua, fl.opcua_ends),
)


def stage(name: str) -> Stage:
    """The stage of a name; an unknown one takes no flows."""
    nothing = Stage(name, lambda: F.lit(False), lambda: fl.port_ends((0,)), checked=True)
    return next((s for s in STAGES if s.name == name), nothing)


def collapsed(flows: DataFrame, min_ports: int = C.MIN_CLIENT_PORTS) -> DataFrame:
    """Edges of flows that use at least min_ports client ports."""
    oriented = fl.orient(flows).where("client.port > 0 and server.port > 0")
    return grouped(oriented).where(F.col("client_ports") >= min_ports)


def run_stages(flows: DataFrame, stages: Sequence[Stage] = STAGES, min_ports: int = C.MIN_CLIENT_PORTS) -> tuple[DataFrame, DataFrame]:
    """Edges of all stages with a stage column, and what each stage consumed (canonical_id, stage).

    The protocol stages are decided on each flow's row, so they cost one
    aggregation together; only the collapsed stage has to look at its groups
    before it knows its flows.
    """
    # Each step names its outcome, so that later ones don't repeat its expression.
    flows = flows.withColumns({"_fine": policy.interesting(), "_taken": F.lit(False)})
    for s in stages:
        client, server = s.ends()
        hit = s.where() if s.checked else s.where() & F.col("_fine")
        hit = hit if s.always else hit & ~F.col("_taken")
        flows = flows.withColumns({f"_{s.name}": F.when(hit, F.struct(F.lit(s.name).alias("stage"), client.alias("client"), server.alias("server")))})
        flows = flows.withColumn("_taken", F.col("_taken") | F.col(f"_{s.name}.client").isNotNull())
    picks = [F.when(F.col(f"_{s.name}.client").isNotNull(), F.col(f"_{s.name}")) for s in stages]
    frames, consumed = [], []
    if picks:
        staged = flows.withColumn("_pick", F.explode(F.array_compact(F.array(*picks)))).withColumns({c: F.col(f"_pick.{c}") for c in ("stage", "client", "server")})
        groups = grouped(staged, "stage")
        checked = [s.name for s in stages if s.checked]
        frames.append(accepted(groups, ~F.col("stage").isin(checked) if checked else F.lit(True)))
        consumed.append(staged.select("canonical_id", "stage"))
    left = fl.orient(flows.where("not _taken"))
    ported = left.where("client.port > 0 and server.port > 0")
    groups = grouped(ported).where(F.col("client_ports") >= min_ports)
    frames.append(accepted(groups).withColumn("stage", F.lit("collapsed")))
    keys = groups.select(*GROUP, F.lit(True).alias("_collapsed"))
    named = left.withColumns({"client_ip": F.col("client.ip"), "server_ip": F.col("server.ip"), "server_port": F.col("server.port")})
    told = named.join(keys, list(GROUP), "left").withColumn("_collapsed", F.coalesce("_collapsed", F.lit(False)) & (F.col("client.port") > 0))
    consumed.append(told.where("_collapsed").select("canonical_id", F.lit("collapsed").alias("stage")))
    alone = told.where("(_collapsed is null or not _collapsed) and _fine")
    frames.append(_alone(alone).withColumn("stage", F.lit("individual")))
    return _union(frames), _union(consumed)


def individual(flows: DataFrame) -> DataFrame:
    """One edge per flow; oriented flows carry client port 0, others their own ports."""
    return _alone(fl.orient(flows))


def _alone(oriented: DataFrame) -> DataFrame:
    known = F.col("client").isNotNull()
    pick = lambda a, b: F.when(known, F.col(a)).otherwise(F.col(b))
    port = F.when(known, 0).otherwise(F.col("src_port"))
    return oriented.select(
        pick("client.ip", "src_ip").alias("client_ip"), pick("server.ip", "dst_ip").alias("server_ip"), pick("server.port", "dst_port").alias("server_port"), "protocol",
        F.lit(1).cast("long").alias("flows"), F.lit(1).cast("long").alias("client_ports"), port.alias("port_min"), port.alias("port_max"), "packets", "bytes", "layer", "first_us", "last_us",
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out
