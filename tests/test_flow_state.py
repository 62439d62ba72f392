"""Keyed state of streamed flows against the batch operators."""

import pytest
from pyspark.sql import functions as F

from otflow.operators import flows as fl
from otflow.operators import identity
from otflow.sources.packet_view import packets as packet_view
from otflow.streaming import flow_state
from otflow.streaming.flows import flow_stats

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", flow_state.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def columns(df):
    return sorted(c for c in df.columns if c not in ("step", "batch", "sampled", "closed"))


def test_stream_equals_batch_and_goes_on_after_a_stop(store, tmp_path):
    spark = store
    view = fl.without_ignored(packet_view(spark, SF)).withColumn("ts_us", F.col("packet_index") * 1_000_000 + 1_700_000_000_000_000)
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    view.repartition(1).sortWithinPartitions("ts_us").where("packet_index < 400").write.parquet(source)
    for more in (None, "packet_index >= 400"):
        if more:
            view.repartition(1).where(more).write.mode("append").parquet(source)
        flow_state.run_flows(spark.readStream.schema(view.schema).parquet(source), out, log, idle="10 hours", idle_ms=36_000_000)
    found = spark.read.parquet(out)
    last = found.groupBy("canonical_id").agg(F.max_by(F.struct(*columns(found)), "step").alias("s")).select("s.*")
    want = flow_stats(view)
    assert columns(last) == sorted(want.columns)
    got, plain = ({r["canonical_id"]: r.asDict() for r in df.collect()} for df in (last, want))
    assert {k: {c: (v, plain[k][c]) for c, v in r.items() if v != plain[k][c]} for k, r in got.items() if r != plain[k]} == {}
    assert found.where("closed").count() == 0
    held = flow_state.open_flows(spark, log)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, want.select("canonical_id", "packet_count", "total_bytes", "first_us", "last_us").collect()))
    kept = flow_state.samples(spark, log).select("canonical_id", "packet_index")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, identity.sample(view, flow_state.SAMPLE).select("canonical_id", "packet_index").collect()))


def test_idle_flows_leave_the_state(store, tmp_path):
    spark = store
    view = fl.without_ignored(packet_view(spark, SF)).withColumn("ts_us", F.when(F.col("packet_index") < 300, F.col("packet_index")).otherwise(F.col("packet_index") + 5000) * 1_000_000 + 1_700_000_000_000_000)
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for condition in ("packet_index < 300", "packet_index >= 300 and packet_index < 320", "packet_index = 320"):
        view.repartition(1).where(condition).write.mode("append").parquet(source)
        flow_state.run_flows(spark.readStream.schema(view.schema).parquet(source), out, log, idle="1 second", idle_ms=60_000, sample=3)
    early = {r["canonical_id"]: r for r in flow_stats(view.where("packet_index < 300")).collect()}
    closed = {r["canonical_id"]: r for r in spark.read.parquet(out).where("closed").collect()}
    assert set(closed) == set(early)
    assert all(closed[k]["packet_count"] == early[k]["packet_count"] and closed[k]["last_us"] == early[k]["last_us"] for k in early)
    assert {r["sampled"] for r in closed.values()} <= {1, 2, 3}
    now = fl.with_canonical_id(view.where("packet_index between 300 and 320")).select("canonical_id").distinct().count()
    assert flow_state.open_flows(spark, log).count() == now


def test_the_store_has_to_hold_several_states(spark, tmp_path):
    with pytest.raises(ValueError, match="providerClass"):
        flow_state.run_flows(packet_view(spark, SF), str(tmp_path / "o"), str(tmp_path / "l"))
