"""Running sums within groups of any size: ranges of the sorted rows, with totals carried over their edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from otflow.llm.common import materialize


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal values; nulls equal each other."""
    ends = pc.run_end_encode(column).run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return starts, ends - starts


def _rearranged(batch: pa.RecordBatch, more: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The batch with columns replaced or added."""
    columns = dict(zip(batch.schema.names, batch.columns))
    columns.update({name: pa.array(values) for name, values in more.items()})
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def running_sums(df: DataFrame, by: str, order: list[str], sums: list[str], label: str) -> DataFrame:
    """df with x_before and x_upto for each x of sums: the sum over the rows of the group before this one, and with it.

    by: the group's column, a null being a group; order: columns that order a
    group's rows, nulls first; rows equal in them come in any order. sums: long
    columns without nulls; sums wrap around at 64 bits, as numpy's do.

    df runs twice, as Spark samples it for the ranges; give a written one where
    that costs. Rows are ranged over (by, order), so that a hot group spreads over many
    tasks, and written with sums within each range. The driver then learns one
    row a range, its last group and that group's sums, and a second pass adds
    what earlier ranges hold of a range's first group.
    """
    upto = [f"{x}_upto" for x in sums]
    schema = StructType(df.schema.fields + [StructField(name, LongType()) for name in upto])
    local_schema = StructType([*schema.fields]).add("_range", IntegerType()).add("_row", LongType())

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, row, last, totals = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(by)
            starts, sizes = runs(group)
            goes_on = totals is not None and group[0].as_py() == last
            more = {}
            for k, x in enumerate(sums):
                values = batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64)
                summed = np.cumsum(values)
                summed -= np.repeat(summed[starts] - values[starts], sizes)
                if goes_on:
                    summed[: sizes[0]] += totals[k]
                more[upto[k]] = summed
            last, totals = group[-1].as_py(), [more[u][-1] for u in upto]
            more["_range"] = np.full(batch.num_rows, place, np.int32)
            more["_row"] = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield _rearranged(batch, more)

    keys = [by, *order]
    local = df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(within, local_schema)
    local = materialize(local, label)
    carried = _carried(local, by, upto)
    out_schema = StructType(schema.fields + [StructField(f"{x}_before", LongType()) for x in sums])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, group = batch.column("_range").to_numpy(zero_copy_only=False), batch.column(by)
            more = {u: batch.column(u).to_numpy(zero_copy_only=False).copy() for u in upto}
            for p in np.unique(place):
                if (found := carried.get(int(p))) is None:
                    continue
                same = pc.is_null(group) if found[0] is None else pc.fill_null(pc.equal(group, pa.scalar(found[0], group.type)), False)
                hit = same.to_numpy(zero_copy_only=False) & (place == p)
                for u, total in zip(upto, found[1]):
                    more[u][hit] += np.int64(total)
            for x, u in zip(sums, upto):
                more[f"{x}_before"] = more[u] - batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64)
            yield _rearranged(batch, more).drop_columns(["_range", "_row"])

    summed = local.mapInArrow(across, out_schema)
    summed.written = local
    return summed


def _carried(local: DataFrame, by: str, upto: list[str]) -> dict[int, tuple]:
    """For each range the group that the range before ends with, and its sums up to there: one entry a range."""
    ends = local.groupBy("_range").agg(F.max_by(F.struct(F.col(by).alias("by"), *upto), "_row").alias("end")).collect()
    carried, before = {}, None
    for row in sorted(ends, key=lambda r: r["_range"]):
        if before is not None:
            carried[row["_range"]] = before
        last, totals = row["end"][0], list(row["end"][1:])
        if before is not None and before[0] == last:  # then the whole range is of this group
            totals = [_wrapped(a + b) for a, b in zip(totals, before[1])]
        before = (last, totals)
    return carried


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)
