"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words. A document's expected copies are its
source's target over the source's size; they are summed up within the source,
one random offset is added, and a document is taken once for each integer that
its part of the sum crosses. Sums are integers, so nothing drifts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from otflow.llm.common import discard, give_back, materialize, slices, utf8
from otflow.llm.running import running_sums

#: Weights of the sources in order, repeating, and how often a document may be taken at most.
WEIGHTS, LIMIT = (1, 2, 3), 3
#: Expected copies are counted in units of 2 to the power of -40.
UNIT = 40
SEED = "mix"


def sized(docs: DataFrame, keep: list[str], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, the columns of keep, and size: the text's words [^\\x20\\x09-\\x0D]+; null has none."""
    kept = docs.select(F.col(source_col).cast("string").alias("source"), *(F.col(c).alias(f"kept_{c}") for c in keep), F.col(text_col).cast("string").alias("_text"))
    schema = StructType(kept.schema.fields[:-1]).add("size", LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = pa.array([len(t.split()) for t in utf8(batch.column("_text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], words], [*batch.schema.names[:-1], "size"])
        give_back()

    return kept.mapInArrow(count, schema)


def _exact(x: Column | int) -> Column:
    return (F.lit(Decimal(x)) if isinstance(x, int) else x).cast("decimal(38,0)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """source, source_size, target (double), copies (of a document, in units of 2**-40) and offset, as a written table.

    sizes: source and source_size, one row each. Sources in order of code
    points, null last, take the weights in turn and share the whole by them.
    A target stops at limit times its source's size, and what is beyond goes to
    the others by weight, until none is above.

    The stop is found by one running sum instead of rounds: in order of size
    over weight, a source stops if those before it stop and all further ones,
    at its level, would not use up the whole. All comparisons are exact.
    """
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(0).alias("all"), F.lit(1).cast("long").alias("one"))
    ranked = running_sums(named, "all", ["last", "source"], ["one"], "mix-ranks")
    turn = F.array(*(F.lit(w).cast("long") for w in weights))[((F.col("one_before")) % len(weights)).cast("int")]
    common = math.lcm(*weights)
    weighed = ranked.select("source", "source_size", "last", "all", turn.alias("weight"), (F.col("source_size") * limit).alias("most"))
    weighed = weighed.withColumn("level", F.col("source_size") * F.expr(f"{common} div weight"))
    summed = materialize(running_sums(weighed, "all", ["level", "last", "source"], ["most", "weight"], "mix-levels"), "mix-sources")
    whole, heft = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    used = _exact(F.col("weight")) * _exact(F.col("most_before")) + _exact(F.col("most")) * (_exact(heft) - _exact(F.col("weight_before")))
    stops = used <= _exact(F.col("weight")) * _exact(whole)
    taken, gone = summed.where(stops).agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, left = whole - taken, max(heft - gone, 1)
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(left))
    unit = _exact(1 << UNIT)
    copies = F.call_function("div", _exact(F.col("weight")) * _exact(rest) * unit, _exact(left) * _exact(F.col("source_size")))
    # Ten hexadecimal digits are 40 bits.
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.when(F.col("last"), "").otherwise(F.concat(F.lit("="), "source"))), 256), 1, 10), 16, 10).cast("long")
    return materialize(
        summed.select(
            "source",
            "source_size",
            F.when(stops, F.col("most").cast("double")).otherwise(share).alias("target"),
            F.when(F.col("source_size") == 0, 0).when(stops, limit << UNIT).otherwise(copies).cast("long").alias("copies"),
            offset.alias("offset"),
        ),
        "mix-targets",
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for each document.

    copies says how often the mix takes the document (limit at most), taken how
    many words that is. Documents are sampled in order of size, then of doc_id,
    null first: so a source's words miss its target by no more than its longest
    document has. The same rows, weights and seed give the same mix, whatever
    the files and splits.

    Null and empty texts have size 0. A null source is a source, the last one;
    an empty name is another. Rows that repeat each other are documents each.
    An empty table gives no rows; a source without words has target 0. Other
    columns are not read.

    Every document's row is ranged and sorted once, without its text; a hot
    source spreads over ranges.
    """
    found = _sampled(docs, ["doc_id"], ["doc_id"], weights, limit, seed)
    return found.select(F.col("kept_doc_id").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of docs, all columns as they were, each as often as mix takes it.

    Of rows with one size and doc_id the text decides the order.
    """
    found = _sampled(docs, docs.columns, ["doc_id", "text"], weights, limit, seed)
    whole = F.struct(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))
    return found.select(F.explode(F.array_repeat(whole, F.col("copies").cast("int"))).alias("_row")).select("_row.*")


def _sampled(docs: DataFrame, keep: list[str], order: list[str], weights: tuple[int, ...], limit: int, seed: str) -> DataFrame:
    """The columns of keep under the prefix kept_, size, source_size, target and copies."""
    rows = materialize(sized(docs, keep), "mix-sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit, seed)
    aims = aims.select(F.col("source").alias("_source"), "source_size", "target", "copies", "offset")
    aimed = rows.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    summed = running_sums(aimed, "source", ["size", *(f"kept_{c}" for c in order)], ["copies"], "mix-order")
    discard(rows)
    # Sums wrap at 64 bits, of which the lower 62 leave room for the offset.
    crossed = lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit((1 << 62) - 1)) + F.col("offset"), UNIT)
    times = (crossed("copies_upto") - crossed("copies_before")).bitwiseAND(F.lit((1 << (62 - UNIT)) - 1))
    return summed.select(*(f"kept_{c}" for c in keep), "size", "source_size", "target", times.alias("copies"))
