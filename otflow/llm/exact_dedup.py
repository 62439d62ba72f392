"""Exact dedup by distributed most-significant-digit radix partitioning.

Documents are split by successive byte strings of their normalised text (its
length, then bytes 0..64, 64..1K, 1K..16K, ...) until a group is a single
document or its text has ended. Groups whose bytes have all been compared are
equal by comparison; no digest takes part in the decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import materialize, release

#: Ends of the digits, in bytes of normalised text. Beyond the last they grow 16-fold.
DIGIT_ENDS = (64, 1 << 10)

WHITE = " \t\n\x0b\f\r"


def normalise(text: Column) -> Column:
    """Text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points before normalisation stays,
    then the smallest doc_id (a null one comes last), then of rows that repeat
    both the first of the table, so that one row of a group is kept. keep_id is
    null where that row has no doc_id. Null texts equal empty ones. An empty
    table gives an empty result. Only the two named columns are read, so
    further columns don't matter. docs has to read alike each time, as tables do.

    A hot group never meets in one task: groups are found by partially
    aggregated counts, and rows rejoin them by a join that AQE may split.
    """
    return _groups(docs.withColumn(ROW, F.monotonically_increasing_id()), id_col, text_col).drop("row")


#: The column that tells apart rows which repeat each other.
ROW = "_row of the table"


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """exact_groups of docs with the column ROW, and that as row."""
    norm = normalise(F.col(text_col))
    active = docs.select(
        F.col(ROW).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(F.coalesce(text_col, F.lit(""))).alias("n"),
        F.encode(norm, "UTF-8").alias("rest"),
    ).select(
        "row",
        "doc_id",
        "n",
        F.sha2("rest", 256).alias("text_sha256"),
        F.octet_length("rest").cast("long").alias("gid"),  # the first digit: the length
        F.octet_length("rest").alias("left"),
        "rest",
    )
    done, depth, ends = [], 0, list(DIGIT_ENDS)
    while True:
        if depth == len(ends):
            ends.append(ends[-1] * 16)
        width = ends[depth] - (ends[depth - 1] if depth else 0)
        digit = F.substring("rest", 1, width)
        groups = (
            active.groupBy("gid", digit.alias("digit"))
            .agg(F.count(F.lit(1)).alias("size"), F.max(_rank()).alias("best"))
            .where("size > 1")
            .select("gid", "digit", "size", "best")
        )
        groups = materialize(groups, f"radix-groups{depth}").withColumn("next", F.monotonically_increasing_id())
        split = (
            active.withColumn("digit", digit)
            .join(groups.hint("merge"), ["gid", "digit"], "left")
            .select(
                "row",
                "doc_id",
                "n",
                "text_sha256",
                F.coalesce("size", F.lit(1)).alias("size"),
                "best",
                F.coalesce("next", F.lit(-1)).alias("gid"),
                (F.col("left") - width).alias("left"),
                # a single document needs its bytes no longer
                F.when(F.col("size") > 1, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            )
        )
        split = materialize(split, f"radix{depth}")
        release(docs.sparkSession)
        ended = (F.col("size") == 1) | (F.col("left") <= 0)
        done.append(split.where(ended).drop("rest"))
        active = split.where(~ended).select("row", "doc_id", "n", "text_sha256", "gid", "left", "rest")
        depth += 1
        if active.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    best = F.coalesce("best", _rank())
    return out.select(
        "row",
        "doc_id",
        (-best["neg_id"]).alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (best.eqNullSafe(_rank())).alias("kept"),
        "text_sha256",
    )


def _rank() -> Column:
    """Most code points, then the smallest doc_id, then the first row; null ids come last."""
    return F.struct(F.col("n").alias("n"), (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, one of each group, all columns as they were.

    docs has to read alike each time, as tables do: rows are told apart by their place.
    """
    placed = docs.withColumn(ROW, F.monotonically_increasing_id())
    dropped = _groups(placed, id_col, text_col).where("not kept").select(F.col("row").alias(ROW))
    return placed.join(dropped.hint("merge"), ROW, "left_anti").select(*(docs[c] for c in docs.columns))
