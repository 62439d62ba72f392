"""Joins of time spans that cost rows in proportion to both sides, however many of them overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins are 2**BIN microseconds (67 s) wide; of 2**LEVELS bins (71 years) each block is a node of its own, with all halves under it.
BIN, LEVELS = 26, 25


def _down(x: Column, by: Column) -> Column:
    """x by levels up: halved as often, rounded down."""
    return F.call_function("shiftright", x, by)


def _bin(at: Column) -> Column:
    return F.shiftright(at, BIN)


def _nodes(first: Column, last: Column) -> Column:
    """The fewest nodes (level, n) that cover the bins first to last, and no others; at most two a level under the highest."""
    low = lambda k: _down(first + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    high = lambda k: _down(last + 1, k) - 1
    node = lambda k, n: F.struct(k.alias("level"), n.alias("n"))

    def of(k: Column) -> Column:
        left = F.when((low(k) <= high(k)) & (low(k) % 2 != 0), node(k, low(k)))
        right = F.when((low(k) <= high(k)) & (high(k) % 2 == 0), node(k, high(k)))
        return F.array_compact(F.array(left, right))

    below = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of))
    top = F.lit(LEVELS)
    above = F.when(low(top) <= high(top), F.transform(F.sequence(low(top), high(top)), lambda n: node(top, n)))
    return F.array_distinct(F.concat(below, F.coalesce(above, F.array().cast("array<struct<level:int,n:bigint>>"))))


def _ancestors(bin_: Column) -> Column:
    """The nodes of all levels that hold a bin."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), _down(bin_, k).alias("n")))


def _whole(begin: Column, end: Column) -> Column:
    """The nodes of the bins that lie in a span as a whole."""
    first, last = _bin(begin + (1 << BIN) - 1), _bin(end + 1) - 1
    return F.when(first <= last, _nodes(first, last)).otherwise(F.array().cast("array<struct<level:int,n:bigint>>"))


def _edges(begin: Column, end: Column) -> Column:
    return F.array_distinct(F.array(_bin(begin), _bin(end)))


def first_overlaps(spans: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """id and seq: for each span the smallest seq of a window with its key that it overlaps, ends included.

    spans: id, begin, end (microseconds) and the key's columns; windows: seq,
    begin, end and the same. Rows with a null there, and those that end before
    they begin, overlap nothing.

    A span and a window overlap if the span begins in the window or the window
    in the span. Both are looked up by nodes of a binary tree over bins of
    time, each of which holds one seq per key, so a hot key costs some rows a
    span and a window, not one a pair. Only the bins in which a span or window
    begins or ends are compared row by row.
    """
    whole = lambda df, name: df.select(name, "begin", "end", *key).where("begin <= end").dropna()
    spans, windows = whole(spans, "id"), whole(windows, "seq")
    begin, end = F.col("begin"), F.col("end")
    at = [*key, "level", "n"]
    node = lambda df, nodes, *columns: df.select(*columns, *key, F.explode(nodes).alias("node")).select(*columns, *key, "node.level", "node.n")

    cover = node(windows, _whole(begin, end), "seq").groupBy(*at).agg(F.min("seq").alias("seq"))
    starts = node(windows, _ancestors(_bin(begin)), "seq").groupBy(*at).agg(F.min("seq").alias("seq"))
    inside = node(spans, _ancestors(_bin(begin)), "id").join(cover, at)
    around = node(spans, _whole(begin, end), "id").join(starts, at)

    # The bins of the edges: a window's against a span's begin, and a window's begin against a span's edges.
    edged = windows.select("seq", F.col("begin").alias("wb"), F.col("end").alias("we"), *key, F.explode(_edges(begin, end)).alias("n"))
    near = spans.select("id", "begin", *key, _bin(begin).alias("n")).join(edged, [*key, "n"]).where("wb <= begin and begin <= we")
    begun = windows.select("seq", F.col("begin").alias("wb"), *key, _bin(begin).alias("n"))
    met = spans.select("id", "begin", "end", *key, F.explode(_edges(begin, end)).alias("n")).join(begun, [*key, "n"]).where("begin <= wb and wb <= end")
    found = inside.select("id", "seq")
    for more in (around, near, met):
        found = found.unionByName(more.select("id", "seq"))
    return found.groupBy("id").agg(F.min("seq").alias("seq"))
