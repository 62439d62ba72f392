"""Prefix trie of conversations: what sharing of common first turns saves, rolled up by pointer jumping.

A conversation's first d turns are a node of depth d. Nodes are keyed by digests
that are sums over (place, turn), so that a conversation of any length is keyed
by running sums over ranges, not in one task. Each node points at its parent;
in each round it hands its totals to the node that its pointer reaches and
doubles the pointer, so a trie of depth d takes log2(d) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import discard, give_back, materialize, utf8
from otflow.llm.running import running_sums, runs

#: Conversations that share the head of the first of them, and how many turns that may be.
FAMILY, MAX_HEAD = 20, 3


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text_digest (16 bytes of SHA-256), words and one; texts don't move any further."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            digests = pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary())
            words = pa.array([len(t.split()) for t in texts], pa.int64())
            kept = [batch.column(c) for c in ("conv", "turn", "role")]
            yield pa.RecordBatch.from_arrays([*kept, digests, words], ["conv", "turn", "role", "text_digest", "words"])
        give_back()

    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(digest, "conv long, turn long, role string, text_digest binary, words long").withColumn("one", F.lit(1).cast("long"))


def head_of(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family: crc32 of its decimal number, modulo 4."""
    return (F.crc32(conv.cast("string")) % (MAX_HEAD + 1)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv, length), and their turns (conv, place, role, text_digest, words, ends).

    A conversation c starts with the first h turns of c - c % 20, if there, and
    goes on with its own after the first h. ends tells its last turn.
    """
    told = materialize(turns_of(conversations), "trie-told")
    ranked = running_sums(told, "conv", ["turn", "role", "text_digest"], ["one"], "trie-turns")
    placed = materialize(ranked.select("conv", F.col("one_upto").alias("p"), "role", "text_digest", "words"), "trie-places")
    discard(told)
    discard(ranked.written)
    turn = F.struct("p", "role", "text_digest", "words")
    first = (F.col("conv") % FAMILY == 0) & (F.col("p") <= MAX_HEAD)
    # Places are unique, so no list has more than MAX_HEAD turns.
    heads = placed.where(first).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    sizes = placed.groupBy("conv").agg(F.max("p").alias("n")).withColumn("h", head_of(F.col("conv")))
    convs = sizes.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(heads, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    convs = convs.withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
    convs = materialize(convs.select("conv", "h", "k", "length", "head"), "trie-conversations")
    own = placed.join(convs.select("conv", "h", "k", "length"), "conv").where("p > h").withColumn("place", F.col("p") - F.col("h") + F.col("k"))
    lent = convs.where("k > 0").select("conv", "length", F.explode(F.slice("head", F.lit(1), F.col("k").cast("int"))).alias("t"))
    lent = lent.select("conv", "length", F.col("t.p").alias("place"), "t.role", "t.text_digest", "t.words")
    turns = own.select(*lent.columns).unionByName(lent)
    return convs.select("conv", "length"), turns.select("conv", "place", "role", "text_digest", "words", (F.col("place") == F.col("length")).alias("ends"))


def members(turns: DataFrame) -> DataFrame:
    """conv, depth, words, ends, and the keys (k1, k2) of the prefix and (p1, p2) of its parent, as a written table.

    A key is the sum over the prefix's turns of a 128-bit hash of place and
    turn: equal for equal sequences; two different ones meet by chance only, of
    2 to the power of -128 a pair.
    """
    element = lambda seed: F.xxhash64(F.lit(seed), "place", "role", "text_digest")
    rows = turns.select("conv", "place", "words", "ends", element(1).alias("a"), element(2).alias("b"))
    rows = materialize(rows, "trie-turns")
    summed = running_sums(rows, "conv", ["place"], ["a", "b"], "trie-keys")
    keyed = summed.select(
        "conv", F.col("place").alias("depth"), "words", "ends",
        F.col("a_upto").alias("k1"), F.col("b_upto").alias("k2"), F.col("a_before").alias("p1"), F.col("b_before").alias("p2"),
    )
    written = materialize(keyed, "trie-members")
    discard(rows)
    discard(summed.written)
    return written


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256: SHA-256 of the ascending conv of each key, comma-joined.

    ends: depth, k1, k2, conv. Ids are ranged and sorted, and each batch joins
    its own to a text, so the task that digests a hot node reads a row for
    thousands of ids, and holds one at a time.
    """
    key = ["depth", "k1", "k2"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            convs = batch.column("conv").to_pylist()
            whole = pa.StructArray.from_arrays([batch.column(c) for c in key], key)
            ids = list(map(tuple, (r.values() for r in whole.to_pylist())))
            starts = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1])]
            texts = [",".join(map(str, convs[a:z])) for a, z in zip(starts, [*starts[1:], len(ids)])]
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in key), batch.column("conv").take(at), pa.array(texts)], [*key, "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                here = (row["depth"], row["k1"], row["k2"])
                if here != last:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
            if done:
                yield _batch(done)
        if last is not None:
            yield _batch([(*last, state.hexdigest())])

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        d, a, b, s = zip(*done)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], [*key, "ends_sha256"])

    pieces = ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(joined, "depth long, k1 long, k2 long, first long, ids string")
    pieces = materialize(pieces, "trie-ends")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digested, "depth long, k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """conv_id, depth and values, each summed over the node's subtree, its top included.

    nodes: conv_id and depth that name a node, parent_conv_id (null at the top;
    its depth is one less) and values. After k rounds a node holds its
    descendants' values up to 2**k levels down, and points 2**k levels up.
    """
    state = materialize(nodes.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), *values), "trie-rollup")
    deepest = state.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        target = [F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")]
        sent = state.where("up is not null").groupBy(*target).agg(*(F.sum(v).alias(f"{v}_sent") for v in values))
        beyond = state.where("up is not null").select(F.col("conv_id").alias("up"), (F.col("depth") + reach).alias("depth"), F.col("up").alias("next"))
        summed = state.join(sent, ["conv_id", "depth"], "left").select("conv_id", "depth", "up", *((F.col(v) + F.coalesce(f"{v}_sent", F.lit(0))).alias(v) for v in values))
        # Below twice the reach nothing is left to point at, so only the others look up where their target points.
        far = summed.where(F.col("depth") >= 2 * reach).join(beyond, ["up", "depth"]).select("conv_id", "depth", F.col("next").alias("up"), *values)
        near = summed.where(F.col("depth") < 2 * reach).withColumn("up", F.lit(None).cast("long"))
        before, state = state, materialize(far.unionByName(near), "trie-rollup")
        discard(before)
        reach *= 2
    return state.select("conv_id", "depth", *values)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    Returns conv_id (the smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256: a node
    is a distinct sequence of first turns, its members are the conversations
    that start with it, its leaves the childless nodes under it, and it saves
    its last turn's words for each member but one.

    Turns are ordered by turn, null first; of equal ones by role, then by the
    SHA-256 of the text; rows that repeat each other are turns each. Null roles
    and texts are empty ones. Rows of a null conv_id belong to no conversation
    and are left out. Conversations that are left without turns end at the
    root. An empty table has no root. Further columns are not read.
    """
    convs, turns = rebuilt(conversations)
    rows = members(turns)
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    key = ["depth", "k1", "k2"]
    found = rows.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    found = materialize(found, "trie-nodes")
    top = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("parent_conv_id"))
    least = root.first()
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # The root is everyone's: its children need no join.
    first = found.where("depth = 1").drop("p1", "p2").withColumn("parent_conv_id", F.lit(least and least["conv_id"]).cast("long"))
    deeper = found.where("depth > 1").join(parents, ["depth", "p1", "p2"]).drop("p1", "p2")
    edges = materialize(top.unionByName(first).unionByName(deeper), "trie-edges")
    children = edges.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = edges.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialize(nodes, "trie-children")
    valued = nodes.select("conv_id", "depth", "parent_conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    totals = rolled_up(valued, ["n_leaves", "saved_tokens"])
    ends = rows.where("ends").select(*key, "conv").unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv"))
    named = nodes.join(ends_digests(ends), key, "left").join(totals, ["conv_id", "depth"])
    none = hashlib.sha256(b"").hexdigest()
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
