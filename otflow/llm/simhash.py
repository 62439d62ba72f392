"""SimHash near-dedup with pigeonring filtering.

The bits of a fingerprint form a ring of m segments. Where two fingerprints
differ in at most m - 1 bits, some segment starts a chain whose first l
segments differ in at most floor((m - 1) l / m) bits for every l: none in the
first, one in the first two, two in three, and so on. Candidates are found by
the first two segments at once: a fingerprint stands in the bucket of its own
two and visits those where one set bit of the second is cleared. Longer chains
are then tested, each within its budget, before a pair counts.

Where similarity decides (similar_groups), chains only propose pairs, and the
exact Jaccard similarity of their shingles counts. A chain there is three
segments long: the first has to be equal, and the other two within one
half-byte, which 20-bit keys find.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import give_back, materialize, mix64, release, slices, utf8
from otflow.llm.graph import connected_components

SEED = 42
#: Fingerprints of a bucket that are compared in one piece; larger buckets are dealt out in tiles.
TILE = 4096


@dataclass(frozen=True)
class Settings:
    """shingle: words of a feature; seeds: 64-bit parts of a fingerprint; width: bits of a segment, 8 or 16.

    distinct: repeated features count once; reach: bits in which near_pairs lets the whole ring differ.
    """

    shingle: int = 3
    seeds: int = 1
    width: int = 16
    distinct: bool = False
    reach: int = 0

    @property
    def segments(self) -> int:
        return 64 * self.seeds // self.width

    @property
    def max_bits(self) -> int:
        return self.segments - 1

    def budget(self, length: int) -> int:
        return self.max_bits * length // self.segments


#: 3-word shingles, at most 3 of 64 bits.
CLOSE = Settings()
#: Distinct five-word shingles, at most 112 of 512 bits. At a similarity of 0.8 the cosine of two sets is 0.889 or
#: more however the edits lie, so 78 bits are expected to differ, with a deviation of 8.
CANDIDATES = Settings(shingle=5, seeds=8, width=8, distinct=True, reach=112)
#: Words of 64 bits of a fingerprint by which nearest_pairs tells distances, and bits in which these may differ:
#: 19 are expected at a similarity of 0.8, with a deviation of 4, and 64 of unrelated texts.
SKETCH, SKETCH_REACH = 2, 34


def feature_hashes(text: bytes, settings: Settings) -> np.ndarray:
    """XXH64 of a text's lower-cased word shingles, repeats included; of fewer words that of all of them."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes).tolist()
    ends = ends[settings.shingle - 1 :].tolist() or [len(joined)]
    out = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends)], np.uint64)
    return np.unique(out) if settings.distinct else out


def fingerprint(text: bytes, settings: Settings = CLOSE) -> bytes:
    """The SimHash of a text, big-endian: bits that are set in over half of the features' hashes; 0 without words."""
    return fingerprint_of(feature_hashes(text, settings), settings)


#: The bits of each byte, and whether they are set.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_of(hashes: np.ndarray, settings: Settings) -> bytes:
    """The SimHash of features' hashes: bytes are counted by value, and their bits then."""
    seeds = np.arange(settings.seeds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    places = np.arange(8 * settings.seeds)
    counts = np.zeros(256 * len(places), np.int64)
    for at in range(0, len(hashes), 1 << 13):
        own = hashes[at : at + (1 << 13), None] + seeds
        own[:, 1:] = mix64(own[:, 1:])
        counts += np.bincount((own.view(np.uint8) + 256 * places).ravel(), minlength=len(counts))
    set_bits = (counts.reshape(-1, 256) @ _BITS).reshape(settings.seeds, 64)
    return np.packbits(2 * set_bits > len(hashes), axis=1, bitorder="little")[:, ::-1].tobytes()


def fingerprints(docs: DataFrame, settings: Settings = CLOSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bytes) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = pa.array([fingerprint(t, settings) for t in utf8(batch.column(1))], pa.binary())
            yield pa.record_batch([batch.column(0), fps], names=["doc_id", "fp"])

    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as binary) text")
    return source.mapInArrow(run, "doc_id long, fp binary")


def segments_of(fps: list[bytes], settings: Settings) -> np.ndarray:
    """The segments of fingerprints, one row each."""
    return np.frombuffer(b"".join(fps), ">u2" if settings.width == 16 else "u1").reshape(len(fps), settings.segments)


def bucket_rows(rings: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of buckets, the rows of the fingerprints in them, and whether each stands there or visits."""
    keys, rows, own = [], [], []
    every, width = np.arange(len(rings)), np.uint64(settings.width)
    for start in range(settings.segments):
        first, second = (rings[:, (start + k) % settings.segments].astype(np.uint64) for k in (0, 1))
        key = np.uint64(start) << np.uint64(2 * settings.width) | first << width | second
        keys.append(key)
        rows.append(every)
        own.append(np.ones(len(rings), bool))
        for bit in range(settings.width):
            flag = np.uint64(1 << bit)
            visitor = np.flatnonzero(second & flag)
            keys.append(key[visitor] ^ flag)
            rows.append(visitor)
            own.append(np.zeros(len(visitor), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(own)


def within_chains(a: np.ndarray, b: np.ndarray, start: np.ndarray, settings: Settings) -> np.ndarray:
    """Whether all chains from start keep within their budgets, the whole ring being the last."""
    alive, total = np.arange(len(b)), np.zeros(len(b), np.int64)
    for length in range(1, settings.segments + 1):
        at = (start[alive] + (length - 1)) % settings.segments
        total += np.bitwise_count((a[0, at] if len(a) == 1 else a[alive, at]) ^ b[alive, at])
        good = total <= settings.budget(length)
        alive, total = alive[good], total[good]
    out = np.zeros(len(b), bool)
    out[alive] = True
    return out


def _links(keys: np.ndarray, start: np.ndarray, rings: np.ndarray, own: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key, as pairs of rows, that connect what the buckets connect.

    Small buckets give all their links, a large one a spanning forest.
    """
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edges, len(keys)))
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
    rank = np.arange(len(keys)) - np.repeat(edges, sizes)
    for gap in range(1, min(64, int(sizes.max(initial=1)))):
        at = np.flatnonzero(small & (rank >= gap))
        if not len(at):
            break
        at = at[own[at] | own[at - gap]]
        at = at[within_chains(rings[at], rings[at - gap], start[at], settings)]
        left.append(at)
        right.append(at - gap)
    for at, size in zip(edges[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        f, o, s = rings[at : at + size], own[at : at + size], start[at : at + size]
        group = np.arange(size)
        for i in range(size - 1):
            # Rows that a link already connects need no other.
            maybe = i + 1 + np.flatnonzero((o[i + 1 :] | o[i]) & (group[i + 1 :] != group[i]))
            near = maybe[within_chains(f[i : i + 1], f[maybe], s[maybe], settings)]
            new, first = np.unique(group[near], return_index=True)
            left.append(np.full(len(first), at + i))
            right.append(at + near[first])
            group[np.isin(group, new)] = group[i]
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links that connect what all of them connect; links of small nodes come first, so batches agree on them."""
    if not len(u):
        return u, v
    pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kept = []
    for k, (a, b) in enumerate(pairs.tolist()):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            kept.append(k)
    return pairs[kept, 1], pairs[kept, 0]


def chain_keys(rings: np.ndarray) -> np.ndarray:
    """Keys of the buckets of fingerprints, a row each: for each start four, each without one half-byte of the second and third segment.

    Two fingerprints share a key where a chain's first segment is equal and the
    next two differ in one half-byte only. Keys have 20 bits beside start and
    half-byte, so buckets of a corpus of a thousand million documents hold a
    thousand unrelated ones.
    """
    keys = []
    for start in range(rings.shape[1]):
        first, second, third = (rings[:, (start + k) % rings.shape[1]].astype(np.int64) for k in (0, 1, 2))
        for half in range(4):
            keys.append((start * 4 + half) << 24 | first << 16 | ((second << 8 | third) & ~(15 << 4 * half)))
    return np.stack(keys, 1)


def _ring_rows(fps: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    keys, rows, own = bucket_rows(segments_of(fps, settings), settings)
    return keys.view(np.int64), rows, [own]


def _chain_rows(fps: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    keys = chain_keys(segments_of(fps, settings))
    return keys.T.ravel(), np.tile(np.arange(len(keys)), keys.shape[1]), []


def hot_buckets(distinct: DataFrame, settings: Settings, tile: int, place: Callable = _ring_rows) -> DataFrame:
    """key and n of the buckets of more than tile rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            keys, n = np.unique(place(batch.column(0).to_pylist(), settings)[0], return_counts=True)
            yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "n"])

    counts = distinct.select("fp").mapInArrow(count, "key long, n long")
    hot = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > tile), "hot-buckets")
    release(distinct.sparkSession)
    return hot


def _placed(distinct: DataFrame, settings: Settings, tile: int, hot: DataFrame, place: Callable, *names: str) -> DataFrame:
    """key and tile, beside the named columns of distinct (node and others) and what place adds: rows of buckets, sorted by bucket."""
    more = ", own boolean" if place is _ring_rows else ""
    types = ", ".join(f"{c} {distinct.schema[c].dataType.simpleString()}" for c in names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            keys, rows, own = place(batch.column("fp").to_pylist(), settings)
            columns = [pa.array(keys), *(batch.column(c).take(pa.array(rows)) for c in names), *map(pa.array, own)]
            yield pa.record_batch(columns, names=["key", *names, *["own"] * len(own)])

    rows, tiled = distinct.select("fp", *(c for c in names if c != "fp")).mapInArrow(emit, f"key long, {types}{more}"), []
    if not hot.isEmpty():
        # A hot bucket of b blocks becomes b(b+1)/2 tiles: each pair of blocks meets in one of them.
        tiles = F.expr("transform(sequence(0L, b - 1), y -> least(x, y) * b + greatest(x, y))")
        rows = rows.join(hot, "key", "left").withColumn("b", F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)))
        rows, tiled = rows.withColumn("x", F.expr("pmod(xxhash64(node), b)")).withColumn("tile", F.explode(tiles)).drop("n", "b", "x"), ["tile"]
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", *tiled).sortWithinPartitions("key", *tiled, "node")
    return rows if tiled else rows.withColumn("tile", F.lit(0).cast("long"))


def _by_bucket(placed: DataFrame, linked: Callable[[pa.Table, np.ndarray], tuple], schema: str = "u long, v long") -> DataFrame:
    """What linked finds in tables of whole buckets, given with the number of each row's bucket."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key, place = table["key"].to_numpy(), table["tile"].to_numpy()
            cut = int(np.argmax((key == key[-1]) & (place == place[-1])))  # the last group may go on in the next batch
            rest = table.slice(cut)
            if cut:
                yield found(table.slice(0, cut))
        if rest is not None:
            yield found(rest)
        give_back()

    def found(part: pa.Table) -> pa.RecordBatch:
        key, place = (part[c].to_numpy() for c in ("key", "tile"))
        out = linked(part, np.cumsum(np.append(0, (key[1:] != key[:-1]) | (place[1:] != place[:-1]))))
        return pa.record_batch([pa.array(x) for x in out], names=names)

    names = [column.split()[0] for column in schema.split(", ")]
    return placed.mapInArrow(link, schema)


def near_links(distinct: DataFrame, settings: Settings = CLOSE, tile: int = TILE) -> DataFrame:
    """u, v: links between nodes whose fingerprints (columns node long, fp; distinct) differ in at most max_bits bits.

    All links of a connected group need not be returned, but enough to connect it.
    """

    def linked(part: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, start = part["node"].to_numpy(), part["key"].to_numpy() >> (2 * settings.width)
        left, right = _links(group, start, segments_of(part["fp"].to_pylist(), settings), part["own"].to_numpy(), settings)
        return forest(node[left], node[right])

    distinct = distinct.select("node", "fp")
    hot = hot_buckets(distinct, settings, tile)
    return _by_bucket(_placed(distinct, settings, tile, hot, _ring_rows, "node", "fp"), linked).distinct()


def _pairs(bucket: np.ndarray, words: np.ndarray, reach: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket, but not of one group, whose fingerprints differ in at most reach bits, and in how many.

    Pieces are of bounded size however large a bucket is.
    """

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if group is not None:
            other = group[a] != group[b]
            a, b = a[other], b[other]
        bits = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64)
        good = bits <= reach
        return a[good], b[good], bits[good]

    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(edges, len(bucket)))
    small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
    rank = np.arange(len(bucket)) - np.repeat(edges, sizes)
    for gap in range(1, min(64, int(sizes.max(initial=1)))):
        at = np.flatnonzero(small & (rank >= gap))
        if not len(at):
            break
        yield near(at, at - gap)
    for start, size in zip(edges[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        for i in range(start + 1, start + size):
            yield near(np.full(i - start, i), np.arange(start, i))


def _nearest(pairs: np.ndarray) -> np.ndarray:
    """Of rows (node, other, bits, side) those with the fewest bits, then the smallest other, of each node and side."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 2], pairs[:, 3], pairs[:, 0]))]
    return pairs[np.append(True, (pairs[1:, [0, 3]] != pairs[:-1, [0, 3]]).any(1))] if len(pairs) else pairs


#: Pairs that a task holds before it reduces them.
HELD = 1 << 18
#: Texts of one family whose sets are compared with those of another such block at a time.
BLOCK = 64


def nearest_pairs(distinct: DataFrame, settings: Settings = CANDIDATES, tile: int = TILE, hot: DataFrame | None = None) -> DataFrame:
    """u, v: for each node the nearest other one and the nearest smaller one that share a key of chain_keys.

    distinct has the columns node long and fp; distances are those of the first
    SKETCH words of the fingerprints, and those over SKETCH_REACH don't count.
    There are at most two pairs for each node however dense a family is, and
    one at least where any other shares a key. hot is what hot_buckets gives,
    where it is known already.
    """

    def linked(part: pa.Table, bucket: np.ndarray) -> tuple[np.ndarray, ...]:
        node, words = part["node"].to_numpy(), np.stack([part[c].to_numpy() for c in sketch], 1).view(np.uint64)
        held, n = [np.zeros((0, 4), np.int64)], 0
        for a, b, bits in _pairs(bucket, words, SKETCH_REACH):
            u, v, side = np.maximum(node[a], node[b]), np.minimum(node[a], node[b]), np.zeros(len(a), np.int64)
            held += [np.stack(x, 1) for x in ((u, v, bits, side), (v, u, bits, side), (u, v, bits, side + 1))]
            n += 3 * len(a)
            if n > HELD:
                held, n = [_nearest(np.concatenate(held))], 0
        return tuple(_nearest(np.concatenate(held)).T.copy())

    sketch = [f"w{k}" for k in range(SKETCH)]
    word = lambda k: F.conv(F.hex(F.substring("fp", 8 * k + 1, 8)), 16, -10).cast("long")
    distinct = distinct.select("node", "fp", *(word(k).alias(c) for k, c in enumerate(sketch)))
    hot = hot_buckets(distinct, settings, tile, _chain_rows) if hot is None else hot
    found = _by_bucket(_placed(distinct, settings, tile, hot, _chain_rows, "node", *sketch), linked, "u long, v long, bits long, side long")
    best = found.groupBy("u", "side").agg(F.min(F.struct("bits", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    return best.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_pairs(distinct: DataFrame, settings: Settings = CANDIDATES, tile: int = TILE, hot: DataFrame | None = None) -> DataFrame:
    """All pairs of nodes that share a key of chain_keys, are not of one group and differ in at most reach bits.

    distinct has the columns node, fp, group and block. Returns a, b, us and
    vs: pairs of blocks, and the pairs of their nodes in arrays that correspond,
    so a dense family costs rows for its blocks, not for its pairs. A pair
    comes from the first key that it shares, and from one task only where no
    hot bucket was cut in tiles.
    """

    def linked(part: pa.Table, bucket: np.ndarray) -> tuple:
        node, group, block, key = (part[c].to_numpy() for c in ("node", "group", "block", "key"))
        rings = segments_of(part["fp"].to_pylist(), settings)
        held = [np.zeros((0, 4), np.int64)]
        for a, b, _ in _pairs(bucket, rings.view(np.uint64), settings.reach, group):
            first = key[a] == _first_key(rings, a, b)
            a, b = a[first], b[first]
            swap = block[a] < block[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            held.append(np.stack([block[a], block[b], node[a], node[b]], 1))
        out = np.unique(np.concatenate(held), axis=0)
        starts = np.flatnonzero(np.append(np.ones(min(len(out), 1), bool), (out[1:, :2] != out[:-1, :2]).any(1)))
        offsets = pa.array(np.append(starts, len(out)).astype(np.int32))
        return out[starts, 0], out[starts, 1], *(pa.ListArray.from_arrays(offsets, pa.array(out[:, k])) for k in (2, 3))

    hot = hot_buckets(distinct, settings, tile, _chain_rows) if hot is None else hot
    found = _by_bucket(_placed(distinct, settings, tile, hot, _chain_rows, "node", "fp", "group", "block"), linked, "a long, b long, us array<long>, vs array<long>")
    return found.groupBy("a", "b").agg(F.flatten(F.collect_list("us")).alias("us"), F.flatten(F.collect_list("vs")).alias("vs"))


def _first_key(rings: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first key that the rows a and b share, for each pair of them."""
    out = np.full(len(a), -1, np.int64)
    todo, segments = np.arange(len(a)), rings.shape[1]
    for start in range(segments):
        if not len(todo):
            break
        mine, theirs = rings[a[todo]], rings[b[todo]]
        first, second, third = ((start + k) % segments for k in (0, 1, 2))
        apart = (mine[:, second] ^ theirs[:, second]).astype(np.int64) << 8 | (mine[:, third] ^ theirs[:, third])
        for half in range(4):
            hit = np.flatnonzero((out[todo] < 0) & (mine[:, first] == theirs[:, first]) & (apart & ~(15 << 4 * half) == 0))
            own = mine[hit].astype(np.int64)
            out[todo[hit]] = (start * 4 + half) << 24 | own[:, first] << 16 | ((own[:, second] << 8 | own[:, third]) & ~(15 << 4 * half))
        todo = todo[out[todo] < 0]
    return out


def near_groups(docs: DataFrame, settings: Settings = CLOSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most
    max_bits differing bits, the own one included. Null and empty texts have
    fingerprint zero, linked like any other. Repeated rows stay; a null doc_id
    takes part and gives its component no id. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, settings, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct, "distinct-fingerprints")
    roots = connected_components(near_links(distinct, settings)).withColumnRenamed("node", "_node")
    members = distinct.join(roots, distinct["node"] == roots["_node"], "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    members = materialize(members, "near-groups")
    # Written, so that the join has both sides dealt for itself and a large component may be split.
    least = materialize(members.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    component = members.join(least, "root").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("binary"))


def _texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct five-word shingles."""
    return feature_hashes(text, CANDIDATES)


def confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: those of the pairs of nodes whose five-word shingles have a Jaccard similarity of 0.8 or more.

    pairs are those of near_pairs; nodes has node, block and the digest and one
    text_key of its texts. Whole sets are compared, a block's with another's,
    so a set is read once for each pair of blocks; only texts of ends are read.
    """
    from xxhash import xxh3_128_digest

    ends = pairs.select("us", "vs").mapInArrow(_ends, "node long").distinct()
    wanted = materialize(nodes.join(ends, "node").select("node", "block", "digest", "text_key"), "similar-ends")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            own = [shingles(t) for t in utf8(batch.column(3))]
            good = [k for k, (h, d) in enumerate(zip(own, batch.column(2).to_pylist())) if xxh3_128_digest(h.tobytes()) == d]
            rest = batch.select([0, 1]).take(pa.array(good, pa.int64()))
            yield pa.record_batch([*rest.columns, pa.array([own[k].tobytes() for k in good], pa.binary())], names=["node", "block", "hashes"])

    held = texts.join(wanted.hint("merge"), "text_key").select("node", "block", "digest", "text").mapInArrow(sets, "node long, block long, hashes binary")
    held = held.groupBy("block", "node").agg(F.min("hashes").alias("hashes")).groupBy("block").agg(F.collect_list(F.struct("node", "hashes")).alias("sets"))
    held = materialize(held, "shingles")
    release(texts.sparkSession)
    a, b = (held.select(F.col("block").alias(end), F.col("sets").alias(f"{end}_sets")).hint("merge") for end in ("a", "b"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            good = []
            for us, vs, *both in zip(*(batch.column(k) for k in range(4))):
                own = {n: np.frombuffer(h, np.uint64) for part in both for n, h in zip(part.values.field(0).to_pylist(), part.values.field(1).to_pylist())}
                for u, v in zip(us.as_py(), vs.as_py()):
                    x, y = own[u], own[v]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 5 * common >= 4 * (len(x) + len(y) - common):
                        good.append((u, v))
            yield pa.record_batch([pa.array([p[k] for p in good], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return pairs.join(a, "a").join(b, "b").select("us", "vs", "a_sets", "b_sets").mapInArrow(similar, "u long, v long")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct nodes of a batch's pairs."""
    for batch in slices(batches, 1000):
        yield pa.record_batch([pa.array(np.unique(np.concatenate([batch.column(k).flatten().to_numpy() for k in (0, 1)])))], names=["node"])


def with_roots(nodes: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """nodes with the root of each one's component, or the node itself, as a column of that name."""
    roots = roots.withColumnRenamed("node", "_node")
    return nodes.join(roots, nodes["node"] == roots["_node"], "left").withColumn(name, F.coalesce("root", "node")).drop("_node", "root")


def similar_groups(docs: DataFrame, settings: Settings = CANDIDATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key (a hash of its text), component_id, kept.

    Components are those of pairs that near_pairs proposes and whose five-word
    shingles have a Jaccard similarity of 0.8 or more; texts of equal shingles
    are one node. component_id is the smallest doc_id of a component, whose row
    is kept, of several texts of it the one with the smallest text_key; rows
    that repeat doc_id and text tie, and those without a doc_id are kept. A first
    round tries each text's nearest ones, which connects most of a dense family;
    a second one tries all pairs that are still apart.
    """
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingles(t) for t in utf8(batch.column(2))]
            digests = pa.array([xxh3_128_digest(h.tobytes()) for h in own], pa.binary())
            yield pa.record_batch([*batch.columns[:2], digests, pa.array([fingerprint_of(h, settings) for h in own], pa.binary())], names=["doc_id", "text_key", "digest", "fp"])

    texts = _texts(docs, id_col, text_col)
    prints = materialize(texts.mapInArrow(run, "doc_id long, text_key long, digest binary, fp binary"), "fingerprints")
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))
    nodes = prints.groupBy("digest").agg(F.min("fp").alias("fp"), F.min("text_key").alias("text_key"), F.min(row).alias("least"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-shingles")
    hot = hot_buckets(nodes, settings, TILE, _chain_rows)
    first = materialize(nearest_pairs(nodes, settings, hot=hot), "nearest-pairs")
    release(docs.sparkSession)
    # A text that has no nearest one shares no key with another, and needs no more.
    families = materialize(connected_components(first).select("node", F.col("root").alias("family")), "families")
    # Written, so that the join has both sides dealt for itself and a large family may be split.
    sizes = materialize(families.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")), "family-sizes")
    blocks = families.join(sizes, "family").select("node", F.xxhash64("family", F.expr("pmod(xxhash64(node), n)")).alias("block"))
    blocks = materialize(nodes.join(blocks, "node"), "blocks")
    of = lambda end, name: blocks.select(F.col("node").alias(end), F.col("block").alias(name))
    first = first.join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b", F.array("u").alias("us"), F.array("v").alias("vs"))
    links = materialize(confirm(materialize(first, "packed-pairs"), blocks, texts), "similar-pairs")
    grouped = materialize(with_roots(blocks, connected_components(links), "group"), "similar-groups")
    rest = materialize(near_pairs(grouped, settings, hot=hot), "similar-candidates")
    release(docs.sparkSession)
    links = materialize(links.unionByName(confirm(rest, blocks, texts)), "similar-pairs")
    release(docs.sparkSession)
    grouped = materialize(with_roots(nodes, connected_components(links), "group"), "similar-groups")
    members = grouped.select("digest", "least", "group")
    least = materialize(members.groupBy("group").agg(F.min("least").alias("best")), "component-ids")
    component = members.join(least, "group").select("digest", "best")
    kept = F.coalesce(row == F.col("best"), F.lit(True))
    return prints.join(component, "digest").select("doc_id", "text_key", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, settings: Settings = CANDIDATES) -> DataFrame:
    """The rows of docs that stay: of each component of similar_groups the one with the smallest doc_id, all columns as they were.

    Rows are matched by doc_id and text. Those without a doc_id can't be told apart and stay.
    """
    dropped = similar_groups(docs, settings).where("not kept").select(F.col("doc_id").alias("_dropped"), F.col("text_key").alias("_text_key"))
    cond = (docs["doc_id"].cast("long") == dropped["_dropped"]) & (_text_key("text") == dropped["_text_key"])
    return docs.join(dropped.hint("merge"), cond, "left_anti")
