"""URL filter: host and path rules, then a ratio of character language models.

Two variable-order Markov models over the characters of host and path, one of
accepted and one of rejected URLs, are interpolated from order 0 up. A URL is
blocked where the length-normalised difference of its log-likelihoods passes a
threshold that is calibrated on held-out URLs. The examples are the URLs that a
rule decides; the models carry their verdicts over to the others.

Counts are exact and stay in a table that grows with the input. URLs are packed
into batches, and each batch is joined with the counts of the grams it holds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otflow.llm.common import materialize, mix64, slices, utf8

#: Fixed values of the query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

ORDER = 4
BACKOFF = 4.0
#: URLs and bytes of a batch that is scored at a time; a longer URL is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 18
#: Width of the score bins on which the threshold is calibrated, and their range.
BIN, REACH = 0.002, 10.0
#: One in so many examples is held out for calibration.
HELD = 5


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or no '://'."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host/path text and its verdict, or nulls; of equally long ones a block wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Owner of each character (an end mark included), and for each order the hashes of context and of context with character."""
    pad = b"\0" * ORDER
    data = np.frombuffer(pad + b"".join(t + b"\x01" + pad for t in texts), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) + ORDER * (owner + 1)
    context, contexts, pairs = np.zeros(len(at), np.uint64), [], []
    for k in range(ORDER + 1):
        if k:
            context = mix64(context * np.uint64(257) + data[at - k] + np.uint64(k))
        contexts.append(mix64(context).view(np.int64))
        pairs.append(mix64(context * np.uint64(65537) + data[at] + np.uint64(1 << 32)).view(np.int64))
    return owner, contexts, pairs


def differences(texts: list[bytes], known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log p(rejected) - log p(accepted) per character of each text; 0 for empty texts.

    known: sorted hashes of grams; counts: how often accepted and rejected
    examples have them (two rows). Grams that are not known have the count 0.
    """
    if not texts:
        return np.zeros(0)
    owner, contexts, pairs = grams(texts)

    def looked_up(hashes: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros((2, len(hashes)))
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, counts[:, at], 0)

    p = np.full((2, len(owner)), 1 / 256)
    for c, g in zip(contexts, pairs):
        p = (looked_up(g) + BACKOFF * p) / (looked_up(c) + BACKOFF)
    log = np.log(p)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    out = np.bincount(owner, log[1] - log[0], len(texts)) / sizes
    out[sizes == 1] = 0
    return out


@dataclass(frozen=True)
class Model:
    """counts: a written table of gram, accepted and rejected, as many rows as grams; the threshold of the difference."""

    counts: DataFrame
    threshold: float = float("inf")


def by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Whether a URL is a rejected example; null for those that no rule decides."""
    return rule_for(host, path, rules)[1] == "block"


def _examples(pages: DataFrame, rejected: Column | None) -> DataFrame:
    """text, kind (0 accepted, 1 rejected) and held of the examples among pages."""
    host, path = host_path(F.col("url"))
    text = F.concat(host, path)
    kind = (by_rules(host, path) if rejected is None else rejected).cast("int")
    urls = pages.select(text.alias("text"), kind.alias("kind"), (F.pmod(F.xxhash64(text), F.lit(HELD)) == 0).alias("held"))
    return urls.where("kind is not null and text <> ''")


def fit(pages: DataFrame, rejected: Column | None = None) -> Model:
    """Count the grams of all examples but a held-out fifth, on which the threshold is calibrated.

    rejected: a boolean column of pages; true and false mark examples of both
    classes, null none. By default the rules' verdicts. Null and empty URLs are
    no examples, repeated rows count each, and where one class has no held-out
    example no URL passes the threshold.
    """
    examples = _examples(pages, rejected)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            texts, kind = utf8(batch.column(0)), batch.column(1).to_numpy()
            for at in range(0, len(texts), 500):
                owner, contexts, pairs = grams(texts[at : at + 500])
                found, place = np.unique(np.concatenate(contexts + pairs), return_inverse=True)
                kinds = np.tile(kind[at : at + 500][owner], 2 * (ORDER + 1))
                n = np.bincount(place * 2 + kinds, minlength=2 * len(found)).reshape(-1, 2)
                yield pa.record_batch([pa.array(found), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["gram", "accepted", "rejected"])

    rows = examples.where("not held").select("text", "kind").mapInArrow(count, "gram long, accepted long, rejected long")
    counts = materialize(rows.groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")), "url-grams")
    held = scores(examples.where("held").select("text", "kind"), counts, "kind")
    return Model(counts, _threshold(held))


def scores(urls: DataFrame, counts: DataFrame, *names: str) -> DataFrame:
    """The named columns of urls, and score: the difference of the text's log-likelihoods.

    URLs are packed into batches of bounded size; a batch meets the counts of
    its distinct grams only.
    """
    schema = urls.select(*names).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            texts = utf8(batch.column(0))
            ends = np.cumsum([len(t) for t in texts]) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                _, contexts, pairs = grams(texts[a:b])
                rows = [dict(zip(("text", *names), row)) for row in zip(texts[a:b], *(batch.column(k + 1).slice(a, b - a).to_pylist() for k in range(len(names))))]
                listed = pa.array([rows], pa.list_(pa.struct([("text", pa.binary()), *((n, batch.schema.field(k + 1).type) for k, n in enumerate(names))])))
                yield pa.record_batch([listed, pa.array([np.unique(np.concatenate(contexts + pairs))], pa.list_(pa.int64()))], names=["rows", "grams"])

    fields = f"struct<text: binary, {', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in schema)}>"
    packed = urls.select("text", *names).mapInArrow(pack, f"rows array<{fields}>, grams array<long>")
    packed = materialize(packed.withColumn("batch", F.monotonically_increasing_id()), "url-batches")
    met = packed.select("batch", F.explode("grams").alias("gram")).join(counts, "gram").groupBy("batch").agg(F.collect_list(F.struct("gram", "accepted", "rejected")).alias("known"))
    joined = packed.select("batch", "rows").join(met, "batch", "left").select("rows", "known")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, known in zip(batch.column(0), batch.column(1)):
                order, counted = np.zeros(0, np.int64), np.zeros((2, 0))
                if known.is_valid:
                    columns = [known.values.field(k).to_numpy() for k in range(3)]
                    place = np.argsort(columns[0])
                    order, counted = columns[0][place], np.stack(columns[1:])[:, place]
                values = rows.values
                found = differences(utf8(values.field(0)), order, counted)
                yield pa.record_batch([*(values.field(k + 1) for k in range(len(names))), pa.array(found)], names=[*names, "score"])

    return joined.mapInArrow(score, f"{ddl}, score double")


def _threshold(held: DataFrame) -> float:
    """The threshold that best parts both kinds; in the middle where several do. At most two counts a bin reach the driver."""
    bin_ = F.floor(F.greatest(F.least("score", F.lit(REACH)), F.lit(-REACH)) / BIN).cast("long")
    edge = round(REACH / BIN)
    counts = np.zeros((2, 2 * edge + 2))
    for r in held.groupBy(bin_.alias("bin"), "kind").count().collect():
        counts[r["kind"], r["bin"] + edge] += r["count"]
    if not counts.sum(1).all():
        return float("inf")
    above = 1 - np.cumsum(counts, 1) / counts.sum(1, keepdims=True)  # share with a higher bin
    gain = above[1] - above[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[len(best) // 2] + 1 - edge) * BIN)


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A fitting rule decides, else the model; rule is null then. Null URLs and
    URLs without '://' have empty host and path, score 0 and, as far as 0 is
    under the threshold, are allowed. Repeated rows stay, further columns are
    not read, an empty table gives no rows.
    """
    host, path = host_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("text", F.concat("host", "path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when((F.col("score") > model.threshold) & (F.concat("host", "path") != ""), "block").otherwise("allow")
    return scores(parts, model.counts, "page_id", "host", "path").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
