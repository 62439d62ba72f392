"""WARC revisits, training order, the pipeline and the registered queries."""

import gzip
import hashlib
import os
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from otflow.llm import bpe, queries, training_order, warc
from otflow.llm.common import materialize, table
from tests.llm.helpers import clashing, documents, frame

SF = "/root/testdata/sf0.001"
CAPTURE = "record_id string, uri string, ts long, kind string, status int, headers map<string,string>, body_sha256 string"


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_revisits_equal_plain_lookup(spark, partitions):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        uri = f"HTTP://Host{'' if rng.random() < 0.4 else rng.integers(0, 5)}.test:80/a#f{k}"
        kind = ["response", "revisit", "metadata"][int(rng.integers(0, 5)) % 3]
        headers = {"etag": f"e{rng.integers(0, 3)}", "x": "1", "date": str(k)} if rng.random() < 0.7 else {"last-modified": f"m{rng.integers(0, 2)}"} if rng.random() < 0.5 else {}
        status = [200, 200, 206, 404, None][int(rng.integers(0, 5))] if kind == "response" else 304
        rows.append((f"<urn:{k}>", uri if rng.random() < 0.97 else None, int(rng.integers(0, 60)) if rng.random() < 0.97 else None, kind, status, headers, f"b{k}" if kind == "response" else None))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {r["record_id"]: r for r in warc.resolve_revisits(clashing(spark.createDataFrame(rows, CAPTURE))).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    canonical = lambda u: u and u.split("#")[0].lower().replace(":80/", "/")
    for k, uri, ts, kind, _, headers, _ in rows:
        if kind != "revisit":
            assert k not in got
            continue
        earlier = [(t, i, h, b) for i, u, t, what, code, h, b in rows if what == "response" and code == 200 and None not in (u, t, uri, ts) and canonical(u) == canonical(uri) and t < ts]
        hit = max(earlier, key=lambda r: r[:2], default=None)
        want = "missing"
        if hit:
            check = next((n for n in ("etag", "last-modified") if n in headers), None)
            want = "unchecked" if check is None else "resolved" if hit[2].get(check) == headers[check] else "mismatch"
        merged = headers if want in ("missing", "mismatch") else hit[2] | {n: v for n, v in headers.items() if n in warc.UPDATABLE}
        assert (got[k]["response_id"], got[k]["outcome"], got[k]["headers"]) == (hit[1] if hit else None, want, merged)


def test_revisits_of_empty_table(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], CAPTURE)).count() == 0


def record(kind, uri, block, date="2024-01-01T00:00:00Z"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{uri}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_read_warc(spark, tmp_path):
    full = record("response", "http://a/", b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nWARC/ body")
    again = record("revisit", "http://a/", b"HTTP/1.1 304 Not Modified\r\nETag: x\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(full + again + full[:60])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(full) + gzip.compress(again))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r["kind"], r["status"], bytes(r["body"]), r["headers"]["etag"]) for r in rows) == 2 * [("response", 200, b"WARC/ body", "x")] + 2 * [("revisit", 304, b"", "x")]
    assert rows[0]["ts"].year == 2024


def test_files_to_resolved_revisits(spark, tmp_path):
    """From files to headers: a 404 and a 206 between a full response and its revisit don't stand in for it."""
    at = lambda k: f"2024-01-01T00:00:{k:02d}Z"
    one = record("response", "http://A.test:80/x", b"HTTP/1.1 200 OK\r\nETag: v1\r\nContent-Type: text/html\r\n\r\nbody", at(1))
    gone = record("response", "http://a.test/x", b"HTTP/1.1 404 Not Found\r\n\r\nno", at(2))
    part = record("response", "http://a.test/x", b"HTTP/1.1 206 Partial Content\r\nETag: v1\r\n\r\nbo", at(3))
    again = record("revisit", "http://a.test/x#f", b"HTTP/1.1 304 Not Modified\r\nETag: W/v1\r\nExpires: never\r\n\r\n", at(4))
    early = record("revisit", "http://a.test/x", b"HTTP/1.1 304 Not Modified\r\n\r\n", at(0))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, (one, gone, again))))
    (tmp_path / "b.warc").write_bytes(part + early)
    got = {r["outcome"]: r for r in warc.resolve_revisits(warc.read_warc(spark, str(tmp_path))).collect()}
    assert set(got) == {"resolved", "missing"}
    hit = got["resolved"]
    assert (hit["record_id"], hit["response_id"], hit["canonical_url"]) == ("<http://a.test/x#f>", "<http://A.test:80/x>", "http://a.test/x")
    assert hit["headers"] == {"etag": "W/v1", "content-type": "text/html", "expires": "never"}
    assert hit["body_sha256"] == hashlib.sha256(b"body").hexdigest()


GOOD = record("response", "http://a/", b"HTTP/1.1 200 OK\r\n\r\nbody")


def zipped(data):
    return gzip.compress(data, mtime=0)


def with_length(text):
    head, _, rest = GOOD.partition(b"\r\n\r\n")
    return re.sub(rb"Content-Length: \d+", b"Content-Length: " + text, head) + b"\r\n\r\n" + rest


@pytest.mark.parametrize(
    "data, good, bad",
    [
        (with_length(b"many") + GOOD, 1, 1),
        (with_length(b"-7") + GOOD, 1, 1),
        (with_length("\u0663".encode()) + GOOD, 1, 1),
        (GOOD + with_length(b"99999"), 1, 1),
        (GOOD + with_length(b"99999") + GOOD + GOOD, 3, 1),
        (GOOD + with_length(b"%d" % (len(GOOD) + 40)) + GOOD + GOOD, 3, 1),
        (GOOD + with_length(b"3") + GOOD, 2, 1),
        (with_length(b"9" * 40) + GOOD, 1, 1),
        (GOOD + b"WARC/1.0\r\n" + b"x" * 70_000 + b"\r\n\r\n" + GOOD, 2, 1),
        (zipped(GOOD) + zipped(GOOD)[:-30] + zipped(GOOD), 2, 0),
        (zipped(GOOD)[:20] + b"\xff" * 30 + zipped(GOOD), 1, 0),
        (zipped(GOOD) + zipped(GOOD)[:40], 1, None),
        (zipped(GOOD + GOOD + GOOD[:80]), 2, 1),
        (zipped(GOOD * 3), 3, 0),
        (b"", 0, 0),
        (b"no record", 0, 0),
        (b"\x1f\x8b", 0, 0),
    ],
)
@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_malformed_records(monkeypatch, data, good, bad, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    found = list(warc.parse_warc(data))
    kept = [r for r in found if r["kind"] != "malformed"]
    assert len(kept) == good and all(r["body"] == b"body" for r in kept)
    assert len(found) - len(kept) >= (bad or 0)


def test_damage_at_any_place():
    """A member that is changed or cut at any byte, between two good ones, costs itself at most."""
    z = zipped(GOOD)
    for at in range(len(z)):
        for data in (z + z[:at] + z, z + z[:at] + bytes([z[at] ^ 0x55]) + z[at + 1 :] + z):
            kept = [r for r in warc.parse_warc(data) if r["kind"] != "malformed"]
            assert 2 <= len(kept) <= 3 and all(r["body"] == b"body" for r in kept)


def test_malformed_rows_are_counted(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(with_length(b"-7") + GOOD)
    assert [r["kind"] for r in warc.read_warc(spark, str(tmp_path)).collect()] == ["response"]
    assert sorted(r["kind"] for r in warc.read_warc(spark, str(tmp_path), malformed=True).collect()) == ["malformed", "response"]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = training_order.feistel(np.arange(n), n, key=9)
    assert sorted(slots.tolist()) == list(range(n))
    assert training_order.feistel(slots, n, key=9, inverse=True).tolist() == list(range(n))
    if n > 100:
        assert slots.tolist() != training_order.feistel(np.arange(n), n, key=10).tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def plain_slot(index, n, key):
    """The Feistel permutation with cycle-walking in whole numbers."""
    mask64 = 2**64 - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask64
        return x ^ x >> 31

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = index >> half, index % (1 << half)
        for k in range(1, training_order.ROUNDS + 1):
            left, right = right, left ^ (mix(right + mix(k + key & mask64) & mask64) % (1 << half))
        index = left << half | right
        if index < n:
            return index


def expected_records(docs, key, length, codec):
    """(doc_id, seq_no, n_tokens, padded ids) by slot: documents by id and text hash, their sequences in turn."""
    import xxhash

    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t, 42), "big", signed=True)
    texts = sorted(((d is not None, d or 0, signed(t.encode()), t.encode(), d) for d, t, *_ in docs if t))
    flat = []
    for *_, text, d in texts:
        ids = codec.encode([text])[0].tolist()
        flat += [(d, k, len(ids[a : a + length]), (ids[a : a + length] + [training_order.PAD] * length)[:length]) for k, a in enumerate(range(0, len(ids), length))]
    return {plain_slot(i, len(flat), key): r for i, r in enumerate(flat)}


@pytest.mark.parametrize("files, split", [(1, "128m"), (3, "2k"), (7, "128m")])
def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path, files, split):
    """Slots depend on data and key only, whatever the number of files and splits, and records are where they say."""
    docs = documents() + [(61, "ab" * 40_000, "", "", 0), (53, "one", "", "", 0)]
    clashing(frame(spark, docs)).repartition(files).write.parquet(str(tmp_path / "docs"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.shuffle.partitions", str(files + 1))
    folder = f"file://{tmp_path}/shards"
    written = sorted(training_order.materialise(spark.read.parquet(str(tmp_path / "docs")), queries.RANKS, 3, folder, length=16, shard_records=32).collect())
    for k, v in before.items():
        spark.conf.set(k, v)
    want = expected_records(docs, 3, 16, bpe.codec(queries.RANKS))
    assert [r["slot"] for r in written] == list(range(len(want)))
    assert [(r["doc_id"], r["seq_no"], r["n_tokens"]) for r in written] == [want[k][:3] for k in range(len(want))]
    assert [(r["shard"], r["byte_offset"], r["path"]) for r in written] == [(k // 32, k % 32 * 32, f"{folder}/shard-{k // 32:08d}.bin") for k in range(len(want))]
    assert os.path.getsize(tmp_path / "shards/shard-00000000.bin") == 32 * 32
    assert not [f for f in os.listdir(tmp_path / "shards") if f.startswith(".shard") and not f.endswith(".crc")]
    got = list(training_order.read_records(folder, 0, len(want), length=16, shard_records=32))
    assert [g.tolist() for g in got] == [want[k][3] for k in range(len(want))]
    assert [hashlib.sha256(g.tobytes()).hexdigest() for g in got] == [r["record_sha256"] for r in written]


def test_encoder_seeks_no_empty_text():
    """tiktoken's search for special tokens doesn't stop at each character, and their texts are texts."""
    import tiktoken
    from public_tokenizers import PATTERN

    own = training_order._encoder(queries.RANKS)
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=training_order._ranks(queries.RANKS), special_tokens={})
    assert own.special_tokens_set and "" not in own.special_tokens_set
    marks = [*own.special_tokens_set, "<|", "|>", "endoftext"]
    texts = [t for _, t, *_ in documents() if t] + [f"{a}{b} x{a}\n{b}é" for a in marks for b in marks] + ["".join(marks) * 50, marks[0] * 300]
    for t in texts:
        got = own.encode_to_numpy(t, disallowed_special=())
        assert got.tolist() == plain.encode_ordinary(t) and own.decode_bytes(got.tolist()) == t.encode()


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_training_order_drops_a_steps_shuffle_files_before_the_next(spark, tmp_path, monkeypatch):
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before, seen = shuffle_files(spark), []

    def ordered(*args, plain=training_order.ordered):
        until = time.time() + 5
        while shuffle_files(spark) > before and time.time() < until:
            time.sleep(0.05)
        seen.append(shuffle_files(spark) - before)
        return plain(*args)

    monkeypatch.setattr(training_order, "ordered", ordered)
    training_order.materialise(frame(spark), queries.RANKS, 3, f"file://{tmp_path}/out", 16, 8)
    assert len(seen) == 1 and seen[0] <= 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_training_order_edge_cases(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert training_order.materialise(frame(spark, []), queries.RANKS, 1, folder).count() == 0
    assert training_order.materialise(frame(spark, [(1, None, "", "", 0), (2, "", "", "", 0)]), queries.RANKS, 1, folder).count() == 0
    wide = tmp_path / "wide.tiktoken"
    wide.write_text("IQ== 0\nIg== 70000\n")
    with pytest.raises(ValueError):
        training_order.sequences(frame(spark), str(wide))


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in records)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df, found = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_reads_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name == "op11_prefix_trie":  # every conversation is a member of the root
        assert df.where("depth = 0").first()["n_convs"] == table(spark, SF, "conversations").select("conv_id").distinct().count()
        return
    if name == "op13_filter_audit":  # what the steps of an order remove and leave is all there is
        one = df.where("filter_order = 'ABCDE'").groupBy().agg(F.sum("removed"), F.sum(F.expr("if(step = 5, kept, 0)"))).first()
        assert sum(one) == table(spark, SF, "documents").count()
        return
    key = "page_id" if "page_id" in df.columns else "doc_id"
    whole = {r[0] for r in table(spark, SF, "pages" if key == "page_id" else "documents").select(key).collect()}
    found = {r[0] for r in df.select(key).collect()}
    assert found == whole if name not in ("op4_decontamination", "op7_license_scan") else found <= whole


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        ids = {r[0] for r in kept.select("doc_id").collect()}
        assert ids <= {r[0] for r in docs.select("doc_id").collect()}
        docs = materialize(kept, name)
    want = {r[0] for r in docs.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == want
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)


def test_shared_folder_is_required_on_clusters():
    from types import SimpleNamespace

    from otflow.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda key, default: default)
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
