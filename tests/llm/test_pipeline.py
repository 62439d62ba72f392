"""Each stage of the pipeline against brute force over documents with planted cases of all kinds."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from otflow.llm import bpe, toxicity
from otflow.llm.common import WordHash, materialize
from otflow.llm.queries import RANKS
from tests.llm.helpers import clashing, documents, frame, words
from tests.llm.test_dedup import components, edited, jaccard, norm
from tests.llm.test_text import brute_leaks

STAGES = dict(corpus_pipeline.STAGES)
ITEMS = [(k, words(9000 + k, 30)) for k in range(5)] + [(7, ""), (8, None)]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(1), documents()
    for k in range(120):
        text = words(4000 + k, 60).split()
        if k % 4 == 0:
            for _ in range(12):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "scum", "vermin"]))
        out.append((1000 + k, " ".join(text), "", "", 0))
    for k in range(10):
        text, other = words(6000 + k, 300).split(), words(7000 + k, 300).split()
        copies = [text, *edited(text, other), text + other[:120]]
        out += [(2000 + 10 * k + c, " ".join(t), "", "", 0) for c, t in enumerate(copies)]
    for k, item in ITEMS[:5]:
        out.append((3000 + k, f"{words(k, 80)} {item} {words(k + 1, 80)}", "", "", 0))
    out += [(2000, " ".join(words(6000, 300).split()), "", "", 0), (None, words(6001, 300), "", "", 0), (3100, words(3100, 20_000), "", "", 0)]
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    labels = [(d, 0, int("vile" in t or "scum" in t or "vermin" in t)) for d, t, *_ in rows if d and 1000 <= d < 1120] + [(None, 0, 1), (5, 0, None), (77_777, 0, 1)]
    frame(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_toxicity_stage(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weights, hashes = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")), WordHash()
    of = dict(zip(weights.slots.tolist(), weights.values.tolist()))
    score = lambda t: 1 / (1 + np.exp(-weights.intercept - sum(of.get(s, 0.0) for s in set(toxicity.features((t or "").encode(), hashes).tolist()))))
    want = [(d, t) for d, t, *_ in rows if score(t) < toxicity.THRESHOLD]
    got = STAGES["toxicity"](spark, clashing(docs), folder)
    assert got.columns == clashing(docs).columns and plain(got) == sorted(want, key=str)
    left = {d for d, _ in want}
    held = [d for d, t, *_ in rows if d and 1000 <= d < 1120 and toxicity.fold(d) == 2]
    assert all((d in left) == ((d - 1000) % 4 != 0) for d in held)


def test_exact_stage(spark, rows, folder):
    best = {}
    for d, t, *_ in rows:
        rank = (len(t or ""), d is not None, -(d or 0))
        if norm(t) not in best or rank > best[norm(t)][0]:
            best[norm(t)] = (rank, (d, t))
    docs = clashing(spark.read.parquet(f"{folder}/documents.parquet"))
    # Of rows that tie in length and id any text may stay.
    got = plain(STAGES["exact_dedup"](spark, docs, folder))
    assert [(d, norm(t)) for d, t in got] == [(d, norm(t)) for d, t in sorted((r for _, r in best.values()), key=str)]


def test_near_stage(spark, rows, folder):
    texts = sorted({t or "" for _, t, *_ in rows})
    roots = components(list(range(len(texts))), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    of = {t: roots[k] for k, t in enumerate(texts)}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[of[t or ""]] = min(d, least.get(of[t or ""], d))
    want = sorted(((d, t) for d, t, *_ in rows if d is None or least[of[t or ""]] == d), key=str)
    got = plain(STAGES["simhash_near_dedup"](spark, clashing(spark.read.parquet(f"{folder}/documents.parquet")), folder))
    assert got == want and len(got) < len(rows) - 30


def test_decontamination_stage(spark, rows, folder):
    short = [(k, r[1]) for k, r in enumerate(rows) if len(r[1] or "") < 20_000]  # word by word, brute force takes its time
    short = [(k, t) for k, t in short if (rows[k][0] or 0) >= 2000 or rows[k][0] in (50, 51, 53)]
    bad = {int(x.strip("(").split(",")[0]) for x in brute_leaks(short, ITEMS)}
    got = plain(STAGES["decontamination"](spark, clashing(spark.read.parquet(f"{folder}/documents.parquet")), folder))
    assert {3000, 3001, 3002, 3003, 3004} <= {rows[k][0] for k in bad}
    leaking = {rows[k][1] for k in bad}
    assert got == sorted(((d, t) for d, t, *_ in rows if t not in leaking), key=str)


def test_texts_leak_whatever_their_ids(spark):
    from otflow.llm import decontaminate

    item = words(77, 20)
    docs = [(1, words(1, 40)), (1, f"{words(2, 9)} {item}"), (None, item), (None, words(3, 30)), (2, item), (2, item), (3, None), (4, ""), (5, words(4, 30)), (5, words(4, 30))]
    kept = decontaminate.drop_leaking(clashing(frame(spark, [(d, t, "en", "s", 0) for d, t in docs])), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted((str(d), str(t)) for d, t in docs if item not in (t or ""))


def test_bpe_stage(spark, rows, folder):
    from public_tokenizers import PATTERN

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.codec(RANKS).ranks, special_tokens={})
    want = []
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = STAGES["byte_bpe"](spark, clashing(spark.read.parquet(f"{folder}/documents.parquet")), folder)
    assert sorted(map(str, map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))) == sorted(map(str, want))


def test_run_applies_all_stages(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())
    left = {r["doc_id"] for r in got}
    assert not left & {3000, 3001, 3002, 3003, 3004} and not left & {d for d in range(1000, 1120, 4)} and 2000 in left and 2001 not in left


def test_stages_of_empty_tables(spark, tmp_path):
    empty = frame(spark, [])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
