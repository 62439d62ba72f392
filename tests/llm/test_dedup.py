"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from otflow.llm import exact_dedup, graph, simhash, suffix_dedup
from tests.llm.helpers import clashing, documents, frame, words


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def test_exact_groups(spark):
    docs = documents() + [(53, "one", "en", "src", None), (None, "two  words", "en", "src", None), (70, "two words", "en", "src", None)]
    got = exact_dedup.exact_groups(clashing(frame(spark, docs))).collect()
    want, kept = [], {}
    for d, t, *_ in docs:
        group = [(len(u or ""), -e if e is not None else float("-inf"), e) for e, u, *_ in docs if norm(u) == norm(t)]
        best = max(group)
        want.append((d, best[2], len(group), hashlib.sha256(norm(t).encode()).hexdigest()))
        kept[norm(t)] = (best[2], best[0])
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got))) == sorted(map(str, want))
    # One row of each group stays, though some repeat each other.
    stays = [(r["text_sha256"], r["doc_id"]) for r in got if r["kept"]]
    assert sorted(map(str, stays)) == sorted(str((hashlib.sha256(t.encode()).hexdigest(), d)) for t, (d, _) in kept.items())


def test_exact_groups_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "DIGIT_ENDS", (4, 16))
    long = "abcdefgh" * 5000
    rows = [(1, long, "", "", 0), (2, long, "", "", 0), (3, long[:-1] + "x", "", "", 0), (4, long[:-1], "", "", 0)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(frame(spark, rows)).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True), 4: (4, 1, True)}


def test_drop_copies_keeps_columns(spark):
    docs = frame(spark, documents() + documents()[:5])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [norm(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, *_ in documents()})


def fingerprint(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def components(values, linked):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if linked(a, b):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in values}


def test_near_groups(spark):
    docs = documents()
    prints = [(d, fingerprint(t)) for d, t, *_ in docs]
    roots = components(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for d, f in prints:
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    want = [(d, f"{f:016x}", least.get(roots[f])) for d, f in prints]
    got = simhash.near_groups(clashing(frame(spark))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("settings", [simhash.CLOSE, simhash.Settings(seeds=3, width=8)])
@pytest.mark.parametrize("tile", [4096, 70, 8])
def test_near_links_of_dense_fingerprints(spark, tile, settings):
    """Many fingerprints within few bits of each other, in small buckets, in those of over 64 rows and in tiles."""
    rng = np.random.default_rng(1)
    size = settings.seeds * 64
    fps = set()
    for _ in range(6):
        base = int.from_bytes(rng.bytes(size // 8), "big")
        fps.add(base)
        for _ in range(60):
            x = base
            for bit in rng.integers(0, size, rng.integers(1, settings.max_bits + 2)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    rows = [(k, f.to_bytes(size // 8, "big")) for k, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "node long, fp binary"), settings, tile)
    found = {(fps[r["u"]], fps[r["v"]]) for r in links.collect()}
    assert found and all((a ^ b).bit_count() <= settings.max_bits for a, b in found)
    assert components(fps, lambda a, b: (a, b) in found or (b, a) in found) == components(fps, lambda a, b: (a ^ b).bit_count() <= settings.max_bits)


def test_similar_texts_share_a_group(spark):
    """Of copies with 1 % of their words changed nearly all join their group, and nothing else does."""
    rng = random.Random(7)
    rows = []
    for k in range(40):
        text = words(1000 + k, 150 + 20 * k).split()
        rows.append((10 * k, " ".join(text)))
        for c in range(1, 4):
            copy = list(text)
            for _ in range(len(copy) // 100):
                copy[rng.randrange(len(copy))] = words(rng.randrange(10**6), 1)
            rows.append((10 * k + c, " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, [(d, t, "", "", 0) for d, t in rows])).collect()}
    assert all(got[d] in (d, *range(d // 10 * 10, d)) for d in got)
    assert np.mean([got[d] == d // 10 * 10 for d in got]) > 0.95
    assert simhash.drop_near_copies(frame(spark)).columns == frame(spark).columns


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (1, 0), (500, 300), (300, 400)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 300: 300, 400: 300, 500: 300}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(docs, length=50):
    seen = {}
    for d, t, *_ in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if d is not None:
                seen[w] = min(d, seen.get(w, d))
    out = []
    for d, t, *_ in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if d is not None and seen[b[p : p + length]] < d:
                gone[p : p + length] = True
        steps = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), len(steps) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def test_remove_repeats(spark):
    rng, docs = random.Random(3), documents()
    phrases = [words(600 + k, 12) for k in range(6)]
    # Passages that overlap in parts only, of every length about the limit, and doc_ids that repeat with other texts.
    docs += [(300 + k % 50, "".join(rng.choice(phrases)[rng.randrange(30) :] for _ in range(6)), "", "", 0) for k in range(60)]
    docs += [(400 + k, chr(97 + k) + phrases[0][k : k + 40 + k], "", "", 0) for k in range(20)]
    docs += [(500 + k, "".join(rng.choice("ab") for _ in range(400)), "", "", 0) for k in range(4)]
    got = suffix_dedup.remove_repeats(clashing(frame(spark, docs))).drop("spans", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == brute_repeats(docs)


def test_no_step_of_remove_repeats_holds_more_than_its_share(spark, monkeypatch):
    passage = words(7, 4000)
    docs = frame(spark, [(k, f"{words(100 + k, 500)} {passage[k:]} {words(200 + k, 500)}", None, None, None) for k in range(4)])
    plain, rows = suffix_dedup.materialize, {}

    def counted(df, label, *args):
        written = plain(df, label, *args)
        rows.setdefault(label, []).append(written.count())
        return written

    monkeypatch.setattr(suffix_dedup, "materialize", counted)
    digests = lambda: sorted(suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed", "n_spans", "kept_sha256").collect())
    got = digests()
    for label, share in (("anchors", 0.6), ("windows", 0.5)):
        assert sum(rows[label]) > 20 and max(rows[label]) <= share * sum(rows[label]), (label, rows[label])
    for name, passes in (("ANCHOR_PASSES", 1), ("WINDOW_PASSES", 1)):
        monkeypatch.setattr(suffix_dedup, name, passes)
    rows.clear()
    assert got == digests() and len(rows["windows"]) == len(rows["anchors"]) == 1


def test_short_documents_are_hashed_together(monkeypatch):
    """A batch costs numpy's calls for its bytes, not for its rows, and gives each document's anchors as if it were alone."""
    import pyarrow as pa

    rng, plain, seen = random.Random(5), suffix_dedup.Text, []

    def text(data):
        seen.append(len(data))
        return plain(data)

    monkeypatch.setattr(suffix_dedup, "Text", text)
    passage = words(8, 300).encode()
    texts = [passage[k : k + rng.randrange(400)] for k in range(300)] + [None, b"", b"x" * 49, b"y" * 50, b"ab" * 90, words(9, 4000).encode()]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    def rows(batches, **kwargs):
        seen.clear()
        out = [r for part in suffix_dedup._anchor_rows(batches, **kwargs) for r in part.to_pylist()]
        return sorted((r["doc"], r["info"] & ~(1 << 31), r["check"]) for r in out)

    alone = rows(batch.slice(k, 1) for k in range(len(texts)))
    assert alone and rows([batch]) == alone and len(seen) < 10
    assert sorted(rows([batch], turn=0, passes=2) + rows([batch], turn=1, passes=2)) == alone
    # Of each document, every window has one owner.
    covered = Counter((d, w) for d, info, _ in alone for w in range((info & 0x7FFFFFFF) - (info >> 38), (info & 0x7FFFFFFF) - (info >> 32 & 63) + 1))
    assert covered == Counter((d, w) for d, t in enumerate(texts) for w in range(len(t or b"") - 49))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)  # a document of many blocks, the same anchors
    assert rows([batch.slice(5)]) == [r for r in alone if r[0] >= 5]


def test_first_round_carries_groups_over_batches():
    """The same settlements however the sorted rows are cut into batches."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 400
    key, check, doc = rng.integers(0, 40, n), rng.integers(0, 3, n), rng.integers(0, 30, n)
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    batch = pa.record_batch([pa.array(key), pa.array(check), pa.array(doc), pa.array(np.arange(n))], names=["key", "check", "doc", "info"])

    def run(size):
        out = []
        for part in suffix_dedup._first_round(batch.slice(a, size) for a in range(0, n, size)):
            out += [(r["doc"], r["begin"], r["full"]) for r in part.to_pylist()]
        return sorted(out)

    assert run(n) == run(7) == run(1) == run(64)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_groups(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def edited(text, other):
    """Copies of a list of words with one contiguous edit each: appended, truncated, and with a block replaced."""
    n = len(text)
    return [text + other[: n * 18 // 100], text[: n * 84 // 100], text[: n // 2] + other[: n * 8 // 100] + text[n // 2 + n * 8 // 100 :]]


def jaccard(a, b):
    a, b = ({" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def pairs_of(found):
    """The pairs of near_pairs, each as (larger, smaller)."""
    return [(max(p), min(p)) for r in found.collect() for p in zip(r["us"], r["vs"])]


def test_recall_of_candidates(spark, capsys):
    """Of pairs with contiguous edits and of pairs with changed words, at 0.8 or more, nearly all are candidates."""
    rng, rows, want = random.Random(11), [], set()
    for k in range(60):
        text, other = words(2000 + k, 200 + 10 * k).split(), words(5000 + k, 300).split()
        scattered = [w if rng.random() > 0.02 else "changed" for w in text]
        copies = [text, *edited(text, other), scattered]
        want |= {(5 * k + c, 5 * k) for c in (1, 2, 3, 4) if jaccard(" ".join(copies[c]), " ".join(text)) >= 0.8}
        rows += [(5 * k + c, simhash.fingerprint(" ".join(t).encode(), simhash.CANDIDATES), 5 * k + c, 5 * k + c) for c, t in enumerate(copies)]
    found = set(pairs_of(simhash.near_pairs(spark.createDataFrame(rows, "node long, fp binary, group long, block long"))))
    with capsys.disabled():
        print(f"recall of near-copy candidates at 0.8 or more: {len(found & want) / len(want):.3f} of {len(want)}")
    assert len(want) > 200 and len(found & want) > 0.97 * len(want)
    assert all(u // 5 == v // 5 for u, v in found)


@pytest.mark.parametrize("tile", [4096, 70, 40])
def test_pairs_of_dense_buckets(spark, tile):
    """All pairs that differ in few bits, once each, and none within a group; of nearest ones enough to connect all."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 8 * simhash.CANDIDATES.seeds, np.uint8)
    fps = []
    for _ in range(150):
        fp = np.unpackbits(base)
        fp[rng.integers(0, len(fp), 3)] ^= 1
        fps.append(np.packbits(fp).tobytes())
    nodes = spark.createDataFrame([(k, f, k, k % 4) for k, f in enumerate(fps)], "node long, fp binary, group long, block long")
    found = pairs_of(simhash.near_pairs(nodes, tile=tile))
    assert len(set(found)) == 150 * 149 // 2 and (tile < 4096 or len(found) == len(set(found)))
    nearest = {(r["u"], r["v"]) for r in simhash.nearest_pairs(nodes, tile=tile).collect()}
    assert nearest <= set(found) and len(nearest) < 300
    assert set(components(list(range(150)), lambda a, b: (b, a) in nearest).values()) == {0}
    same = nodes.withColumn("group", nodes["node"] % 2)
    assert {(u + v) % 2 for u, v in pairs_of(simhash.near_pairs(same, tile=tile))} == {1}


def test_drop_near_copies_is_whole_and_right(spark):
    """What stays is what brute force over all pairs of shingle sets leaves: contiguous edits go, related texts of 0.5 to 0.8 stay."""
    texts = []
    for k in range(15):
        text, other = words(3000 + k, 150 + 20 * k).split(), words(7000 + k, 900).split()
        texts += [text, *edited(text, other), text + other[: len(text) * 40 // 100], text[: len(text) * 70 // 100]]
    texts = [" ".join(t) for t in texts] + ["X longword", "Y longword", "a b c d e f", "a b c d e g", ""]
    rows = list(enumerate(texts))
    linked = components([d for d, _ in rows], lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    got = simhash.drop_near_copies(frame(spark, [(d, t, "", "", 0) for d, t in rows]))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(linked.values()))


def test_second_round_finds_what_nearest_pairs_left(spark):
    """A dense family in which most nearest pairs are refused."""
    text, texts = words(77, 400).split(), []
    for k in range(50):
        own = text[:300] + words(8000 + k, 100).split()
        texts += [" ".join(own), " ".join(own[:-20])]
    linked = components(list(range(100)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(frame(spark, [(d, t, "", "", 0) for d, t in enumerate(texts)])).collect()}
    assert got == linked and len(set(linked.values())) == 50


def test_drop_near_copies_matches_text(spark):
    """An unrelated text stays though its doc_id is also that of a near copy; of near copies with one doc_id one stays."""
    text = words(81, 200)
    rows = [(1, text), (2, text + " extra"), (2, words(82, 90)), (3, words(83, 200)), (3, words(83, 200) + " extra"), (None, text), (4, None)]
    left = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(frame(spark, [(d, t, "", "", 0) for d, t in rows])).collect()]
    assert sum(d == 3 for d, _ in left) == 1
    assert sorted(map(str, (r for r in left if r[0] != 3))) == sorted(map(str, (rows[0], rows[2], rows[5], rows[6])))
