"""BPE, toxicity, decontamination, licenses and URLs against libraries, brute force and held-out accuracy."""

import random
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from otflow.llm import bpe, decontaminate, license_scan, toxicity, url_filter
from otflow.llm.common import WordHash, folded_words, table
from otflow.llm.license_texts import TEMPLATES
from otflow.llm.queries import RANKS
from tests.llm.helpers import clashing, documents, frame, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_equals_library(codec, library):
    rng = random.Random(1)
    letters = "a's'tre've'll'd'm  \n\t .,!'0½ⅷéßñ日本 　\x1c\x85😀lRvE's\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", " ", "'", "'re", "'r", "'rx", "é" * 3000, "ab" * 5000, " " * 300 + "x", "<|endoftext|>"]
    got = codec.encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(g).decode() for g in got] == texts


def test_bpe_of_long_texts(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 200)
    monkeypatch.setattr(bpe, "CHUNK", 40)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab's \n\t.é\u3000\xa01") for _ in range(n)) for n in (199, 201, 3000)] + ["x" * 500, "ok", " " * 400, ""]
    assert [g.tolist() for g in codec.encode([t.encode() for t in texts])] == [library.encode_ordinary(t) for t in texts]


def test_bpe_classes_of_all_code_points(codec, library):
    points = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for at in range(0, len(points), 1 << 16):
        texts = ["".join(f"a{c}1{c}{c}." for c in points[k : k + 32]) for k in range(at, min(at + (1 << 16), len(points)), 32)]
        assert [g.tolist() for g in codec.encode([t.encode() for t in texts])] == library.encode_ordinary_batch(texts)


def test_scan_equals_stepping():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, bpe.N_CLASSES, 5000).astype(np.uint8)
    step, _ = bpe.tables()
    state, want = 0, []
    for k in kinds:
        want.append(state)
        state = int(step[k, state])
    assert bpe.states_before(kinds).tolist() == want


def test_encode_decode_and_offsets(spark, codec):
    docs = clashing(frame(spark))
    encoded = bpe.encode(docs, RANKS)
    texts = sorted((str(r["doc_id"]), bytes(r["text"])) for r in bpe.decode(encoded, RANKS).collect())
    assert texts == sorted((str(d), (t or "").encode()) for d, t, *_ in documents())
    for r in encoded.collect():
        assert list(r["offsets"]) == np.cumsum([0] + [len(codec.vocabulary[i]) for i in r["ids"]])[:-1].tolist()
    assert bpe.round_trip(frame(spark, []), RANKS).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    scores = toxicity.score(docs, toxicity.fit(docs, labels))
    assert scores.count() == docs.count()
    judged = scores.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in judged])
    caught = np.mean([r["predicted"] for r in judged if r["toxic"]])
    assert right > 0.9 and caught > 0.5
    assert np.mean([r["predicted"] for r in judged if not r["toxic"]]) < 0.05


def test_toxicity_edge_cases(spark):
    docs = clashing(frame(spark))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(rows) == len(documents()) and {r["score"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(1, 25)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    weights = toxicity.fit(docs, labels, max_rows=5)
    rows = toxicity.score(docs, weights).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and {r["held_out"] for r in rows if r["doc_id"] is None} == {None}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_training_sample_is_bounded_and_meets_the_documents(spark):
    """Labels of absent documents take no place in the sample, and copies of a document no more than one."""
    docs = frame(spark, [(k, words(k, 30), "", "", 0) for k in range(200)] + [(4, words(4, 30), "", "", 0)] * 40)
    usable = [k for k in range(200) if toxicity.fold(k) != 2]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(1000 + k, 1) for k in range(5000)] + [(4, 0)] * 3, "doc_id long, toxic int")
    for most in (10, 60, 10_000):
        got = toxicity.training_sample(docs, labels, most).collect()
        assert len(got) == min(most, len(usable)) and {r["doc_id"] for r in got} <= set(usable)
        assert all(r["toxic"] == r["doc_id"] % 2 for r in got)
    whole = toxicity.fit(docs, labels, max_rows=1000)
    assert toxicity.fit(docs, labels, max_rows=1000, max_slots=0).intercept == 0 != whole.intercept


def test_training_holds_no_copies_of_its_slots_in_the_driver(spark, monkeypatch):
    docs = frame(spark, [(k, words(k, 3000), "en", "src", None) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    found = {}

    def measured(rows):
        found.update(held=tracemalloc.get_traced_memory()[0] - before, slots=sum(len(s) for s, _ in rows), labels=sorted(t for _, t in rows))
        return toxicity.Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)

    monkeypatch.setattr(toxicity, "train_ftrl", measured)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        toxicity.fit(docs, labels)
    finally:
        tracemalloc.stop()
    assert found["slots"] > 300_000 and found["labels"] == sorted(k % 2 for k in range(60) if toxicity.fold(k) != 2)
    assert found["held"] < 3 * found["slots"]  # Arrow's own 4 bytes a slot aren't traced; copies took 12


def test_toxicity_scores_equal_plain_sums(spark):
    """Scores are the sums of the weights of a text's slots, counted plainly."""
    docs = documents()
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, *_ in docs if d], "doc_id long, toxic int")
    weights = toxicity.fit(frame(spark), labels)
    table_, hashes = dict(zip(weights.slots.tolist(), weights.values.tolist())), WordHash()
    got = toxicity.score(clashing(frame(spark)), weights).collect()
    want = []
    for d, t, *_ in docs:
        slots = set(toxicity.features((t or "").encode(), hashes).tolist())
        z = weights.intercept + sum(table_.get(s, 0.0) for s in slots)
        want.append((d, round(float(1 / (1 + np.exp(-z))), 6)))
    assert sorted(str((r["doc_id"], round(r["score"], 6))) for r in got) == sorted(map(str, want))


def test_ftrl_learns_a_sparse_rule():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        slots = np.unique(rng.integers(10, 1000, 30))
        rows.append((np.append(slots, 5) if k % 5 == 0 else slots, int(k % 5 == 0)))
    weights = toxicity.train_ftrl(rows, bits=10, l1=3.0)
    assert 5 in weights.slots and len(weights.slots) < 200
    assert weights.table()[5] == max(weights.values)


@pytest.mark.parametrize("window", range(5, 14))
def test_masks_are_lossless(window):
    for hidden in combinations(range(window), decontaminate.mismatches(window)):
        assert any(not set(hidden) & {p + at for p in mask} for mask in decontaminate.masks(window) for at in range(window - mask[-1]))


def plain_words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) >= 128 or c.isalnum() else " " for c in text or "").split()


def brute_leaks(docs, items):
    """Every window of every text against every window of every item, word by word."""
    out = {}
    for d, t in docs:
        text = plain_words(t)
        for i, u in items:
            item = plain_words(u)
            k = min(len(item), 13)
            need = k - int(k * 0.2 + 1e-9)
            for shift in range(-len(item), len(text)) if item and d is not None and i is not None else ():
                same = [0 <= p - shift < len(item) and text[p] == item[p - shift] for p in range(len(text))]
                for p in range(max(0, shift), min(len(text), shift + len(item)) - k + 1):
                    matched = sum(same[p : p + k])
                    if matched >= need and (matched, -p) > out.get((d, i), (0, 0)):
                        out[d, i] = (matched, -p)
    sizes = {i: min(len(plain_words(u)), 13) for i, u in items}
    return sorted(str((d, i, m, sizes[i], -p)) for (d, i), (m, p) in out.items())


@pytest.mark.parametrize("span", [256, 20])
def test_leaks_of_long_runs_of_passages(spark, monkeypatch, span):
    """A text full of passages, in segments of any length."""
    monkeypatch.setattr(decontaminate, "SPAN", span)
    passages = [words(750 + k, 30) for k in range(4)]
    rng = random.Random(5)
    runs = []
    for k in range(12):
        item = passages[k % 4].split()
        item[rng.randrange(30)] = "changed"
        runs.append(" ".join(item[rng.randint(0, 3) :]))
    docs = [(1, " ".join(runs)), (2, " ".join(["same"] * 300)), (3, words(9, 300))]
    items = [*enumerate(passages), (8, " ".join(["same"] * 40))]
    got = decontaminate.leaks(frame(spark, [(d, t, "", "", 0) for d, t in docs]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_leaks(docs, items)


def test_leaks_equal_brute_force(spark):
    passages = [words(700 + k, n) for k, n in enumerate((30, 13, 12, 10, 9, 7, 5, 4, 2, 1, 60))]
    items = [*enumerate(passages), (90, ""), (91, None), (None, passages[0]), (92, passages[0]), (3, passages[3])]
    rng = random.Random(4)
    docs = [(k, words(k, 40)) for k in range(8)]
    for k in range(120):
        item = passages[k % len(passages)].split()
        for _ in range(rng.randint(0, 1 + len(item) // 5)):
            item[rng.randrange(len(item))] = "changed"
        cut = item[rng.randint(0, 2) :][: len(item) - rng.randint(0, 2)]
        docs.append((100 + k, f"{words(k, 9)}. {' '.join(cut).upper() if k % 3 else ' '.join(cut)}! {words(k + 1, 9)}"))
    docs += [(500, None), (501, ""), (None, passages[0]), (502, passages[0] + " " + passages[0]), (502, passages[0])]
    got = decontaminate.leaks(clashing(frame(spark, [(d, t, "", "", 0) for d, t in docs])), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_leaks(docs, items)


def test_leaks_of_empty_tables(spark):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark), no_items).count() == 0
    assert decontaminate.leaks(frame(spark, []), spark.createDataFrame([(1, words(1, 30))], "item_id long, text string")).count() == 0
    assert decontaminate.drop_leaking(frame(spark), no_items).count() == len(documents())


def plain_shingles(text):
    w = plain_words(text)
    return [" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))]


def brute_licenses(docs, templates):
    """Every template against every window of its grid, as sets of word runs."""
    want = []
    for d, t in docs:
        run = plain_shingles(t)
        for name, text in templates.items():
            template = set(plain_shingles(text))
            m = len(template)
            block = 1 if m <= 4 else 2 ** (int(np.log2(m - 1)) - 1)
            hits = [(len(set(run[a : a + (m if m <= 4 else 5 * block)]) & template), -a) for a in range(0, len(run), block)]
            best = max(hits, default=(0, 0))
            if template and best[0] >= 0.8 * m:
                want.append((d, name, best[0], m, best[0] / m, -best[1]))
    return sorted(map(str, want))


def test_license_scan_equals_brute_force(spark):
    texts = list(TEMPLATES.values())
    rng = random.Random(2)
    docs = []
    for k in range(60):
        found = texts[k % len(texts)].split()
        for _ in range(rng.randint(0, len(found) // 20)):
            found[rng.randrange(len(found))] = "changed"
        docs.append((k, words(k, 30 + k) + "\n" + " ".join(found).upper() + "\n" + words(k + 1, 20)))
    docs += [(90, None), (91, ""), (92, "MIT"), (93, " ".join(texts)), (94, texts[0] * 50), (None, texts[0]), (90, texts[0])]
    got = license_scan.scan(clashing(frame(spark, [(d, t, "", "", 0) for d, t in docs]))).collect()
    want = brute_licenses(docs, TEMPLATES)
    assert sorted(str(tuple(r)) for r in got) == want and len(want) > 40
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_scan_with_other_templates(spark):
    """Many templates that no table holds, of all lengths, some within others, whole and with words changed."""
    rng = random.Random(9)
    templates = {f"t{k}": words(3000 + k, rng.choice((1, 3, 5, 6, 8, 9, 12, 20, 40, 90, 200))) for k in range(200)}
    templates |= {"within": templates["t7"] + " " + words(1, 12), "empty": ""}
    docs = []
    for k in range(80):
        name = f"t{rng.randrange(200)}"
        found = templates[name].split()
        for _ in range(len(found) // 50):
            found[rng.randrange(len(found))] = "changed"
        docs.append((k, words(k, rng.randrange(200)) + " " + " ".join(found) + ". " + words(k + 1, 50)))
    got = license_scan.scan(frame(spark, [(d, t, "", "", 0) for d, t in docs]), templates).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_licenses(docs, templates) and len(got) >= 60


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest.split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), k == "block", h + p, k) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit)[2:] if fit else None


def test_url_rules_and_parts(spark):
    urls = [
        "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "http://sub.example.org/en/2", "http://x.com/fr/", "http://x.com/de/1", "http://x.com/fr",
        "http://com/fr/a", "http://notorg/", "http://org/", "ftp://u@h:1/p//q?r", "http://h?q=a://b/c", "http://h#f", "nothing", "", None, "a://b://c/d", "http://ÀB.org/é", "http://x.com\n/fr/",
    ]
    pages = spark.createDataFrame([(k, u, "h", "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, html string, host string, score string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.fit(pages)).collect()}
    for k, u in enumerate(urls):
        host, path, rule = plain_rule(u)
        assert (rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == (host, path, rule and rule[0])
        assert rows[k]["verdict"] == (rule[1] if rule else "allow") or not rule


def plain_difference(text, counts):
    """The models' difference with counts in plain dictionaries."""
    total = 0.0
    data = [0] * url_filter.ORDER + list(text) + [1]
    for at in range(url_filter.ORDER, len(data)):
        logs = []
        for kind in (0, 1):
            p = 1 / 256
            for k in range(url_filter.ORDER + 1):
                context = tuple(data[at - k : at])
                p = (counts.get((kind, context, data[at]), 0) + url_filter.BACKOFF * p) / (counts.get((kind, context), 0) + url_filter.BACKOFF)
            logs.append(np.log(p))
        total += logs[1] - logs[0]
    return total / (len(text) + 1) if text else 0.0


def test_url_scores_equal_plain_model(spark, monkeypatch):
    """Scores against counts in dictionaries, in batches of any size."""
    monkeypatch.setattr(url_filter, "BATCH_ROWS", 7)
    monkeypatch.setattr(url_filter, "BATCH_BYTES", 200)
    rng = random.Random(6)
    urls = [f"http://{words(k, 1)}.example.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['de', 'fr', 'en', 'es'])}/{words(rng.randrange(9), 1)}" for k in range(60)]
    urls += [None, "", "nothing", "http://x.org/" + "y" * 3000, urls[0], urls[0]]
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, batch string, score string")
    counts = {}
    parts = {r["page_id"]: (r["host"] + r["path"]).encode() for r in pages.select("page_id", *(c.alias(n) for c, n in zip(url_filter.host_path(F.col("url")), ("host", "path")))).collect()}
    held = {r["text"].encode() for r in url_filter._examples(pages, None).where("held").collect()}
    for k, u in enumerate(urls):
        rule, text = plain_rule(u)[2], parts[k]
        if rule and text not in held:
            data = [0] * url_filter.ORDER + list(text) + [1]
            for at in range(url_filter.ORDER, len(data)):
                for n in range(url_filter.ORDER + 1):
                    for key in ((int(rule[1] == "block"), tuple(data[at - n : at])), (int(rule[1] == "block"), tuple(data[at - n : at]), data[at])):
                        counts[key] = counts.get(key, 0) + 1
    model = url_filter.fit(pages)
    rows = url_filter.judge(pages, model).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert r["score"] == pytest.approx(plain_difference(parts[r["page_id"]], counts), abs=1e-9)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if parts[r["page_id"]] and r["score"] > model.threshold else "allow")


def test_url_model_carries_verdicts_over(spark):
    """Held-out URLs of the rules are told apart, whichever fifth is held out, and so are labels of any other kind."""
    pages = table(spark, SF.replace("0.001", "0.1"), "pages")
    host, path = url_filter.host_path(F.col("url"))
    for rejected in (url_filter.by_rules(host, path), F.contains(path, F.lit("html"))):
        unseen = F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0
        model = url_filter.fit(pages, F.when(~unseen, rejected))
        truth = {r["page_id"]: r["rejected"] for r in pages.where(unseen).select("page_id", rejected.alias("rejected")).collect()}
        scored = url_filter.scores(pages.select("page_id", F.concat(host, path).alias("text")), model.counts, "page_id").collect()
        right = [(r["score"] > model.threshold) == truth[r["page_id"]] for r in scored if truth.get(r["page_id"]) is not None]
        assert len(right) > 100 and np.mean(right) > 0.95
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(empty, url_filter.fit(empty)).count() == 0


def test_url_counts_grow_with_the_input(spark):
    sizes = [url_filter.fit(table(spark, SF.replace("0.001", s), "pages")).counts.count() for s in ("0.001", "0.01", "0.1")]
    assert sizes[0] < sizes[1] < sizes[2]


def test_url_rules_that_tie(spark):
    """Of equally long rules a block wins, and the longest comes first."""
    rules = (("allow", "a.com", "/x"), ("block", "com", "/x/y"), ("block", "a.com", "/xy"), ("allow", "a.com", "/xy"))
    pages = spark.createDataFrame([("http://a.com/x/y",), ("http://a.com/xyz",), ("http://b.com/x/y",)], "url string")
    host, path = url_filter.host_path(F.col("url"))
    name, verdict = url_filter.rule_for(host, path, rules)
    assert [r[0] for r in pages.select(verdict).collect()] == ["block", "block", "block"]
    assert [r[0] for r in pages.select(name).collect()] == ["com/x/y", "a.com/xy", "com/x/y"]
