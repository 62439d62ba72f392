"""Running sums, the prefix trie and the mix, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from otflow.llm import mixing, prefix_trie
from otflow.llm.running import running_sums
from tests.llm.helpers import clashing, documents, frame

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_running_sums_equal_a_loop(spark, partitions):
    rng = random.Random(int(partitions))
    rows = [(rng.choice(["a", "a", "a", "", None, "b"]), rng.randint(0, 9), k, rng.choice([1, -5, 1 << 62, (1 << 63) - 1, -(1 << 63)])) for k in range(500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    found = running_sums(spark.createDataFrame(rows, "g string, o long, k long, v long").repartition(3), "g", ["o", "k"], ["v"], "test").collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(rows)
    wrapped = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    got = {r["k"]: (r["v_before"], r["v_upto"]) for r in found}
    for g in {r[0] for r in rows}:
        total = 0
        for _, _, k, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]):
            assert got[k] == (wrapped(total), wrapped(total + v))
            total += v


def plain_trie(rows):
    """Every node by the contract's words, with nested loops."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {tuple(ts[:d]) for ts in built.values() for d in range(len(ts) + 1)}
    found = {}
    inside = {n: sorted(c for c, ts in built.items() if tuple(ts[: len(n)]) == n) for n in nodes}
    children = Counter(n[:-1] for n in nodes if n)
    for n in nodes:
        under = [m for m in nodes if m[: len(n)] == n]
        ends = [c for c in inside[n] if len(built[c]) == len(n)]
        saved = sum((len(inside[m]) - 1) * (len(m[-1][1].encode().split()) if m else 0) for m in under)
        parent = inside[n[:-1]][0] if n else None
        found[inside[n][0], len(n)] = (parent, len(inside[n]), children[n], sum(not children[m] for m in under), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return found


def trie(spark, rows):
    found = prefix_trie.prefix_trie(clashing(spark.createDataFrame(rows, TURNS))).collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in found}
    assert len(got) == len(found)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_nested_loops(spark, seed):
    rng = random.Random(seed)
    said = ["hi", "hello  there", "", None, "a b c", "x\x0by"]
    rows = []
    for c in range(-25, 66):
        if c % 20 == 0 and rng.random() < 0.4:
            continue
        rows += [(c, rng.choice([None, t, t, 1]), rng.choice(["user", "user", None, ""]), rng.choice(said)) for t in range(rng.choice([1, 1, 2, 3, 6, 11]))]
    rows += rows[:7] + [(None, 1, "user", "no one's")]
    rng.shuffle(rows)
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_a_long_and_of_many_equal_conversations(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(600)] + [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(5)]
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    bare = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "gone") for c in bare]
    got = trie(spark, rows)
    assert got == plain_trie(rows)
    assert got[bare[0], 0][5] == hashlib.sha256(",".join(map(str, bare)).encode()).hexdigest()


def plain_targets(sizes, weights=(1, 2, 3), limit=3):
    """Targets by rounds, as fractions."""
    from fractions import Fraction

    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    heft = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, whole, open_ = {}, Fraction(sum(sizes.values())), set(sizes)
    while open_:
        level = whole / sum(heft[s] for s in open_)
        over = {s for s in open_ if level * heft[s] >= limit * sizes[s]}
        if not over:
            target.update({s: level * heft[s] for s in open_})
            break
        target.update({s: Fraction(limit * sizes[s]) for s in over})
        whole -= sum(limit * sizes[s] for s in over)
        open_ -= over
    return target


def check_mix(docs, found):
    sizes = Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len((t or "").encode().split())
    target = plain_targets(sizes)
    assert sum(target.values()) == sum(sizes.values())
    # By id and size, as ids repeat.
    source = {(d, len((t or "").encode().split())): s for d, t, _, s, _ in docs}
    taken, largest = Counter(), Counter()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((d, len((t or "").encode().split())) for d, t, *_ in docs)
    for r in found:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(float(target[s]))
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
        if target[s] == 3 * sizes[s]:
            assert taken[s] == target[s]


@pytest.mark.parametrize("seed", range(3))
def test_mix_comes_near_its_targets(spark, seed):
    rng = random.Random(seed)
    names = ["hot", "é", "z", "Z", "", None, "tiny", "empty"]
    docs = [(k, "w " * (0 if s == "empty" else rng.choice([0, 1, 3, 40, 200])), "en", s, None) for k in range(900) for s in [rng.choice(["hot"] * 9 + names)]]
    docs += [(None, "null id", "en", "tiny", None), (3, None, "en", "tiny", None), (3, None, "en", "tiny", None)]
    df = frame(spark, docs)
    found = mixing.mix(clashing(df)).collect()
    check_mix(docs, found)
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))
    other = mixing.mix(df, seed="other").collect()
    check_mix(docs, other)
    assert Counter(map(tuple, other)) != Counter(map(tuple, found))


def test_mix_of_documents_and_of_empty_tables(spark):
    docs = documents()
    check_mix(docs, mixing.mix(frame(spark, docs)).collect())
    assert mixing.mix(frame(spark, [])).count() == 0
    wordless = [(1, None, "en", "a", None), (2, " ", "en", None, None)]
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(frame(spark, wordless)).collect()] == [(0, 0.0, 0)] * 2


def test_copies_of_one_size_stay_whole_at_many_documents():
    """Sums of 2**40 units wrap at 64 bits; the copies between two sums don't."""
    step, offset, mask = (3 << 40) // 7, 12345, (1 << 62) - 1
    at = np.array([5_000_000_000 * step % (1 << 64)], np.uint64)
    before, upto = int(at[0]), (int(at[0]) + step) % (1 << 64)
    copies = ((upto & mask) + offset >> 40) - ((before & mask) + offset >> 40) & (1 << 22) - 1
    assert copies == (5_000_000_001 * step + offset >> 40) - (5_000_000_000 * step + offset >> 40)


def test_mixed_documents_are_those_of_the_mix(spark):
    docs = [(k % 40, f"{'w ' * (k % 9)}{k}", "en", "ab"[k % 5 == 0], k) for k in range(300)]
    df = clashing(frame(spark, docs)).withColumn("copies", frame(spark, docs).doc_id * 0 + 1) if False else clashing(frame(spark, docs))
    whole = mixing.mixed(df)
    assert whole.columns == df.columns
    rows = whole.collect()
    assert len({r["text"] for r in rows}) > 50
    times = Counter((r["doc_id"], r["text"]) for r in rows)
    assert max(times.values()) <= 3
    found = mixing.mix(df).collect()
    assert sum(r["copies"] for r in found) == len(rows)
    by_id = Counter()
    for r in found:
        by_id[r["doc_id"], r["size"]] += r["copies"]
    assert +by_id == Counter((r["doc_id"], len(r["text"].split())) for r in rows)
