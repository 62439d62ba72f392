"""The audit of filters against plain Python."""

import itertools
import re
from collections import Counter

import pytest

from otflow.llm import filter_audit
from tests.llm.helpers import clashing, documents, frame

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    """Apply each order of the filters document by document."""
    smallest = {}
    for d, t, *_ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    rows = []
    for d, t, _, s, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and d > smallest[t] else set()
        good, toxic = (d is not None and any(i == d and v[k] == 1 for i, *v in labels) for k in (0, 1))
        rows.append((s or "", fails, good, toxic))
    found, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left, removed = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[part, f] += len(here)
                found[part, order, step] = [len(left), len(here), sum(f in r[1] for r in removed), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in here), sum(r[3] for r in here)]
                removed += here
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def audit(spark, docs, labels):
    found = filter_audit.audit(clashing(frame(spark, docs)), spark.createDataFrame(labels, LABELS)).collect()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in found}
    assert len(got) == len(found)
    return got


def corpus():
    sources = ["a", "b", "", None]
    docs = [(d, t, lang, sources[k % 4], n) for k, (d, t, lang, _, n) in enumerate(documents())]
    long = " ".join(f"w{k}" for k in range(60))
    shouts = " ".join(f"ABC{k}" for k in range(60))
    again = "so it goes " * 30
    for k in range(40):  # a hot text in every part, ids falling and repeated
        docs.append((500 - k // 2, long, "en", sources[k % 3], None))
    docs += [(600 + k, t, "en", sources[k % 4], None) for k, t in enumerate([shouts, again, shouts + " #", again + "$ X", "50% off", "a|b", long + " &", "é" * 90, long.upper() + "*"])]
    docs += [(None, long, "en", "a", None), (None, "50% off", "en", None, None), docs[0], docs[0], (7000, docs[3][1], "en", "c", None)]
    return docs


def test_audit_equals_plain_filters(spark):
    docs = corpus()
    labels = [(d, k % 2, k % 3 == 0) for k, d in enumerate(sorted({d for d, *_ in docs if d is not None})) if k % 5]
    labels = [(d, q, int(t)) for d, q, t in labels] + [(500, 1, None), (500, 0, 1), (None, 1, 1), (490, None, None)]
    assert audit(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    assert audit(spark, [], []) == {}
    assert audit(spark, corpus()[:9], []) == plain_audit(corpus()[:9], [])


@pytest.mark.parametrize("held", [1, 1 << 26])
def test_chains_don_t_depend_on_what_a_task_holds(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    docs = corpus()
    ids = Counter(r["doc_id"] for r in filter_audit.repeats(frame(spark, docs).repartition(5)).collect())
    smallest = {}
    for d, t, *_ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    assert ids == Counter(d for d, t, *_ in docs if d is not None and d > smallest[t or ""])


def test_texts_of_one_fingerprint_are_told_apart():
    chains = filter_audit.Chains()
    assert chains.admit(1, b"x", 5, 0, {"a": 1}) is None
    assert chains.admit(1, b"y", 6, 0, {"a": 1}) is None
    assert chains.admit(1, b"x", 7, 0, {"b": 2}) == (7, 0, {"b": 2})
    assert chains.admit(1, b"y", 2, 0, {"c": 1}) == (6, 0, {"a": 1})
    assert chains.admit(1, b"y", 2, 0, {"c": 1, "d": 1}) is None
    assert sorted((f, e[0], e[1], e[3]) for f, e in chains.drain()) == [(1, b"x", 5, {"a": 1}), (1, b"y", 2, {"c": 2, "d": 1})]


def test_other_filters(spark):
    docs = [(k, "ab"[k % 2] * (k + 1), "en", None, None) for k in range(6)]
    found = filter_audit.audit(frame(spark, docs), spark.createDataFrame([], LABELS), {"X": lambda raw, points, words: points > 3}).collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in found} == {("XE", 1): (3, 3, 6), ("XE", 2): (3, 0, 0), ("EX", 1): (6, 0, 0), ("EX", 2): (3, 3, 6)}
    with pytest.raises(ValueError):
        filter_audit.audit(frame(spark, docs), spark.createDataFrame([], LABELS), {"E": lambda raw, points, words: True})
