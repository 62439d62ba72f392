"""Graph text in splits against the parser of whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from otflow.sources import graph_text as G

texts = st.text(alphabet="ab;;'\"\\(){}[] \n", max_size=80)


def by_pieces(text: str, cuts: list[int]) -> list[str]:
    bounds = [0, *sorted(cuts), len(text)]
    pieces = [text[a:z] for a, z in zip(bounds, bounds[1:])]
    found = {}
    told = G.entries([G.Chunk(p) for p in pieces])
    for k, (piece, entry) in enumerate(zip(pieces, told)):
        for start, whole, part in G.cut(piece, *entry, k == len(pieces) - 1):
            assert not (whole and start in found and found[start])
            found[start] = found.get(start, "") + part
    return [p.strip() for _, p in sorted(found.items()) if p.strip()]


@settings(max_examples=500, deadline=None)
@given(texts, st.lists(st.integers(0, 80), max_size=6))
def test_pieces_give_the_statements_of_the_whole(text, cuts):
    assert by_pieces(text, [min(c, len(text)) for c in cuts]) == G.split(text, ";")


@settings(max_examples=300, deadline=None)
@given(texts)
def test_lexer_equals_the_plain_scan(text):
    assert [k for k, depth in G.lexed(text)[1] if depth <= 0] == [k for k, c, depth in G._scan(text) if c == ";" and depth <= 0]


def export(n: int) -> str:
    rng = random.Random(n)
    lines = []
    for k in range(n):
        text = rng.choice(["plain", "semi;colon", "brace } {", "it\\'s", 'say \\"x\\"', "two\nlines; here", "back\\\\"])
        lines.append(f"MERGE (n:Process {{guid: '{{p{k % (n - 3)}}}', image: '{text}', processId: {k}}});")
        if k % 3 == 0:
            lines.append(f"MATCH (a:Process {{guid: '{{p{k}}}'}}),\n  (b:NetworkService {{guid: '{{s{k % 7}}}', port: 502}})\nCREATE (a)-[:CONNECT_TO {{note: '{text}', sessionPorts: [{k}, {k + 1}]}}]->(b)\n;")
        if k % 11 == 0:
            lines.append("// a comment;\n\n;")
    return "\n".join(lines) + ("" if n % 2 else "\n")


@pytest.mark.parametrize("width", ["100b", "1000b", "128m"])
def test_read_graph_in_splits(spark, tmp_path, width):
    text, other = export(61), export(20)
    (tmp_path / "a.cypher").write_text(text)
    (tmp_path / "b.cypher").write_text(other)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        for path, source in ((tmp_path / "a.cypher", text), (tmp_path, text.rstrip("\n") + "\n" + other)):
            nodes, edges = G.read_graph(spark, str(path))
            want_nodes, want_edges = G.parse(source)
            first = {}
            for n in want_nodes:
                first.setdefault(n["guid"], n)
            got = {r["guid"]: r for r in nodes.collect()}
            assert {g: (r["label"], r["props"]) for g, r in got.items()} == {g: (n["label"], {k: G._text(v) for k, v in n["props"].items()}) for g, n in first.items()}
            order = sorted(got, key=lambda g: got[g]["seq"])
            assert [g for g in order if g.startswith("{p")] == [g for g in first if g.startswith("{p")]
            rows = sorted(edges.collect(), key=lambda r: r["seq"])
            assert [(r["src"], r["dst"], r["rel"], r["props"]) for r in rows] == [(e["src"], e["dst"], e["rel"], {k: G._text(v) for k, v in e["props"].items()}) for e in want_edges]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_graph_text(spark, tmp_path):
    (tmp_path / "none.cypher").write_text("")
    nodes, edges = G.read_graph(spark, str(tmp_path / "none.cypher"))
    assert nodes.count() == edges.count() == 0
