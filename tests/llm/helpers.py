"""Small made-up documents and what the tests of the corpus operators share."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = ["ka", "to", "mi", "re", "su", "no", "lé", "ßu", "pha"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    """Plain texts, copies, near copies, shared passages, empty, null, tied and very long rows."""
    rows = [(k, words(k, 20 + 13 * k % 150)) for k in range(1, 25)]
    base = words(3, 20 + 39)
    passage = words(900, 30)
    rows += [
        (30, base), (31, base.replace(" ", "\n\n")), (32, " " + base + " "), (33, base),
        (40, words(41, 300)), (41, words(41, 300) + " extra"), (42, words(42, 60) + " " + passage), (43, passage + " " + words(43, 60)),
        (44, "x" + passage[:49]), (45, "y" + passage[:50]), (46, "z" + passage[:51]),
        (50, ""), (51, None), (52, " \t\n"), (53, "one"), (54, "one two"), (55, "One TWO"),
        (60, words(60, 6000)), (61, "ab" * 40_000), (62, "ab" * 300), (None, words(5, 40)), (5, words(5, 20 + 65)),
    ]
    return [(d, t, "en", "src", None) for d, t in rows]


def frame(spark, rows=None, schema: str = COLUMNS):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """The same rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("fp", "key", "gid", "doc", "at", "n", "size", "best", "seed", "root", "node", "tokens", "_dropped", "part"):
        df = df.withColumn(name, F.lit("clash"))
    return df
