"""Small tables for the tests of the training-data operators."""

import random

from pyspark.sql import functions as F

SF_SMALL = "/root/testdata/sf0.001"
SYLLABLES = "ba ke lo mi nu ra se ti vo za chi dre fla gno pli".split()


def prose(seed: int, words: int, per_line: int = 12) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(out[i:i + per_line]) for i in range(0, words, per_line))


#: names that the operators use inside
CLASHES = ["id", "t", "key", "rank", "root", "n", "g", "words", "spans", "gone", "lines", "row", "own", "r", "score", "removed_lines", "bucket", "part", "file"]


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, repeated rows, copies."""
    base = prose(1, 120)
    return [
        (1, base), (2, None), (3, ""), (4, " \n\t\n"), (None, prose(2, 80)), (None, None), (5, base), (5, base),
        (6, prose(3, 60_000, 2000)), (7, "x" * 300_000), (8, "one two"), (9, "\n".join([prose(4, 12)] * 40)),
        (10, base + "\n" + prose(5, 90)), (11, "Ünï çödé — “quotes” 数据 <|endoftext|> it's!"), (12, "12345 !!"),
    ]


def edges(spark):
    """The edge rows as documents, with extra columns of clashing names."""
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in edge_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit(c) for c in CLASHES})


def empty(spark, columns="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], columns)
