"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DATA = "/root/testdata"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def documents(spark, rows, extra=True):
    """rows: (doc_id, text) or (doc_id, text, source); with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        df = df.selectExpr("*", "1 AS id", "'x' AS comp", "2 AS n", "3 AS row", "4 AS key", "5 AS size", "6 AS score", "7 AS part", "8 AS base", "9 AS a")
    return df


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "é😀"), (6, text(6)), (6, text(6)), (7, text(6)), (8, "x" * 5000), (9, "word " * 30000), (None, "no id"), (10, "a b c d"), (11, "A B C D")]
