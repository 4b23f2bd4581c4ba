"""Rows for the tests: odd cases that every operator must take."""

import random

from pyspark.sql import functions as F

LONG = " ".join(f"w{i * 7919 % 60013}" for i in range(60_000))
ODD_TEXTS = [None, "", " \n\t ", "one", "two words", "a b c", LONG, "café \U0001f600 　 naïve", "x" * 5000, "a b c", "A B C", "it's <|endoftext|> 12% $5"]


def odd_documents(spark, extra=()):
    """Documents with nulls in any column, repeated rows and columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "no id here at all", "en", "s1"), (None, None, None, None), *extra]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ("id", "size", "n", "regs", "key", "component", "kept", "copies", "rank", "length", "host", "declared", "_draw", "_kept", "bins", "url")
    return df.withColumns({c: F.lit("clash") for c in clash})


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def prose(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"v{rng.randrange(vocabulary)}" for _ in range(n)]
