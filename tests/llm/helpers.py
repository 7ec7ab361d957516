"""Small tables with the awkward cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, schema=SCHEMA):
    """Rows as a table that was read from Parquet."""
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(str(folder))
    return spark.read.parquet(str(folder))


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, len(text or ""))


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward(rng: random.Random) -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    long_text = words(rng, 3000)
    return [
        row(1, "one two three"),
        row(2, "one two three"),
        row(2, "one two three"),
        row(3, None),
        row(4, ""),
        row(5, " \n\t "),
        row(6, long_text),
        row(7, long_text, None),
        (None, "one two three", None, None, None),
        (None, None, None, None, None),
        row(8, "x" * 50_000),
        row(9, "é \x1c ü ß  <|endoftext|> don't 12"),
    ]
