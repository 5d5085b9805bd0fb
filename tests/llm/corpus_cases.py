"""Documents with every awkward case, shared by the tests of the corpus operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone meadow walks under bright morning while birds carry small letters across".split()


def sentence(seed: int, words: int) -> str:
    chosen = random.Random(seed)
    return " ".join(chosen.choice(WORDS) + str(chosen.randrange(40)) for _ in range(words))


def rows(*documents: tuple) -> list[tuple]:
    """(doc_id, text[, lang[, source]]) as rows of documents."""
    filled = [(*d, *(None, "web", None)[len(d) - 1 :])[:4] if len(d) < 4 else d for d in documents]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in filled]


def documents(spark: SparkSession, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, SCHEMA).repartition(3)


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long_text = sentence(1, 30_000)
    return [
        (1, long_text, "en", "a", 1),
        (2, long_text + " end", "en", "a", 1),
        (3, "", "en", "b", 0),
        (4, None, "fr", "b", None),
        (5, " \t\n", None, None, 3),
        (None, "no id here at all", "en", "a", 4),
        (7, "same words again", "en", None, 4),
        (8, "same  words\nagain", "en", "c", 4),
        (8, "same  words\nagain", "en", "c", 4),
        (9, "été où ça naïve Σίσυφος 漢字 🙂", "fr", "c", 4),
        (10, "x" * 20_000, None, "a", 20_000),
        (11, "1234 5678 !!", "de", "a", 4),
    ]


def clashing(docs: DataFrame, *names: str) -> DataFrame:
    """The documents with more columns, named like those that operators add or use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(f"extra {n}").alias(n) for n in names])
