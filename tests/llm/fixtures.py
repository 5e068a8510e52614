"""Small tables with what real ones have: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", size long, target string, doc string, r string, n int, component string, _text string, copy string, text_ string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or")
    out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return ". ".join(" ".join(out[k : k + 9]).capitalize() for k in range(0, words, 9)) + "."


def odd_rows() -> list[tuple]:
    long = prose(1, 60_000)
    base = prose(2, 300)
    near = base.split(" ")
    near[7] = "changed"
    return [
        (1, base, "en", "a", len(base)),
        (2, " ".join(near), "en", "b", len(base)),
        (3, base, "en", "a", len(base)),
        (3, base, "en", "a", len(base)),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, " \t\n\r ", None, "b", 5),
        (7, long, "en", None, len(long)),
        (8, "one two", "de", "c", 7),
        (9, "one two", "de", "c", 7),
        (10, "12345 67890 ... !!", None, "", 18),
        (None, prose(3, 80), "de", "c", None),
        (None, None, None, None, None),
        (11, "über größe naïve 日本語 🙂 \u00a0 <|endoftext|> x", "fr", "a", 40),
        (12, prose(4, 40), "fr", "a\x00", 1),
        (-1, prose(2, 300), "en", "a", 1),
    ]


def odd_docs(spark: SparkSession) -> DataFrame:
    rows = [(*r, 1, "t", "d", "r", 2, "c", "x", "y", "z") for r in odd_rows()]
    return spark.createDataFrame(rows, DOCS + EXTRA)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def docs_of(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], DOCS)
