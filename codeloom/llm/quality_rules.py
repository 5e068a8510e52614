"""Line-first cleaning and document quality, in column expressions.

Every line is judged by itself; lines that fail are taken out, and a document
that loses too much of its text that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.tables import WORD

SPACES = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: A line of prose ends a sentence, closing quotes and brackets apart.
SENTENCE_END = r"[.!?:;…。！？][\"')\]”’»]*[\x20\x09-\x0D]*$"
#: Shouting: marks repeated.
REPEATED_MARK = r"[!?]{2,}"
#: Separators of menus and tables.
SEPARATOR = r"[|>»›•·]+"
#: What a line must have for any of the three shares to count.
MARKED = r"[#*$%&|<>»›•·]|[!?]{2}"
BOILERPLATE = (
    "licensed under", "licenced under", "all rights reserved", "copyright", "©", "use cookies", "accept cookies", "cookie policy",
    "privacy policy", "terms of use", "terms of service", "lorem ipsum", "enable javascript", "subscribe to", "sign up for",
    "click here", "share on facebook", "share on twitter", "powered by",
)
#: Boilerplate lines are short; a paragraph that quotes one stays.
BOILERPLATE_WORDS = 30
#: Marks, separators and symbols in one line, in hundredths of its words.
REPEATED_MARK_SHARE = 25
SEPARATOR_SHARE = 20
SYMBOL_SHARE = 50
#: A document must keep this share of its word characters, in hundredths.
KEPT_SHARE = 50


def _boilerplate(text: Column) -> Column:
    lower = F.lower(text)
    found = F.contains(lower, F.lit(BOILERPLATE[0]))
    for phrase in BOILERPLATE[1:]:
        found = found | F.contains(lower, F.lit(phrase))
    return found


def stayers(text: Column, lines: Column) -> Column:
    """The lines with words that pass the punctuation, navigation and boilerplate rules.

    Most texts have no mark and no phrase that the costly rules count; they are
    told at once, over the whole text, and their lines need only end a sentence.
    """
    within = lambda line, pattern, words, share: F.regexp_count(line, F.lit(pattern)) * 100 <= words * share

    def stays(x: Column) -> Column:
        line, words = x["line"], x["words"]
        return (
            within(line, REPEATED_MARK, words, REPEATED_MARK_SHARE)
            & within(line, SYMBOL, words, SYMBOL_SHARE)
            & within(line, SEPARATOR, words, SEPARATOR_SHARE)
            & ~((words <= BOILERPLATE_WORDS) & _boilerplate(line))
        )

    ended = F.filter(lines, lambda line: line.rlike(SENTENCE_END))
    counted = F.transform(ended, lambda line: F.struct(line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("words")))
    return F.when(text.rlike(MARKED) | _boilerplate(text), F.filter(counted, stays)["line"]).otherwise(ended)


def _repeat_words(df: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside three-word windows that the text has twice or more.

    Windows are sorted by hash with their places; equal neighbours are repeats.
    Their places, in order, cover up to three words each, less where they overlap.
    All of it stays inside the row. Windows are told apart by 64-bit hashes.
    """
    window = lambda i: F.struct(
        F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")
    )
    spots = F.when(F.size("words") >= 4, F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))
    ordered = df.withColumn("windows", F.sort_array(spots))
    h = lambda i: F.get(F.col("windows"), i)["h"]
    again = F.transform("windows", lambda x, i: F.when((h(i - 1) == x["h"]) | (h(i + 1) == x["h"]), x["i"]))
    places = ordered.withColumn("places", F.sort_array(F.array_compact(again))).drop("windows")
    gaps = F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)
    return places.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars, base_failed, kept).

    ``clean_text`` holds the lines that stay, in order; ``kept_chars`` their word
    characters. A null text is treated as the empty one, which fails. One row for
    each row of ``docs``; equal rows get equal results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.split("text", "\n").alias("lines")
    )
    with_word = F.filter("lines", lambda line: line.rlike(WORD))
    counted = _repeat_words(read.withColumn("with_word", with_word)).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("with_word") - F.size(F.array_distinct("with_word"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array_join(stayers(F.col("text"), F.col("with_word")), "\n").alias("clean_text"),
    )
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    kept_chars = F.length(F.regexp_replace("clean_text", SPACES, "")).cast("long")
    judged = counted.withColumn("kept_chars", kept_chars).withColumn("base_failed", base_failed)
    enough = F.col("kept_chars") * 100 >= F.col("word_chars") * KEPT_SHARE
    return judged.withColumn("kept", ~F.col("base_failed") & enough)
