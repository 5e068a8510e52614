"""Toxicity scores from a learned lexicon, matched with misspellings, and the words around each match.

Terms that tell toxic texts from others are learned as whole words and as
stems. A word is run as a Levenshtein automaton through the trie of the terms.
Around each match a window tells quotation from abuse, and a logistic model over
these counts gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Learning takes at most so many labelled rows, chosen by a hash of their ids.
LEARN_ROWS = 6_000
#: A term is in this many toxic texts of the sample, and in this share of them, and its log odds reach the bound.
LEAST_TEXTS = 5
LEAST_SHARE = 0.02
LEAST_ODDS = 2.5
#: The strongest terms make the lexicon.
TERMS = 2_000
STEM = (4, 8)
#: One edit is allowed in words of at least this length.
FUZZY_LENGTH = 5
AROUND = 6
KEPT_WORDS = 400_000

QUOTING = frozenset("said says called calls wrote quote quoted quotes word words term phrase alleged so-called dijo dit sagte nannte wort mot palabra".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dein deine tu te tes toi vous votre usted tú eres".split())
MARKS = "\"'“”„‘’«»"
_EDGES = ".,;:!?()[]{}<>…*_`-" + MARKS
FEATURES = 7
_WORD = r"[\p{L}\p{N}@$*]+"


@dataclass
class Lexicon:
    """Terms with weights; a stem ends in ``*``. ``trie`` maps a node's letters to nodes, ``ends`` a node to (weight, is stem)."""

    terms: dict[str, float]
    trie: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, list[tuple[float, bool]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for term, weight in self.terms.items():
            node = 0
            for letter in term.removesuffix("*"):
                if letter not in self.trie[node]:
                    self.trie[node][letter] = len(self.trie)
                    self.trie.append({})
                node = self.trie[node][letter]
            self.ends.setdefault(node, []).append((weight, term.endswith("*")))

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term for a word.

        Bit i of a state says that i letters of the word are read, without edits
        in one state and with one in the other. A stem matches without edits,
        whatever follows it.
        """
        size = len(word)
        at: dict[str, int] = {}
        for i, letter in enumerate(word):
            at[letter] = at.get(letter, 0) | 1 << i
        all_bits, whole = (1 << size + 1) - 1, 1 << size
        best: tuple[float, int] | None = None
        todo = [(0, 1, 3 & all_bits if size >= FUZZY_LENGTH else 0)]
        while todo:
            node, exact, edited = todo.pop()
            for letter, child in self.trie[node].items():
                mask = at.get(letter, 0)
                exact1 = (exact & mask) << 1
                edited1 = 0
                if size >= FUZZY_LENGTH:
                    edited1 = ((edited & mask) << 1 | exact | exact << 1 | exact1 << 1) & all_bits
                if not exact1 | edited1:
                    continue
                for weight, stem in self.ends.get(child, ()):
                    edits = 0 if (exact1 if stem else exact1 & whole) else 1 if not stem and edited1 & whole else None
                    if edits is not None and (best is None or (edits, -weight) < (best[1], -best[0])):
                        best = (weight, edits)
                if self.trie[child]:
                    todo.append((child, exact1, edited1))
        return best


class _Known(dict):
    """What a word as it stands in the text matches; most match nothing."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[float, int] | None:
        core = word.strip(_EDGES).lower()
        found = self.lexicon.match(core) if core else None
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


def features(text: str | None, known: _Known) -> list[float]:
    """Counts that the score is made of: exact and misspelled matches, those quoted, those addressed to the reader,
    the densest window, the share of words, and the summed weights."""
    words = text.split() if text else []
    hits = [(i, m) for i, m in enumerate(map(known.__getitem__, words)) if m]
    if not hits:
        return [0.0] * FEATURES
    exact = fuzzy = quoted = addressed = weight = 0.0
    for i, (w, edits) in hits:
        around = words[max(0, i - AROUND) : i] + words[i + 1 : i + 1 + AROUND]
        bare = {x.strip(_EDGES).lower() for x in around}
        if words[i][0] in MARKS or words[i].rstrip(".,;:!?")[-1:] in MARKS and len(words[i]) > 1 or bare & QUOTING:
            quoted += 1
        elif edits:
            fuzzy += 1
        else:
            exact += 1
            weight += w
        addressed += bool(bare & ADDRESS)
    places = np.array([i for i, _ in hits])
    dense = int((np.searchsorted(places, places + 4 * AROUND, side="right") - np.arange(len(places))).max())
    return [float(x) for x in np.log1p([exact, fuzzy, quoted, addressed, dense, 100 * len(hits) / len(words), weight])]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = self.weights[0] + rows @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; the first weight is the intercept."""
    x = np.hstack([np.ones((len(rows), 1)), rows])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are kept for testing."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Lexicon from (text, toxic). Terms are counted by text; a word that a stem covers as well is left out."""
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    toxic, clean = int(totals.toxic or 0), int((totals.n or 0) - (totals.toxic or 0))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))
    stems = lambda w: F.transform(
        F.filter(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda k: k < F.length(w)), lambda k: F.concat(F.substring(w, 1, k), F.lit("*")))
    terms = sample.select("toxic", words.alias("w")).select("toxic", F.explode(F.array_distinct(F.concat("w", F.flatten(F.transform("w", stems))))).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    least = max(LEAST_TEXTS, LEAST_SHARE * toxic)
    odds = lambda part, whole: F.log((part + 0.5) / (F.lit(float(whole)) - part + 0.5))
    weight = odds(F.col("t"), toxic) - odds(F.col("n") - F.col("t"), clean)
    strong = counted.filter(F.col("t") >= least).withColumn("weight", weight).filter(F.col("weight") >= LEAST_ODDS)
    kept: dict[str, float] = {}
    for row in sorted(strong.orderBy(F.desc("weight"), "term").limit(TERMS).collect(), key=lambda r: (len(r.term.rstrip("*")), r.term.endswith("*"), r.term)):
        bare = row.term.removesuffix("*")
        covering = [kept[f"{bare[:k]}*"] for k in range(STEM[0], len(bare) + 1) if f"{bare[:k]}*" in kept]
        if not covering or max(covering) < row.weight - 1.0:
            kept[row.term] = float(row.weight)
    return Lexicon(kept)


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> ToxicityModel:
    """Learn from a bounded sample of labelled rows outside the test part."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = usable.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(rows)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    sample = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    lexicon = learn_lexicon(sample)
    seen = sample.select("toxic", _extractor(docs, lexicon)("text").alias("x")).collect()
    if len({r.toxic for r in seen}) < 2:
        return ToxicityModel(lexicon, np.array([-30.0] + [0.0] * FEATURES))
    order = sorted((r.toxic, tuple(r.x)) for r in seen)
    return ToxicityModel(lexicon, fit(np.array([x for _, x in order]), np.array([y for y, _ in order], float)))


def _extractor(docs: DataFrame, lexicon: Lexicon):
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Known(shared.value)
        for texts in batches:
            yield pd.Series([features(t, known) for t in texts])

    return extract


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    Null and empty texts get the score of a text without any match. If the labels
    have no two kinds, all scores are next to 0. Equal texts get equal scores.
    """
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Known(shared.value.lexicon)
        for texts in batches:
            rows = np.array([features(t, known) for t in texts]).reshape(-1, FEATURES)
            yield pd.Series(shared.value.scores(rows))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
