"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of variable order with its own counts; a byte
not seen in a context escapes to the next shorter one. The counts are frozen
after learning, so the code lengths of what was seen in a context, and of the
escape from it, are worked out once; scoring adds them up along the way from the
longest known context to the one that has the byte. A text goes to the language
that codes it in the fewest bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import small_batches

#: Learning takes at most so many labelled texts of a language, chosen by a hash of their ids, and so many characters of each,
LEARN_TEXTS = 300
LEARN_CHARS = 20_000
#: so many texts of all languages together, and the commonest languages up to this number.
LEARN_ALL = 6_000
LANGUAGES = 256
#: A context is a node of the trees once a single language has seen it so often, however rare that language is.
LEAST_SEEN = 4
ORDER = 3
#: Bytes scored in one piece; longer texts are scored piece by piece with their context.
PIECE = 1 << 16
#: Contexts whose chances are worked out at once.
TOGETHER = 4096
UNKNOWN = "und"
RESULT = "lang_pred string, score double, bits_per_byte double"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    """Context trees of all languages, their nodes shared.

    ``child`` leads from a context shorter than ``ORDER`` to the one longer by the byte before it, -1 if that is not
    known. ``near`` tells the row of a byte in such a context, ``far`` has the bytes seen in the longest contexts
    (node * 256 + byte, sorted), whose rows end ``bits``. A row holds the byte's code length in each language,
    ``escape`` what each language pays for leaving a context.
    """

    languages: list[str]
    child: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bits: np.ndarray
    escape: np.ndarray

    def lengths(self, text: str) -> np.ndarray:
        """Bits that each language takes to code the text."""
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        total = np.zeros(len(self.languages))
        inner, first_far = len(self.child), len(self.bits) - len(self.far)
        for low in range(0, len(raw), PIECE):
            begin = max(0, low - ORDER)
            piece = raw[begin : low + PIECE].astype(np.int64)
            size, skip = len(piece) - (low - begin), low - begin
            s = piece[skip:]
            nodes = [np.zeros(size, np.int64)]
            for order in range(1, ORDER + 1):
                at, found = np.arange(size) + skip - order, np.full(size, -1, np.int64)
                known = (at >= 0) & (nodes[-1] >= 0)
                found[known] = self.child[nodes[-1][known], piece[at[known]]]
                nodes.append(found)
            left = np.arange(size)
            for node in reversed(nodes):
                at = node[left]
                known = at >= 0
                where, at = left[known], at[known]
                row = np.full(len(where), -1, np.int64)
                short = at < inner
                row[short] = self.near[at[short], s[where[short]]]
                gram = at[~short] * 256 + s[where[~short]]
                place = np.searchsorted(self.far, gram)
                hit = np.append(self.far, -1)[place] == gram
                row[~short] = np.where(hit, first_far + place, -1)
                seen = row >= 0
                total += self.bits[row[seen]].sum(axis=0, dtype=np.float64) + self.escape[at[~seen]].sum(axis=0, dtype=np.float64)
                left = np.concatenate([left[~known], where[~seen]])
        return total

    def score(self, text: str | None) -> tuple[str, float, float]:
        """(language, share of the evidence for it, bits per byte)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        total = self.lengths(text)
        best = int(np.argmin(total))
        share = 1.0 / np.exp2(-np.minimum(total - total[best], 1000.0)).sum()
        return self.languages[best], float(share), float(total[best] / len(text.encode("utf-8", "replace")))


def _with_escapes(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Chances of the symbols in contexts (rows), from counts and the chances in the next shorter context.

    An unseen symbol takes its part of the escape chance (method C), what was seen
    being excluded from the shorter context.
    """
    seen = counts > 0
    kinds = seen.sum(axis=1, keepdims=True)
    total = counts.sum(axis=1, keepdims=True)
    left = np.where(seen, 0.0, shorter)
    rest = left.sum(axis=1, keepdims=True)
    escape = np.where(rest > 0, kinds, 0)
    found = counts / np.maximum(total + escape, 1)
    unseen = left * (escape / np.maximum(total + escape, 1) / np.maximum(rest, 1e-300))
    return np.where(total > 0, np.where(seen, found, unseen), shorter)


def _contexts(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every context of ``order`` bytes in the texts, the nearest byte lowest, and the byte after it."""
    found, after = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for raw in texts:
        t = raw.astype(np.int64)
        if len(t) > order:
            found.append(sum((t[order - k : len(t) - k] << 8 * (k - 1) for k in range(1, order + 1)), np.zeros(len(t) - order, np.int64)))
            after.append(t[order:])
    return np.concatenate(found), np.concatenate(after)


def fit(samples: dict[str, list[str]]) -> LanguageModel:
    """Learn from texts by language."""
    languages = sorted(samples)
    width = len(languages)
    raw = [[np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8) for t in samples[lang]] for lang in languages]
    known, first = [np.zeros(1, np.int64)], [0, 1]
    for order in range(1, ORDER + 1):
        codes = [np.zeros(0, np.int64)]
        for texts in raw:
            code, times = np.unique(_contexts(texts, order)[0], return_counts=True)
            codes.append(code[times >= LEAST_SEEN])
        known.append(np.unique(np.concatenate(codes)))
        first.append(first[-1] + len(known[-1]))
    inner = first[ORDER]
    # What a context ends in is known as well, since it was seen at least as often.
    parents = [np.searchsorted(known[k - 1], known[k] & ((1 << 8 * (k - 1)) - 1)) for k in range(1, ORDER + 1)]
    child = np.full((inner, 256), -1, np.int32)
    for k, parent in enumerate(parents, 1):
        child[first[k - 1] + parent, known[k] >> 8 * (k - 1)] = first[k] + np.arange(len(known[k]))
    grams, rows, escape = [], [], np.zeros((first[-1], width), np.float32)
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for order in range(ORDER + 1):
        counted.append([])
        for texts in raw:
            context, after = _contexts(texts, order)
            place = np.searchsorted(known[order], context)
            good = np.append(known[order], -1)[place] == context
            counted[order].append(np.unique(place[good] * 256 + after[good], return_counts=True))
        # Without any context every byte has a row, so the way down always ends.
        seen = np.arange(256) if order == 0 else np.unique(np.concatenate([np.zeros(0, np.int64)] + [cells for cells, _ in counted[order]]))
        grams.append(seen)
        rows.append(np.zeros((len(seen), width), np.float32))
    for column in range(width):
        shorter = np.full((1, 256), 1.0 / 256)
        for order in range(ORDER + 1):
            cells, times = counted[order][column]
            size, kept = len(known[order]), []
            for low in range(0, size, TOGETHER):
                high = min(size, low + TOGETHER)
                counts = np.zeros((high - low, 256))
                mine = slice(*np.searchsorted(cells, (low * 256, high * 256)))
                counts.reshape(-1)[cells[mine] - low * 256] = times[mine]
                below = shorter if order == 0 else shorter[parents[order - 1][low:high]]
                chances = _with_escapes(counts, below)
                told = slice(*np.searchsorted(grams[order], (low * 256, high * 256)))
                rows[order][told, column] = -np.log2(np.maximum(chances.reshape(-1)[grams[order][told] - low * 256], 1e-30))
                # What a language has not seen costs the same more than in the shorter context, whatever the byte.
                unseen = np.argmax(np.where(counts > 0, -1.0, below), axis=1)
                line = np.arange(high - low)
                ratio = np.maximum(chances[line, unseen], 1e-30) / np.maximum(below[line, unseen], 1e-30)
                escape[first[order] + low : first[order] + high, column] = -np.log2(ratio)
                if order < ORDER:
                    kept.append(chances)
            shorter = np.concatenate(kept) if kept else np.zeros((0, 256))
    near, far = np.full((inner, 256), -1, np.int32), np.zeros(0, np.int64)
    at = 0
    for order, seen in enumerate(grams):
        if order < ORDER:
            near[first[order] + (seen >> 8), seen & 255] = at + np.arange(len(seen))
        else:
            far = first[order] * 256 + seen
        at += len(seen)
    return LanguageModel(languages, child, near, far, np.concatenate(rows), escape)


def learn(docs: DataFrame, texts: int = LEARN_TEXTS, chars: int = LEARN_CHARS) -> LanguageModel:
    """Learn from (doc_id, text, lang): rows with a language and a text, but those kept for testing.

    The sample is bounded by ``texts`` a language, ``LEARN_ALL`` in all and
    ``chars`` a text. Ids are picked first, by hash, so only the picked texts are
    read in full, and the picked ids, being so few, are broadcast to the scan;
    where ids repeat, the rows are picked once more.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out_part(4) != 2)).select("lang", "doc_id", "text")
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = [r["lang"] for r in common]
    if not languages:
        return fit({})
    each = max(1, min(texts, LEARN_ALL // len(languages)))
    usable = usable.filter(F.col("lang").isin(languages))
    ids = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = usable.select("lang", "doc_id").withColumn("place", F.row_number().over(ids)).filter(F.col("place") <= each)
    picked = picked.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id")).distinct()
    match = (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    found = usable.join(F.broadcast(picked), match, "left_semi").select("lang", "doc_id", F.substring("text", 1, chars).alias("text"))
    rows = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = found.withColumn("place", F.row_number().over(rows)).filter(F.col("place") <= each).select("lang", "place", "text").collect()
    by_language: dict[str, list[str]] = {lang: [] for lang in languages}
    for row in sorted(sample, key=lambda r: (r.lang, r.place)):
        by_language[row.lang].append(row.text)
    return fit(by_language)


def held_out_part(parts: int) -> Column:
    """Remainder of the checksum of the id, as text; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def identifier(docs: DataFrame, model: LanguageModel):
    """A column function from text to (lang_pred, score, bits_per_byte)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            yield pd.DataFrame([model.score(t) for t in texts], columns=["lang_pred", "score", "bits_per_byte"])

    return identify


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs``.

    Null texts and those without a letter are ``und`` with score 0, as is every
    text if there was nothing to learn from. Ties go to the language first by code
    point. Equal texts get equal results.
    """
    found = docs.select("doc_id", (held_out_part(4) == 2).alias("held_out"), identifier(docs, learn(docs))("text").alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score")


def keep_identified(docs: DataFrame, least_score: float = 0.5, most_bits: float = 8.0) -> DataFrame:
    """``docs`` without those in no learned language.

    Rejected are texts that are null or have no letter, whose best language has
    less than ``least_score`` of the evidence, or takes ``most_bits`` a byte, as
    many as no model at all. The columns are those of ``docs``.
    """
    judged = docs.select(F.struct("*").alias("doc"), identifier(docs, learn(docs))("text").alias("r"))
    known = (F.col("r.lang_pred") != UNKNOWN) & (F.col("r.score") >= least_score) & (F.col("r.bits_per_byte") < most_bits)
    return judged.filter(known).select("doc.*")
