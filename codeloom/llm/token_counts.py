"""Token counts of whole texts under a byte-level BPE vocabulary.

Tokens never cross pre-tokens, so a text's count is the sum over its pre-tokens.
A table of the corpus's frequent pre-tokens and their lengths is broadcast; the
others are encoded once per worker and kept there. No pre-token is shuffled.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The table is drawn from so many texts, picked by a hash of their ids, and so many characters of each. It bears on
#: speed alone: a pre-token that is not in it is encoded where it comes up.
SAMPLE_TEXTS = 2_000
SAMPLE_CHARS = 20_000
FREQUENT = 32_768
#: Lengths a worker keeps; beyond, it starts again from the table. Longer pre-tokens are not kept.
KEPT = 150_000
#: Pre-tokens in one call of the library, whose results are far larger than their lengths.
AT_ONCE = 2_000
KEPT_LENGTH = 64
LIMIT = 512

# The vocabulary's pre-tokens, spelled out for characters whose kinds all Unicode versions agree on:
# ASCII, Latin letters and signs, general punctuation. Texts with others go to the library whole.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGIT = "0-9²³¹¼-¾"
_SPACE = "\\t\\n\\r "
_OTHER = re.compile("[^\\t\\n\\r -~¡-ɏ‐-‧€]")
_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


class _Lengths(dict):
    """Tokens in a pre-token; what is missing is encoded."""

    def __init__(self, vocabulary: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel part
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.frequent = frequent
        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")

    def add(self, pieces: set[str]) -> None:
        """Encode pieces and keep their lengths."""
        if len(self) + len(pieces) > KEPT + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        missing = list(pieces)
        for at in range(0, len(missing), AT_ONCE):
            some = missing[at : at + AT_ONCE]
            for piece, encoded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self[piece] = len(encoded)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of texts; an added token inside a text is one token and parts it.

        A few texts are cut at a time, so that their unknown pre-tokens are encoded
        together.
        """
        out: list[int] = []
        for group in _groups(texts):
            cut: list[list[str] | None] = []
            extra = []
            for text in group:
                plain = not text or not _OTHER.search(text)
                parts = self.special.split(text) if text and plain else []
                cut.append([piece for part in parts for piece in _PIECE.findall(part)] if plain else None)
                extra.append(max(0, len(parts) - 1) if plain else len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]))
            short = {piece for pieces in cut if pieces for piece in pieces if len(piece) <= KEPT_LENGTH}
            self.add({piece for piece in short if piece not in self})
            for pieces, n in zip(cut, extra, strict=True):
                out.append(n + sum(map(self.__getitem__, pieces or ())))
        return out

    def __missing__(self, piece: str) -> int:
        """A long pre-token, or one that fell out: encoded and not kept."""
        return len(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0])


def _groups(texts: list[str | None], chars: int = 100_000) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters together."""
    group: list[str | None] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


_WORKER: dict[str, _Lengths] = {}


def frequent_lengths(docs: DataFrame, vocabulary: str) -> dict[str, int]:
    """Lengths of the commonest pre-tokens of a bounded sample."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_TEXTS).distinct()
    texts = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    counts: Counter[str] = Counter()
    for (text,) in texts.select("text").limit(SAMPLE_TEXTS).collect():
        counts.update(_PIECE.findall(text or ""))
    lengths = _Lengths(vocabulary, {})
    common = [piece for piece, _ in counts.most_common(FREQUENT) if len(piece) <= KEPT_LENGTH]
    lengths.add(set(common))
    return {piece: lengths[piece] for piece in common}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    ``vocabulary`` is the path of a ``tokenizers`` file with byte-level
    pre-tokens, the same on all machines. Null texts count as empty ones, with no
    tokens. Nothing is cut off, padded or added.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if vocabulary not in _WORKER:
            _WORKER[vocabulary] = _Lengths(vocabulary, frequent.value)
        for texts in batches:
            yield pd.Series(_WORKER[vocabulary].counts(list(texts)), dtype="int64")

    sized = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return sized.withColumn("over_limit", F.col("n_tokens") > limit)
