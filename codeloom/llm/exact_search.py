"""Exact top-k search: term-at-a-time accumulation over blocks of queries and candidates.

The components of a vector are its terms. A block of candidates is inverted into
one postings list per term; the sparse rows of a block of queries scatter their
weighted postings into dense arrays of scores, one term after the other. Each
pair of blocks gives back the best of its candidates, which are then merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import stored

#: Rows that share a task: candidates and queries of one pair of blocks, in the mean.
CANDIDATES = 8192
QUERIES = 4096
#: Scores that are held at once.
SCORES = 1 << 21

_TYPES = "query_row long, query_id long, vec_id long, score long"


def whole(vector: Column) -> Column:
    """True where a vector holds no null and no entry that is not finite; null and missing vectors are not whole."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): whole vectors, every entry ``floor(scale * x)`` in doubles, at most the largest 64-bit number."""
    entries = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.filter(whole(F.col("embedding"))).select("vec_id", entries.alias("v"))


def _postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """For every term the rows that hold it and their weights; a list without gaps is a slice."""
    owner = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
    term = np.concatenate([np.arange(len(v)) for v in vectors]) if len(owner) else owner
    weight = np.concatenate(vectors) if len(owner) else owner
    held = weight != 0
    owner, term, weight = owner[held], term[held], weight[held]
    order = np.argsort(term, kind="stable")
    owner, term, weight = owner[order], term[order], weight[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else []
    out = {}
    for low, high in zip(first, [*first[1:], len(term)], strict=True):
        rows = owner[low:high]
        out[int(term[low])] = (slice(None) if len(rows) == len(vectors) else rows, weight[low:high])
    return out


def _exact(left: list[np.ndarray], right: list[np.ndarray]) -> type:
    """The numbers that hold every inner product: 64 bits, or Python's where those do not do."""
    most = [max((float(np.abs(v.astype(float)).max()) for v in side if len(v)), default=0.0) for side in (left, right)]
    longest = max((len(v) for v in left), default=0)
    return np.int64 if most[0] * most[1] * longest < 2.0**62 else object


def accumulate(queries: list[np.ndarray], candidates: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first query, scores of some queries with all candidates), parts of bounded size."""
    kind = _exact(queries, candidates)
    postings = {t: (rows, w.astype(kind)) for t, (rows, w) in _postings(candidates).items()}
    step = max(1, SCORES // max(1, len(candidates)))
    for low in range(0, len(queries), step):
        part = queries[low : low + step]
        scores = np.zeros((len(part), len(candidates)), kind)
        for term, (of, weights) in _postings(part).items():
            if term not in postings:
                continue
            rows, values = postings[term]
            weights = weights.astype(kind)
            for q, w in zip(range(len(part)) if isinstance(of, slice) else of, weights, strict=True):
                scores[q, rows] += w * values
        yield low, scores


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties to the smaller place."""
    places = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    # Places ascend, and the sort of the negated scores is stable.
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _searched(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    low, high = -(2**63), 2**63 - 1

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        # One more than asked for, as a query may meet itself.
        candidates = candidates.sort_values(["vec_id", "row"], na_position="last")
        rows, ids = candidates["row"].to_numpy(), candidates["vec_id"].array
        out = []
        for first, scores in accumulate([*map(np.asarray, queries["v"])], [*map(np.asarray, candidates["v"])]):
            for q, line in enumerate(scores, first):
                own = queries["row"].iat[q]
                for at in [p for p in best_of(line, k + 1) if rows[p] != own][:k]:
                    vec_id = ids[at]
                    out.append((own, queries["vec_id"].iat[q], None if pd.isna(vec_id) else int(vec_id), min(max(int(line[at]), low), high)))
        found = pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"])
        return found.astype({"vec_id": "Int64"})

    return search


def top_k(vectors: DataFrame, queries: Column, k: int, scale: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows for every row that ``queries`` holds for.

    ``vectors`` has vec_id and embedding; other columns are not read. Vectors
    count as ``floor(scale * x)``; scores are their inner products in 64 bits,
    beyond which they stop at the largest number. Vectors that are null or hold a
    null or an entry that is not finite take no part; where lengths differ,
    missing entries are zero, and an empty vector scores zero with all. Equal
    scores go to the smaller vec_id, a null one last. Rows are told apart as
    rows: under a repeated vec_id each row is a query and a candidate of its own.
    An empty table gives an empty result.

    Both sides are cut into blocks by a hash, and every pair of blocks meets in
    one task, so memory is bounded by the blocks alone.
    """
    rows = stored(scaled(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.filter(F.coalesce(queries, F.lit(False)))
    blocks = -(-rows.count() // CANDIDATES) or 1
    query_blocks = -(-asked.count() // QUERIES) or 1
    own = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("row", "vec_id", "v", own(query_blocks, 1).alias("q"), every(blocks).alias("c"))
    right = rows.select("row", "vec_id", "v", every(query_blocks).alias("q"), own(blocks, 2).alias("c"))
    met = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(_searched(k), _TYPES)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
