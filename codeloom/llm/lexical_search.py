"""Ranked lexical search of many queries at once by what they have in common.

Terms that the same queries ask for always add up together, so they are one
class. In the sequences of classes, commonest first, the neighbours that most
queries share are joined again and again; every joined pair is a node of a graph
without cycles, and each query is a sum of few nodes. A task computes the nodes
for a block of documents once, whichever queries use them, then the queries from
the nodes, and keeps the best documents of each.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import stored, temporary

#: Characters of queries that are searched in one pass; more queries take more passes.
BLOCK_CHARS = 2_000_000
#: Documents whose scores are held at once.
DOCUMENTS = 2048

#: Bytes that part terms, and A-Z, which become a-z. All bytes from 0x80 on belong to terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_TABLE).split(b" ") if text else []


@dataclass(frozen=True)
class Plan:
    """What a block of queries has in common.

    ``vocabulary`` numbers the terms. Node k below ``len(classes)`` is the sum of the
    terms ``classes[k]``; the following nodes are the sums of two earlier ones,
    ``joins``. Query i is the sum of the nodes ``queries[i]``.
    """

    vocabulary: dict[bytes, int]
    classes: list[list[int]]
    joins: list[tuple[int, int]]
    queries: list[list[int]]


def share(wanted: list[list[bytes]]) -> Plan:
    """Mine the term sets that queries share.

    The work grows with the total length of the queries: only neighbours in the
    sequences are counted, and a join changes only the sequences that hold it.
    """
    vocabulary: dict[bytes, int] = {}
    holders: dict[int, list[int]] = defaultdict(list)
    for i, words in enumerate(wanted):
        for word in sorted({w for w in words if w}):
            holders[vocabulary.setdefault(word, len(vocabulary))].append(i)
    together: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for term, of in holders.items():
        together[tuple(of)].append(term)
    order = sorted(together, key=lambda of: (-len(of), of))
    sequences: list[list[int]] = [[] for _ in wanted]
    for k, of in enumerate(order):
        for i in of:
            sequences[i].append(k)
    joins = _joined(sequences, len(order))
    return Plan(vocabulary, [together[of] for of in order], joins, sequences)


def _joined(sequences: list[list[int]], first: int) -> list[tuple[int, int]]:
    """Replace the pair of neighbours that most sequences hold by a new node, until no two hold the same pair."""
    at: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, s in enumerate(sequences):
        for pair in zip(s, s[1:], strict=False):
            at[pair].add(i)
    by_count: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for pair, of in at.items():
        by_count[len(of)].add(pair)

    def moved(pair: tuple[int, int], i: int, add: bool) -> None:
        by_count[len(at[pair])].discard(pair)
        (at[pair].add if add else at[pair].discard)(i)
        by_count[len(at[pair])].add(pair)

    joins: list[tuple[int, int]] = []
    most = max(by_count, default=0)
    while most >= 2:
        if not by_count[most]:
            most -= 1
            continue
        pair = min(by_count[most])
        node = first + len(joins)
        joins.append(pair)
        for i in sorted(at[pair]):
            s = sequences[i]
            for old in zip(s, s[1:], strict=False):
                moved(old, i, False)
            k = next(k for k in range(len(s) - 1) if (s[k], s[k + 1]) == pair)
            s[k : k + 2] = [node]
            for new in zip(s, s[1:], strict=False):
                moved(new, i, True)
    return joins


def _found(vocabulary: dict[bytes, int]) -> Callable:
    """Per document: its length, the numbers of the wanted terms in it and how often they occur."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            sizes, held, times = [], [], []
            for text in batch.column("text"):
                words = terms(text.as_py())
                sizes.append(len(words) - words.count(b""))
                counts = Counter(map(get, words))
                counts.pop(None, None)
                held.append(list(counts.keys()))
                times.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "times"],
            )

    return work


def _ranked(plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> Callable:
    """The best documents of every query, among those of a task."""

    def accumulated(batch: pa.RecordBatch) -> np.ndarray:
        """Scores, a row for each query and a column for each document."""
        m = batch.num_rows
        sizes = batch.column("n").to_pylist()
        long = np.array([100 - 50 + (50 * n * n_docs) // n_terms for n in sizes], np.int64)
        held = batch.column("terms")
        lengths = np.diff(held.offsets.to_numpy())
        of = np.repeat(np.arange(m), lengths)
        term, tf = held.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
        part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * long[of]))
        class_of = np.empty(len(plan.vocabulary), np.int64)
        for c, members in enumerate(plan.classes):
            class_of[members] = c
        nodes = np.zeros((len(plan.classes) + len(plan.joins), m), np.int64)
        np.add.at(nodes, (class_of[term], of), part)
        for node, (a, b) in enumerate(plan.joins, len(plan.classes)):
            np.add(nodes[a], nodes[b], out=nodes[node])
        scores = np.zeros((len(plan.queries), m), np.int64)
        for i, parts in enumerate(plan.queries):
            if parts:
                np.sum(nodes[parts], axis=0, out=scores[i])
        return scores

    def best(ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest scores above zero, equal ones by id."""
        if len(scores) > k:
            least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        else:
            least = 1
        at = np.flatnonzero(scores >= least)
        at = at[np.lexsort((ids[at], -scores[at]))][:k]
        return ids[at], scores[at]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A null id comes after all others.
        last = np.iinfo(np.int64).max
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in plan.queries]
        nulls = False
        for whole in batches:
            for low in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(low, DOCUMENTS)
                nulls = nulls or batch.column("doc_id").null_count > 0
                ids = batch.column("doc_id").fill_null(last).to_numpy()
                for i, line in enumerate(accumulated(batch)):
                    old_ids, old = kept[i]
                    if len(old) == k:
                        # Only what is as good as the last that is kept can take its place.
                        fit = np.flatnonzero(line >= old[-1])
                        if not len(fit):
                            continue
                        kept[i] = best(np.concatenate((old_ids, ids[fit])), np.concatenate((old, line[fit])))
                    else:
                        kept[i] = best(np.concatenate((old_ids, ids)), np.concatenate((old, line)))
        query = np.repeat(np.arange(len(kept), dtype=np.int32), [len(s) for _, s in kept])
        ids = np.concatenate([x for x, _ in kept]) if kept else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, s in kept]) if kept else np.zeros(0, np.int64)
        ids = pa.array(ids, mask=(ids == last) if nulls else None)
        yield pa.RecordBatch.from_arrays([pa.array(query), ids, pa.array(scores)], names=["query", "doc_id", "score"])

    return work


def _weights(found: DataFrame, size: int, n_docs: int) -> np.ndarray:
    """Weight of every term of the vocabulary, by the number of documents that hold it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int32()), "df": pa.array(total[at])})

    held = np.zeros(size, np.int64)
    for row in found.select("terms").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        held[row.term] = row.df
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Queries in blocks of bounded size, one at a time on the driver."""
    wanted = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = wanted.agg(F.sum(F.length("text").cast("long") + 1).alias("chars")).first().chars or 0
    blocks = -(-total // BLOCK_CHARS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for k in range(blocks):
        rows = wanted.filter(block == k).orderBy("item_id", "text").collect()
        yield [(row.item_id, sorted(set(terms(row.text)) - {b""})) for row in rows]


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents above zero for every query.

    ``docs`` has doc_id and text, ``queries`` item_id and text; other columns are
    not read. Null and empty texts have no terms: such documents are counted
    nowhere, such queries find nothing. Texts are read whole. Equal scores go by
    doc_id, a null one last; repeated documents rank one after the other; each row
    of ``queries`` is ranked on its own, also where an item_id is repeated. Empty
    tables give an empty result.

    Queries are taken in blocks of ``BLOCK_CHARS`` characters, each in a pass of its
    own; what is sent to the tasks and kept in one is bounded by a block. Every
    task gives back ``k`` rows for each query, which one window merges.
    """
    spark = docs.sparkSession
    out = None
    for block in _query_blocks(queries):
        with temporary(spark):
            found = _block_search(spark, docs, block, k)
            found = found if found is None else stored(found, "ranked", result=True)
        if found is not None:
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _block_search(spark: SparkSession, docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame | None:
    plan = share([words for _, words in block])
    if not plan.vocabulary:
        return None
    found = stored(docs.select("doc_id", "text").mapInArrow(_found(plan.vocabulary), "doc_id long, n long, terms array<int>, times array<long>"), "found")
    all_of = found.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not all_of.docs:
        return None
    holding = found.filter(F.size("terms") > 0)
    weights = _weights(holding, len(plan.vocabulary), all_of.docs)
    best = holding.mapInArrow(_ranked(plan, weights, all_of.docs, all_of.terms, k), "query int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query int, item_id long")
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
