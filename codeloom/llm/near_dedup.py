"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its five-word shingles under one 64-bit hash. The hash's
residues divide the set into classes, and the smallest hashes of each class are
retained. Inverted lists hold the documents that retain the same hashes in a
class, and only documents in one list become a candidate pair. The sketch of the
union of a pair, from the bottom-k hashes of both, estimates its similarity and
filters; the whole sets confirm. Documents with identical sets are one vertex
throughout, so copies form no pairs.

Where one hash at most can disagree, the lists are those of the set and of the set
without each hash, so no pair is missed. Up to ``CLASSES`` - 1 disagreements whole
classes are retained and there are more than twice as many classes as disagreements
(up to 32), so classes must agree. Beyond, the smallest hashes of 32 classes miss a
pair at the very threshold less than once in a million. Pairs that meet seldom are
looked at last, and only where their ends are still apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shingles import mixed, shingle_set
from codeloom.llm.tables import small_batches, stored, temporary

#: 100 * intersection must reach this many times the union, unless another threshold is given (80 at least).
SIMILAR = 85
CLASSES = 32
#: Hashes retained of a class of large sets, as many as agree in this share of the classes of a pair at the threshold.
AGREEING = 0.37
#: Small sets get more classes while all that a pair shares may fall into the classes that disagree with this chance.
ALL_IN = 1e-6
#: Hashes of the sketch that estimates a pair, and the chance that a pair at the threshold falls below the estimate
#: from which the whole sets are compared.
SKETCH = 96
BELOW = 1e-9
#: Lists up to this length form all their pairs; in longer ones all meet one member, then what is still apart is compared in blocks.
SHORT_LIST = 24
#: One of so many long lists has a member that all others meet.
HEADED = 4
#: Documents and hashes in a block.
BLOCK = 128
BLOCK_HASHES = 500_000
#: Columns of one product of a block with another.
COLUMNS = 1 << 14
#: Bits of the filter that tells most unwanted texts without a shuffle. Past some millions of ids it lets more through.
MARKS = 1 << 25
#: Whole sets that a task holds at once before they leave it.
TOGETHER = 256


@lru_cache(1 << 12)
def _level(n: int, similar: int = SIMILAR) -> tuple[int, int]:
    """(classes, hashes retained in each, 0 for all) of a set of ``n``; no classes if only an identical set can be similar enough, one if a single hash may be left out."""
    apart = (100 - similar) * n // similar
    if apart < 2:
        return apart, 0
    if apart >= CLASSES:
        return CLASSES, int(math.log(AGREEING) / math.log(similar / 100))
    classes = 1 << (2 * apart + 1).bit_length()
    while (apart / classes) ** (apart * similar / (100 - similar)) > ALL_IN:
        classes *= 2
    return min(CLASSES, classes), 0


@lru_cache
def _least_estimate(similar: int) -> float:
    """The estimate that a pair at the threshold falls below with the chance ``BELOW`` at most."""
    p, below = similar / 100, 0.0
    for k in range(SKETCH):
        below += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if below > BELOW:
            return k / SKETCH
    return 1.0


def list_keys(values: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """Keys of the inverted lists of a set: its own level, and the next one where a larger set similar enough has that."""
    n = len(values)
    keys = []
    for classes, kept in dict.fromkeys((_level(n, similar), _level(n * 100 // similar, similar))):
        if not classes:
            continue
        if classes == 1:
            chosen = mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            whole = np.bitwise_xor.reduce(chosen)
            keys.append(mixed(np.r_[whole, whole ^ chosen] ^ mixed(np.full(1, 1 << 16, np.uint64))))
            continue
        residue = (values & np.uint64(classes - 1)).astype(np.int64)
        order = np.argsort(residue, kind="stable")
        sizes = np.bincount(residue, minlength=classes)
        starts = np.cumsum(sizes) - sizes
        rank = np.arange(n) - np.repeat(starts, sizes)
        used = rank < (kept or n)
        chosen, of = mixed(values[order][used] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), residue[order][used]
        first = np.nonzero(np.r_[True, of[1:] != of[:-1]])[0]
        label = np.uint64(classes << 16 | kept << 8) + of[first].astype(np.uint64)
        keys.append(mixed(np.add.reduceat(chosen, first) ^ mixed(label)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _sketched(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, wholes, sketches, keys = [], [], [], []
        for text in batch.column("text"):
            values = shingle_set(text.as_py())
            sizes.append(len(values))
            wholes.append(_digest(values))
            sketches.append((values[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
            keys.append(list_keys(values, similar).view(np.int64))
        ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(wholes, pa.string()), pa.array(sketches, pa.binary()),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            names=["doc_id", "n", "whole", "sketch", "keys"],
        )


def _estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity from two sketches: the share of both among the smallest hashes of the union."""
    union = np.union1d(a, b)[:SKETCH]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(1, len(union))


def _estimated(batches: Iterator[pd.DataFrame], similar: int) -> Iterator[pd.DataFrame]:
    least = _least_estimate(similar)
    for pdf in batches:
        near = [_estimate(np.unique(np.frombuffer(x, "<u4")), np.unique(np.frombuffer(y, "<u4"))) >= least for x, y in zip(pdf.sa, pdf.sb, strict=True)]
        yield pdf.loc[near, ["a", "b"]]


def _confirmed(batches: Iterator[pd.DataFrame], similar: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        good = []
        for x, y in zip(pdf.sa, pdf.sb, strict=True):
            a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * both >= similar * (len(a) + len(b) - both))
        yield pdf.loc[good, ["a", "b"]]


def _digest(values: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(values.tobytes()) if len(values) else None


def _mark(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(MARKS))


def _held(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 6] >> (places & 63)) & 1 == 1


class _Marks:
    """A filter that holds every id it was made of and few others.

    ``MARKS`` bits, whatever the number of ids, go to the driver and to the tasks;
    who uses it joins by the id or by the digest afterwards. Digests are made in
    the same Python worker that tests the bits, so a task needs one.
    """

    def __init__(self, ids: DataFrame):
        place = _mark(ids.columns[0])
        words = ids.select(place.alias("at")).groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("bits"))
        found = words.toArrow()
        bits = np.zeros(MARKS >> 6, np.int64)
        bits[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(bits)

    def hold(self, column: str) -> Column:
        """True for the ids that may be among those of the filter."""
        shared = self.shared

        @F.pandas_udf("boolean")
        def held(at: pd.Series) -> pd.Series:
            return pd.Series(_held(shared.value, at.to_numpy()))

        return held(_mark(column))

    def digest(self, column: str, text: str) -> Column:
        """Digest of the text's set where the id may be in the filter, empty without words; else null."""
        shared = self.shared

        @F.pandas_udf("string")
        def told(at: pd.Series, texts: pd.Series) -> pd.Series:
            held = _held(shared.value, at.to_numpy())
            return pd.Series([(_digest(shingle_set(t)) or "") if h else None for h, t in zip(held, texts, strict=True)], dtype=object)

        return told(_mark(column), F.col(text))

    def sets(self, docs: DataFrame) -> DataFrame:
        """(whole, s): digests and whole sets of the documents whose id may be in the filter."""
        shared = self.shared

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wanted = np.flatnonzero(_held(shared.value, batch.column("at").to_numpy()))
                # A few at a time, since sets are larger than texts.
                for low in range(0, len(wanted), TOGETHER):
                    sets = [shingle_set(batch.column("text")[int(k)].as_py()) for k in wanted[low : low + TOGETHER]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(map(_digest, sets), pa.string()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["whole", "s"]
                    )

        return docs.select(_mark("doc_id").alias("at"), "text").mapInArrow(work, "whole string, s binary")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every one on the right."""
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    _, column, held = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    several = held > 1
    place = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], place[column[keep]]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(several.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        held_by = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        held_by[owner[at], column[at] - low] = 1
        both += held_by[: len(left)] @ held_by[len(left) :].T
    return both


def _between_blocks(batches: Iterator[pa.RecordBatch], similar: int) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of one list whose ends are in different components; those that join nothing new are left out."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            left, right = row["left"], row["right"]
            sets = [[np.frombuffer(x["s"], "<u8") for x in side] for side in (left, right)]
            both = _overlaps(*sets)
            sizes = [np.array([len(s) for s in side], np.float32) for side in sets]
            union = sizes[0][:, None] + sizes[1][None, :] - both
            root: dict[int, int] = {}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, j in np.argwhere(100 * both >= similar * union).tolist():
                x, y = find(left[i]["component"]), find(right[j]["component"])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((left[i]["id"], right[j]["id"]))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _whole_sets(docs: DataFrame, vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): whole sets of the wanted vertices, made again from their texts.

    Only texts whose id is marked are read into sets, so that no other text
    leaves the scan; the digest of the set tells which are wanted.
    """
    wanted = stored(ids.join(vertices.select("id", "whole", "doc_id"), "id"), "wanted")
    sets = _Marks(wanted.select("doc_id")).sets(docs)
    return stored(sets.join(wanted.select("id", "whole"), "whole").select("id", "s"), "sets")


def _sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with the value of both ends as sa and sb."""
    side = lambda name: table.select(F.col("id").alias(name), F.col(value).alias("s" + name))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of a link (a, b): the smallest id that links lead to.

    Every round a vertex goes up to the smallest of itself and its neighbours, and
    on from there as long as it gets higher, in steps that double; then the links
    are drawn between where their ends went, and those within one vertex and
    repeated ones go. At least half of the linked vertices go in a round. Each
    step is written down.
    """
    ends = links.select("a", "b").filter("a <> b")
    edges = stored(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = stored(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while not edges.isEmpty():
        up = stored(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "up")
        while True:
            over = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
            higher = stored(up.join(over, "up"), "higher")
            up = higher.select("a", F.col("top").alias("up"))
            if higher.filter("top < up").isEmpty():
                break
        to = lambda name, new, up=up: up.select(F.col("a").alias(name), F.col("up").alias(new))
        moved = labels.join(to("component", "up"), "component", "left")
        labels = stored(moved.select("id", F.coalesce("up", "component").alias("component")), "labels")
        drawn = edges.join(to("a", "x"), "a").join(to("b", "y"), "b").filter("x <> y")
        edges = stored(drawn.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    return labels


def _meetings(n: Column) -> Column:
    """In how many short lists a pair must meet to be among the first, by the size of the smaller set.

    A pair similar enough shares 12 lists in the mean where there are 32.
    """
    return F.when(n > 90, 3).when(n > 22, 2).otherwise(1)


def _short_pairs(lists: DataFrame, similar: int, apart: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b, low), a row for every meeting in a short list; with ``apart``, of members for which it holds."""
    member = F.struct("id", "n", *[c for c in lists.columns if c not in ("id", "n", "key", "size")])
    short = lists.filter(F.col("size") <= SHORT_LIST).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("m"))
    close = lambda x, y: (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * similar) & (x["id"] != y["id"])
    good = lambda x, y: close(x, y) & apart(x, y) if apart else close(x, y)
    pair = lambda x, y: F.struct(x["id"].alias("a"), y["id"].alias("b"), F.least(x["n"], y["n"]).alias("low"))
    after = F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, F.size("m")), lambda y: good(x, y)), lambda y: pair(x, y)))
    return short.select(F.explode(F.flatten(after)).alias("p")).select("p.*")


def _first_pairs(lists: DataFrame, similar: int) -> DataFrame:
    """Pairs that meet in short lists often enough; of longer lists each member with one of them, another in every list.

    Pairs that meet more seldom are left to :func:`near_duplicates`, pairs that share a long list besides are found there.
    """
    often = _short_pairs(lists, similar).groupBy("a", "b").agg(F.count("*").alias("times"), F.min("low").alias("low"))
    long = lists.filter(F.col("size") > SHORT_LIST)
    # A quarter of the lists by their keys: enough to join most of a family, and what stays apart is compared over all lists.
    long = long.filter(F.pmod("key", F.lit(HEADED)) == 0)
    heads = stored(long.groupBy("key").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", "key")).alias("head")), "heads")
    met = long.join(heads, "key").filter((F.col("id") != F.col("head.id")) & (F.least("n", "head.n") * 100 >= F.greatest("n", "head.n") * similar))
    star = met.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"))
    return stored(often.filter(F.col("times") >= _meetings(F.col("low"))).select("a", "b").union(star).distinct(), "pairs")


def _labelled(lists: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``lists`` with the components of their members in the column ``name``."""
    of = labels.select("id", F.col("component").alias(name))
    return stored(lists.join(of, "id", "left").withColumn(name, F.coalesce(name, "id")), "labelled")


def _apart_links(lists: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links within long lists between members that the first links left in different components.

    Members of a list's largest component are not compared with one another; the
    others meet all members, block by block, and the tasks give back links alone.
    Blocks are bounded in documents and in hashes.
    """
    labelled = lists.filter(F.col("size") > SHORT_LIST)
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("members"), F.sum("n").alias("hashes"))
    split = parts.groupBy("key").agg(
        F.max_by("component", F.struct("members", "component")).alias("largest"), F.count("*").alias("parts"),
        F.greatest(F.ceil(F.sum("members") / BLOCK), F.ceil(F.sum("hashes") / BLOCK_HASHES)).alias("blocks"))
    mixed_lists = stored(split.filter(F.col("parts") > 1), "mixed")
    members = stored(labelled.join(mixed_lists, "key"), "members")
    held = members.join(sets, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    row = F.struct("id", "component", "s")
    blocks = lambda df, name: df.groupBy("key", F.col("block").alias(name + "_block")).agg(F.collect_list(row).alias(name))
    pairs = blocks(held.filter(F.col("component") != F.col("largest")), "left").join(blocks(held, "right"), "key")
    # A row is two blocks, so few at a time.
    return stored(pairs.select("left", "right").mapInArrow(_at(_between_blocks, similar), "a long, b long"), "apart")


def _at(work: Callable, similar: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        return work(batches, similar)

    return run


def _classes(docs: DataFrame, similar: int) -> DataFrame:
    """(doc_id, n, whole, component) of every row: its set's size and digest, and the smallest id of its component."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(read.mapInArrow(_at(_sketched, similar), "doc_id long, n long, whole string, sketch binary, keys array<long>"), "sketched")
    vertices = stored(
        rows.filter(F.col("whole").isNotNull() & F.col("doc_id").isNotNull()).groupBy("whole")
        .agg(F.min(F.struct("doc_id", "n", "sketch", "keys")).alias("v")).select("whole", F.monotonically_increasing_id().alias("id"), "v.*"),
        "vertices",
    )
    lists = vertices.select(F.explode("keys").alias("key"), "id", "n")
    sizes = stored(lists.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > 1), "sizes")
    lists = stored(lists.join(sizes, "key"), "lists")
    estimated = lambda pairs: stored(_sides(pairs, vertices, "sketch").mapInPandas(_at(_estimated, similar), "a long, b long"), "estimated")
    near = estimated(_first_pairs(lists, similar))
    lists = _labelled(lists, components(near), "drawn")
    seldom = _short_pairs(lists, similar, lambda x, y: x["drawn"] != y["drawn"])
    near = near.union(estimated(stored(seldom.select("a", "b").distinct(), "pairs")))
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).union(lists.filter(F.col("size") > SHORT_LIST).select("id"))
    sets = _whole_sets(read, vertices, ends.distinct())
    confirmed = lambda pairs: stored(_sides(pairs, sets, "s").mapInPandas(_at(_confirmed, similar), "a long, b long"), "links")
    links = confirmed(near)
    labels = components(links)
    lists = _labelled(lists, labels, "component")
    parted = _short_pairs(lists, similar, lambda x, y: (x["drawn"] == y["drawn"]) & (x["component"] != y["component"]))
    more = confirmed(estimated(stored(parted.select("a", "b").distinct().join(near, ["a", "b"], "left_anti"), "pairs")))
    more = more.union(_apart_links(lists.drop("drawn"), sets, similar))
    if not more.isEmpty():
        labels = components(links.union(more))
    labelled = stored(vertices.select("whole", "id", "doc_id").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")), "labelled")
    firsts = labelled.groupBy("label").agg(F.min("doc_id").alias("component"))
    classes = labelled.select("whole", "label").join(firsts, "label").select("whole", "component")
    found = rows.select("doc_id", "n", "whole").join(classes, "whole", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n", "whole", component.alias("component"))


def near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Every pair that meets in a list is compared unless its ends are connected
    already. Pairs that meet often are drawn first; of the others those that the
    first estimates leave apart come next, so that all wanted texts are read at
    once, and after the links those that the estimates alone had connected.

    Null and empty texts have no shingles and link with nothing; rows without an
    id are kept and link with nothing. Rows are told apart by their sets: two
    with equal ids and different texts need not be in one component. Texts are
    read whole, however long; columns but doc_id and text are not read. Only the
    result stays in the shared folder.
    """
    with temporary(docs.sparkSession):
        found = stored(_classes(docs, similar), "components", result=True)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """One document of each component, the one with the smallest id, with its own columns and no others.

    Rows go by id and set, so of two texts under one id each is judged on its
    own. Of rows that repeat both, the one whose text sorts first stays. Rows
    without an id or without words all stay. Documents whose id is neither dropped
    nor repeated are not shuffled.
    """
    spark = docs.sparkSession
    with temporary(spark):
        judged = stored(_classes(docs, similar), "classes").filter(F.col("doc_id").isNotNull() & F.col("whole").isNotNull())
        kept = F.col("doc_id") == F.col("component")
        gone = judged.filter(~kept).select("doc_id", "whole", F.lit(False).alias("repeated")).distinct()
        repeated = judged.filter(kept).groupBy("doc_id", "whole").count().filter("count > 1").select("doc_id", "whole", F.lit(True).alias("repeated"))
        special = stored(gone.union(repeated), "special", result=True)
    marks = _Marks(special.select("doc_id"))
    wrapped = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("doc"))
    plain = wrapped.filter(~marks.hold("_id")).select("doc.*")
    judged = wrapped.withColumn("_whole", marks.digest("_id", "doc.text")).filter("_whole IS NOT NULL")
    match = lambda found: (judged["_id"] == found["doc_id"]) & (judged["_whole"] == found["whole"])
    once = judged.join(special, match(special), "left_anti").select("doc.*")
    twice = special.filter("repeated")
    if twice.isEmpty():
        return plain.union(once)
    order = F.struct("doc.text", F.to_json("doc"))
    one = judged.join(twice, match(twice), "left_semi").groupBy("_id", "_whole").agg(F.min_by("doc", order).alias("doc"))
    return plain.union(once).union(one.select("doc.*"))
