"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders in benchmark items and
documents alike. Windows of template words meet by hash. A window with the item's
own values counts always; where values are changed, names must map one to one
from item to document, and a window with a name that does not is left out, so that
a question with other numbers or names is caught, and a chance likeness of
templates is not. Numbers and units may change each by itself: equal ones need not
stay equal, nor different ones different.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shingles import mixed

WINDOW = 8
#: A document holds an item if it has this share of its windows, or so many of them.
SHARE = 0.5
MANY = 13
#: At least so many words of a window must be more than placeholders.
LITERALS = 4
#: Items are broadcast in blocks of about so many characters; each block is one pass over the documents.
BLOCK_CHARS = 16_000_000
#: Word forms a worker keeps at hand.
KEPT_WORDS = 100_000

UNITS = frozenset("""
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres
mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml cl l liter liters litre litres
gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years
cent cents dollar dollars euro euros percent degree degrees km/h mph kmh w kw mw v volt volts watt watts hz khz mhz ghz kb mb gb tb
""".split())
NUMBERS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty
thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter dozen
""".split())
_NUMBER = re.compile(r"[+\-−]?[$€£]?\d[\d.,:/]*(?:%|[a-zA-Z]{0,3})")
_EDGES = ".,;:!?\"'()[]{}<>…“”‘’«»*_`"
_ENDS = re.compile(r"[.!?…:][\"'”’»)\]]*$")
LITERAL, NUMBER, UNIT, NAME = range(4)
#: What a placeholder counts as in a window's hash.
_TYPES = np.array([0, 0x1D8AF066AE0B73C1, 0x2F6E1A3B5C4D7E89, 0x3C79AC492BA7B653], np.uint64)


class _Forms(dict):
    """A word's literal hash, with its type in bits 2 and 3, a capital in bit 0 and a sentence end in bit 1."""

    def __missing__(self, word: str) -> int:
        core = word.strip(_EDGES) or word
        low = core.lower()
        kind = NUMBER if _NUMBER.fullmatch(core) or low in NUMBERS else UNIT if low in UNITS else LITERAL
        value = xxhash.xxh64_intdigest(low.encode("utf-8", "replace")) & ~15
        value |= core[0].isupper() | bool(_ENDS.search(word)) << 1 | kind << 2
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


_FORMS = _Forms()


@dataclass
class Template:
    words: list[str]
    value: np.ndarray
    kind: np.ndarray

    def windows(self, width: int) -> np.ndarray:
        n = len(self.words) - width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        shown = np.where(self.kind == LITERAL, self.value, _TYPES[self.kind])
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + shown[k : k + n])
        return out

    def telling(self, width: int) -> np.ndarray:
        """Whether each window has enough literal words."""
        total = np.concatenate([[0], np.cumsum(self.kind == LITERAL)])
        return total[width:] - total[:-width] >= min(LITERALS, width)


def template(text: str | None) -> Template:
    """Words of a text with their types; a capital inside a sentence makes a name."""
    words = text.split() if text else []
    forms = np.fromiter(map(_FORMS.__getitem__, words), np.uint64, len(words))
    kind = ((forms >> np.uint64(2)) & np.uint64(3)).astype(np.int64)
    ends = (forms & np.uint64(2)) > 0
    inside = np.concatenate([[False], ~ends[:-1]]) if len(words) else ends
    kind = np.where((kind == LITERAL) & ((forms & np.uint64(1)) > 0) & inside, NAME, kind)
    return Template(words, forms >> np.uint64(4), kind)


class ItemIndex:
    """Windows of a block of items, for lookup inside tasks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(item_id, template(text)) for item_id, text in items if text and text.split()]
        at: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        self.count = []
        for k, (_, t) in enumerate(self.items):
            width = min(WINDOW, len(t.words))
            good = np.nonzero(t.telling(width))[0]
            hashes = t.windows(width)[good].tolist()
            self.count.append(len(hashes))
            for place, h in zip(good.tolist(), hashes, strict=True):
                at[width][h].append((k, place))
        self.at = {width: dict(found) for width, found in at.items()}
        # A bit per hash tells most windows of a document apart from all of these at once.
        self.maybe = {}
        for width, found in self.at.items():
            bits = max(16, int(len(found) * 16).bit_length())
            table = np.zeros(1 << bits, bool)
            table[(np.fromiter(found, np.uint64, len(found)) & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.maybe[width] = table

    def matches(self, text: str | None) -> list[tuple[int, int, float, int, int]]:
        """(item, windows, share, slots, changed slots) of every item that the text holds."""
        if not text or not self.items:
            return []
        t = template(text)
        met: dict[tuple[int, int], set[int]] = defaultdict(set)
        for width, found in self.at.items():
            h = t.windows(width)
            table = self.maybe[width]
            for i in np.nonzero(table[(h & np.uint64(len(table) - 1)).astype(np.int64)])[0].tolist():
                for k, place in found.get(int(h[i]), ()):
                    met[k, i - place].add(place)
        out: dict[int, tuple[set, int, int]] = {}
        for (k, shift), places in met.items():
            item, width = self.items[k][1], min(WINDOW, len(self.items[k][1].words))
            at = {place + j for place in places for j in range(width) if item.kind[place + j] != LITERAL}
            pairs = {a: (item.words[a].strip(_EDGES).lower(), t.words[a + shift].strip(_EDGES).lower()) for a in at}
            names = {p for a, p in pairs.items() if item.kind[a] == NAME and p[0] != p[1]}
            old, new = Counter(x for x, _ in names), Counter(y for _, y in names)
            clash = {a for a, p in pairs.items() if p in names and (old[p[0]] > 1 or new[p[1]] > 1)}
            if clash:
                places = [place for place in places if clash.isdisjoint(range(place, place + width))]
                at = {a for place in places for a in range(place, place + width) if a in pairs}
            seen, all_slots, changed = out.get(k, (set(), 0, 0))
            out[k] = (seen | set(places), all_slots + len(at), changed + len({pairs[a] for a in at if pairs[a][0] != pairs[a][1]}))
        return [
            (self.items[k][0], len(seen), len(seen) / self.count[k], slots, changed)
            for k, (seen, slots, changed) in sorted(out.items())
            if len(seen) >= min(MANY, SHARE * self.count[k])
        ]


def _blocks(benchmark: DataFrame) -> list[ItemIndex]:
    """Indexes of all items, in blocks whose size is bounded whatever the size of the benchmark."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-chars // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    return [ItemIndex(sorted((r.item_id, r.text) for r in items.filter(block == k).collect() if r.item_id is not None)) for k in range(count)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, share, slots, changed): a row for each item that a document holds.

    Documents without an item have no row. Null and empty texts and items match
    nothing, nor do items without an id. Items shorter than a window are one window;
    items with fewer literal words than a window must have match nothing. Repeated
    rows give repeated rows.
    """
    schema = "doc_id long, item_id long, windows long, share double, slots long, changed long"

    def scan(index: ItemIndex) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, t in enumerate(batch.column("text")) for m in shared.value.matches(t.as_py())]
                at, *columns = zip(*rows, strict=True) if rows else [()] * 6
                ids = batch.column("doc_id").take(pa.array(at, pa.int32()))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                arrays = [ids.cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "windows", "share", "slots", "changed"])

        return docs.select("doc_id", "text").mapInArrow(found, schema)

    first, *others = map(scan, _blocks(benchmark))
    for other in others:
        first = first.unionAll(other)
    return first


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item, with their own columns and no others."""

    def clean(index: ItemIndex) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([not shared.value.matches(t) for t in texts], dtype=bool)

        return free(F.col("text"))

    for index in _blocks(benchmark):
        docs = docs.filter(clean(index))
    return docs
