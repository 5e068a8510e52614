"""Finding secrets in texts: three fixed patterns and a battery of randomness tests.

Everything is a column expression. Long runs of key characters that no pattern
covers are tested for randomness: chi-squared uniformity over the alphabet of
the encoding they seem to be in, runs of character classes, and serial
correlation. A string must look random under all three, and unlike words and
identifiers; how unlike is a p-value, and a false-discovery rate over the whole
corpus, within bands of length, decides which ones are reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import stored

#: Fixed values, from the contract. Kinds in the order that breaks ties.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole run, so 20 characters or more
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery: runs of key characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_="
CLASSES = "c" * 10 + "a" * 26 + "b" * 26 + "d" * 5
#: (pattern, letters of the alphabet, chance that two characters of ordinary text in it agree).
ENCODINGS = (
    (r"^[0-9]+$", 10, 0.16),
    (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.12),
    (r"^[A-Z2-7]+$", 32, 0.08),
    (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 36, 0.08),
    (r"^[0-9A-Za-z+/]+$", 64, 0.07),
    (r"", 66, 0.07),
)
#: Chance that neighbours in words and identifiers are of different classes.
CLASS_CHANGE = 0.2
#: A test under which the string is not random, in standard deviations.
VETO = 3.1
#: Share of false discoveries allowed.
FALSE_RATE = 0.001
#: p-values are kept in tenths of a power of ten down to this power.
SMALLEST = 30

_FOUND = "array<struct<start:int,end:int,match:string>>"


def _located(text: Column, pattern: str) -> Column:
    """Start, end and text of the matches, leftmost first, from the lengths of matches and of what lies between."""
    empty = F.array().cast(_FOUND)

    def placed(both: Column) -> Column:
        start = lambda acc, i: acc["at"] + F.length(F.get(both["between"], i))
        step = lambda acc, i: F.struct(
            (start(acc, i) + F.length(F.get(both["found"], i))).alias("at"),
            F.array_append(acc["out"], F.struct(
                start(acc, i).alias("start"), (start(acc, i) + F.length(F.get(both["found"], i))).alias("end"),
                F.get(both["found"], i).alias("match"),
            )).cast(_FOUND).alias("out"),
        )
        begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(both["found"]) - 1), begin, step, lambda acc: acc["out"])

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern).alias("between")
    )
    # The one-element array computes the two lists once for all uses.
    return F.when(text.rlike(pattern), F.get(F.transform(F.array(both), placed), F.lit(0))).otherwise(empty)


def _battery(s: Column) -> Column:
    """(p, length) of a candidate; p is 1 where a test rules randomness out.

    p is the chance of as few agreeing characters and as many changes of class in
    ordinary text, from the two standard scores together.
    """
    core = F.when(F.rtrim(s, F.lit("=")) != "", F.rtrim(s, F.lit("="))).otherwise(s)

    def scores(x: Column) -> Column:
        n = x["n"].cast("double")
        pairs = n * (n - 1) / 2
        alike = (x["squares"] - n) / 2
        chi = x["letters"] / n * x["squares"] - n
        free = x["letters"] - 1.0
        uniform = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        usual = x["alike"] * pairs
        few = (usual - alike) / F.sqrt(1.5 * usual)
        changed = (x["runs"] - 1 - CLASS_CHANGE * (n - 1)) / F.sqrt(CLASS_CHANGE * (1 - CLASS_CHANGE) * (n - 1))
        mean = x["sum"] / n
        spread = x["sum2"] - n * mean * mean
        serial = (x["next"] - mean * (2 * x["sum"] - x["first"] - x["last"]) + (n - 1) * mean * mean) / spread
        drift = F.when(spread > 0, F.abs(serial + 1 / n) * F.sqrt(n)).otherwise(F.lit(VETO + 1))
        z = (few + changed) / math.sqrt(2)
        return F.struct(F.when((F.abs(uniform) > VETO) | (drift > VETO), F.lit(1.0)).otherwise(_tail(z)).alias("p"), x["n"].alias("n"))

    def sums(x: Column) -> Column:
        word, chars, places = x["word"], x["chars"], x["places"]
        total = lambda values, f=lambda v: v: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))
        count = lambda c: (F.length(word) - F.length(F.replace(word, c, F.lit("")))).cast("double")
        letters = alike = None
        for pattern, k, same in reversed(ENCODINGS):
            letters = F.lit(float(k)) if letters is None else F.when(word.rlike(pattern), F.lit(float(k))).otherwise(letters)
            alike = F.lit(same) if alike is None else F.when(word.rlike(pattern), F.lit(same)).otherwise(alike)
        return F.struct(
            F.length(word).alias("n"), letters.alias("letters"), alike.alias("alike"),
            total(F.array_distinct(chars), lambda c: count(c) * count(c)).alias("squares"),
            F.regexp_count(F.translate(word, ALPHABET, CLASSES), F.lit("a+|b+|c+|d+")).cast("double").alias("runs"),
            total(places).alias("sum"), total(places, lambda v: v * v).alias("sum2"),
            total(F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: a * F.coalesce(b, F.lit(0.0)))).alias("next"),
            F.element_at(places, 1).alias("first"), F.element_at(places, -1).alias("last"),
        )

    split = lambda w: F.struct(w.alias("word"), F.split(w, "").alias("chars"))
    place = lambda x: F.struct(
        x["word"].alias("word"), x["chars"].alias("chars"),
        F.transform(x["chars"], lambda c: F.instr(F.lit(ALPHABET), c).cast("double")).alias("places"),
    )
    # Each step hands its values on in a one-element array, so that none is computed twice.
    chain = F.transform(F.array(core), split)
    for step in (place, sums, scores):
        chain = F.transform(chain, step)
    return F.get(chain, F.lit(0))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by the usual polynomial (five terms, error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _band(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def _step(p: Column) -> Column:
    """p in tenths of a power of ten, rounded up to the larger p."""
    return F.floor(-10 * F.log10(F.greatest(p, F.lit(10.0**-SMALLEST)))).cast("int")


def _base(text: Column) -> list[Column]:
    long_enough = lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= ASSIGN_LEAST
    return [F.filter(_located(text, ASSIGN), long_enough), _located(text, ACCESS), _located(text, HEX)]


def _scanned(docs: DataFrame, *carried: Column | str) -> DataFrame:
    """``carried``, the base spans by kind, and the tested candidates outside of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*carried, text.alias("_text"))
    for kind, spans in zip(KINDS, [*_base(F.col("_text")), _located(F.col("_text"), CANDIDATE)], strict=True):
        rows = rows.withColumn(f"_{kind}", spans)
    apart = lambda c: ~F.exists(F.concat("_assign", "_access", "_hex"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    tested = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _battery(c["match"]).alias("t"))
    judged = rows.withColumn("_tested", F.transform(F.filter("_random", apart), tested))
    return judged.drop("_text", "_random")


def _limits(scanned: DataFrame, rate: float) -> DataFrame:
    """(band, least): within a band of length, candidates of this step of p and beyond are reported.

    The step-up rule over counts per step: the largest p at which p times all
    candidates of the band is within ``rate`` times those found. The counts are
    gathered where the candidates are; bands and steps are few by construction.
    """
    counts = (
        scanned.select(F.explode("_tested.t").alias("t"))
        .groupBy(_band(F.col("t.n")).alias("band"), _step(F.col("t.p")).alias("step"))
        .count()
    )
    band = Window.partitionBy("band")
    found = counts.select(
        "band", "step",
        F.sum("count").over(band.orderBy(F.col("step").desc())).alias("found"), F.sum("count").over(band).alias("all"),
    )
    enough = F.pow(F.lit(10.0), -F.col("step") / 10) * F.col("all") <= rate * F.col("found")
    return found.filter(enough & (F.col("step") > 0)).groupBy("band").agg(F.min("step").alias("least"))


def _reported(scanned: DataFrame, rate: float) -> DataFrame:
    """Replace ``_tested`` by ``_random``, the candidates within the limits."""
    # At most a row for each band, and there are fewer than 64.
    limits = {r.band: r.least for r in _limits(scanned, rate).collect()}
    def within(c: Column) -> Column:
        reached = F.lit(False)
        for band, step in sorted(limits.items()):
            reached = F.when(_band(c["t"]["n"]) == band, _step(c["t"]["p"]) >= step).otherwise(reached)
        return reached

    return scanned.withColumn("_random", F.filter("_tested", within)).drop("_tested")


def _all_spans(kinds: tuple[str, ...]) -> Column:
    """Spans of the kinds by start, then kind."""
    def part(k: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda c: F.struct(
            c["start"].alias("start"), F.lit(k).alias("k"), c["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.sort_array(F.concat(*[part(k, kind) for k, kind in enumerate(kinds)]))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


def find_secrets(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of ``docs``.

    Positions count code points, ends are exclusive. Null and empty texts have no
    spans. Texts are read once; what was found is written down before the limits
    of the battery are drawn from it. Equal rows get equal spans.
    """
    scanned = stored(_scanned(docs, "doc_id"), "secrets")
    return _reported(scanned, rate).select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_written(_all_spans(KINDS[:3])).cast("binary"), 256).alias("base_sha256"),
        _written(_all_spans(KINDS)).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[secret]", rate: float = FALSE_RATE) -> DataFrame:
    """``docs`` with every secret replaced by ``mark`` and ``n_chars``, where there is one, made to fit.

    No document goes. Overlapping spans are replaced as one. Other columns pass
    through, whatever their names.
    """
    scanned = stored(_scanned(docs, F.struct("*").alias("doc")), "redacted")
    text = F.col("doc.text")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, c: F.when(
        c["start"] >= acc["at"],
        F.struct(c["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), F.lit(mark))).alias("out")),
    ).otherwise(F.struct(F.greatest(acc["at"], c["end"]).alias("at"), acc["out"].alias("out")))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    marked = _reported(scanned, rate).withColumn("_spans", _all_spans(KINDS)).withColumn(
        "_new", F.when(F.size("_spans") == 0, text).otherwise(F.aggregate("_spans", begin, step, rest))
    )
    of = {"text": F.col("_new"), "n_chars": F.when(F.size("_spans") == 0, F.col("doc.n_chars")).otherwise(F.length("_new")).cast("long") if "n_chars" in docs.columns else None}
    return marked.select(*[(F.col(f"doc.`{c}`") if of.get(c) is None else of[c]).alias(c) for c in docs.columns])
