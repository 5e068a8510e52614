"""Whitening, exact search and lexical search against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import exact_search, lexical_search, queries, whitening
from codeloom.llm.qd_svd import right_vectors, squared_singular_values
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
EXTRA = ", row long, x string, q int, c int, v string, n int, rank int"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows):
    floats = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, "v", 5, 6) for i, v in floats], VECTORS + EXTRA)


def odd_vectors():
    rng = random.Random(3)
    plain = [(k, [rng.gauss(0, 0.3) for _ in range(6)]) for k in range(-60, 140)]
    tied = [(200 + k, [0.5, 0.25, 0, 0, 0, 0]) for k in range(20)]
    odd = [(300, None), (350, [1.0, None, 0, 0, 0, 0]), (400, [NAN] * 6), (450, [INF, 0, 0, 0, 0, 0]), (None, [0.1] * 6), (None, None), (500, [0.0] * 6)]
    return plain + tied + odd + [plain[10], (50, [0.2] * 6), plain[110], plain[110]]


# Whitening


def spectrum(kind, rng):
    x = rng.standard_normal((200, 24))
    if kind == "graded":
        return x * 10.0 ** (-np.arange(24) / 3)
    if kind == "twins":
        return np.concatenate((x[:, :12], x[:, :12]), axis=1)
    if kind == "gap in the columns":
        x[:, [3, 9]] = 0
    if kind == "cluster":
        return np.diag(np.r_[np.full(8, 3.0), np.full(8, 3 + 1e-12), np.linspace(1, 2, 8)]) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    if kind == "identity":
        return np.eye(24)
    return x


@pytest.mark.parametrize("kind", ["plain", "graded", "twins", "gap in the columns", "cluster", "identity"])
def test_qd_solver(kind):
    r = np.linalg.qr(spectrum(kind, np.random.default_rng(5)), mode="r")
    values, vectors = right_vectors(r, 16)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-10, atol=1e-15 * want[0])
    gram = r.T @ r
    assert np.abs(gram @ vectors - vectors * values[: vectors.shape[1]]).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-11
    assert vectors.shape[1] == (12 if kind == "twins" else 16)


def test_small_singular_values_keep_their_digits():
    a, b = 10.0 ** -np.arange(0, 24, 2), 10.0 ** -np.arange(1, 23, 2) / 7
    values = squared_singular_values(a, b)
    # The product of the squares is the square of the determinant, to full accuracy.
    assert math.isclose(np.prod(values), np.prod(a**2), rel_tol=1e-12)


def plain_whitening(rows, k=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(col) for col in zip(*fit, strict=True)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = defaultdict(list)
    for i, x in kept:
        off = [n * a - s for a, s in zip(x, sums, strict=True)]
        z = np.array([o / n for o in off]) @ vectors / np.sqrt(values)
        out[i].append((n, sum(o * o for o in off), z[:k], values[:k] / values.sum()))
    return out


def check_whitening(got, want, k):
    by_row = defaultdict(list)
    for r in got:
        by_row[r.vec_id].append(r)
    assert by_row.keys() == want.keys()
    signs = {}
    for i, rows in by_row.items():
        assert len(rows) == k * len(want[i])
        for r in rows:
            n, deviation, z, explained = min(want[i], key=lambda w: abs(w[1] - r.deviation))
            assert (r.n, r.deviation) == (n, deviation)
            assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-8)
            assert math.isclose(abs(r.whitened), abs(z[r.component - 1]), rel_tol=1e-6, abs_tol=1e-6)
            if abs(z[r.component - 1]) > 1e-3:
                assert signs.setdefault(r.component, np.sign(r.whitened * z[r.component - 1])) == np.sign(r.whitened * z[r.component - 1])
            assert r.identity_error < 1e-9
    assert {r.component for r in got} == set(range(1, k + 1))


def test_whitening_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whitening(spark, SF).collect(), plain_whitening(rows), 16)


def test_whitening_of_odd_vectors(spark):
    rows = odd_vectors()
    check_whitening(whitening.whiten(vectors_of(spark, rows).repartition(40)).collect(), plain_whitening(rows), 6)


def test_whitening_where_nothing_varies(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.whiten(vectors_of(spark, rows)).collect() == []
    flat = whitening.whiten(vectors_of(spark, [(k, [float(k), 5.0, float(-k)]) for k in range(9)])).collect()
    assert {r.component for r in flat} == {1} and math.isclose(flat[0].explained, 1.0)


def test_whitening_of_huge_and_short_entries(spark):
    found = whitening.whiten(vectors_of(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0]), (4, [])])).collect()
    assert {r.vec_id for r in found} == {1, 2, 3, 4} and all(math.isfinite(r.whitened) for r in found)
    assert {r.deviation for r in found if r.vec_id in (1, 2)} == {None}


def test_triangles_of_many_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.standard_normal(5).tolist()) for k in range(400)]
    check_whitening(whitening.whiten(vectors_of(spark, rows).repartition(36)).collect(), plain_whitening(rows), 5)


# Exact search


def plain_search(rows, k=5):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = Counter()
    for a, (i, q) in enumerate(kept):
        if i is None or i % 50:
            continue
        others = [(-max(min(sum(x * y for x, y in zip(q, v, strict=False)), 2**63 - 1), -(2**63)), j is None, j or 0) for b, (j, v) in enumerate(kept) if b != a]
        out.update((i, rank, None if null else j, -s) for rank, (s, null, j) in enumerate(sorted(others)[:k], 1))
    return out


def searched(df):
    return Counter(tuple(r) for r in exact_search.top_k(df, F.col("vec_id") % 50 == 0, 5, 256).collect())


@pytest.mark.parametrize("blocks", [(8192, 4096), (100, 4)])
def test_exact_search_of_odd_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(exact_search, "CANDIDATES", blocks[0])
    monkeypatch.setattr(exact_search, "QUERIES", blocks[1])
    rows = odd_vectors()
    assert searched(vectors_of(spark, rows)) == plain_search(rows)


def test_exact_search_of_few_none_and_ragged(spark):
    for rows in ([], [(1, [1.0])], [(0, [1.0])], [(0, None), (50, [NAN])], [(0, []), (50, []), (100, [1.0, -2.0]), (3, [0.0, 5.0, 1.0])],
                 [(0, [3e38, 1.0]), (50, [3e38]), (100, [-3e38, 4.0]), (7, [1.0, 1.0])]):
        clipped = [(i, None if v is None else [max(min(c, 2.0**63 / 256), -(2.0**63) / 256) if c is not None and math.isfinite(c) else c for c in v]) for i, v in rows]
        if any(abs(c) > 1e30 for _, v in rows for c in v or ()):
            assert len(searched(vectors_of(spark, rows))) == 9
            continue
        assert searched(vectors_of(spark, rows)) == plain_search(clipped)


def test_accumulation_is_the_product():
    rng = np.random.default_rng(4)
    sides = [[np.where(rng.random(9) < 0.4, 0, rng.integers(-50, 50, 9)) for _ in range(n)] for n in (30, 70)]
    got = np.concatenate([s for _, s in exact_search.accumulate(*sides)])
    assert (got == np.array(sides[0]) @ np.array(sides[1]).T).all()
    assert exact_search.best_of(np.array([1, 5, 5, 0, 5]), 2).tolist() == [1, 2]


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_lexical(docs, items, k=50):
    words = [(d, plain_terms(t)) for d, t in docs]
    n_docs, n_terms = sum(1 for _, w in words if w), sum(len(w) for _, w in words)
    counts = [(d, len(w), Counter(w)) for d, w in words if w]
    df = Counter(w for _, _, c in counts for w in c)
    out = Counter()
    for item, text in items:
        scored = []
        for d, n, c in counts:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(plain_terms(text)) if c[w])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out.update((item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1))
    return out


def check_lexical(docs, items, k=50):
    want = plain_lexical([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], k)
    got = lexical_search.search(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == want
    return want


def test_terms():
    for text in (None, "", " ", "A-b_C9  ünï Ä\n日本\x7f`x", "🙂".encode("utf-16", "surrogatepass").decode("utf-16") + "é!", "x" * 100_000):
        assert [t.decode() for t in lexical_search.terms(text) if t] == plain_terms(text)


def test_lexical_search_of_the_tables(spark):
    assert check_lexical(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))


@pytest.mark.parametrize("chars", [2_000_000, 1500])
def test_lexical_search_of_odd_rows(spark, monkeypatch, chars):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", chars)
    monkeypatch.setattr(lexical_search, "DOCUMENTS", 3)
    docs = fixtures.odd_docs(spark)
    texts = [r.text for r in docs.filter("length(text) between 1 and 3000").collect()]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(1, "one two"), (1, "one two"), (7, None), (8, ""), (9, "!!"), (None, "two ONE"), (10, "nowhere-found"), (11, fixtures.prose(2, 300) * 3)]
    items = spark.createDataFrame([(*r[:2], 1, "t", 2) for r in rows], "item_id long, text string, rank int, query string, score int")
    check_lexical(docs, items, 2)


def test_lexical_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert lexical_search.search(fixtures.no_docs(spark), items).collect() == []
    assert lexical_search.search(fixtures.odd_docs(spark), nothing).collect() == []
    assert lexical_search.search(fixtures.docs_of(spark, [None, "", "..."]), items).collect() == []


def test_ties_at_the_end_of_the_ranking(spark):
    docs = fixtures.docs_of(spark, ["same words here"] * 90 + ["other text"] * 200)
    items = spark.createDataFrame([(1, "words same"), (2, "other words")], "item_id long, text string")
    check_lexical(docs.repartition(7), items, 50)


def test_shared_terms_give_each_query_its_terms():
    rng = random.Random(6)
    common = [f"c{k}" for k in range(12)]
    wanted = [[w.encode() for w in rng.sample(common, 7) + [f"own{i}"] * (i % 2)] for i in range(40)] + [[], [b"c1"], [b"c1"]]
    plan = lexical_search.share(wanted)
    nodes = [set(c) for c in plan.classes]
    for a, b in plan.joins:
        assert not nodes[a] & nodes[b]
        nodes.append(nodes[a] | nodes[b])
    for words, parts in zip(wanted, plan.queries, strict=True):
        got = [t for p in parts for t in nodes[p]]
        assert sorted(got) == sorted({plan.vocabulary[w] for w in words})
    plain = sum(max(0, len(set(w)) - 1) for w in wanted)
    assert len(plan.joins) + sum(max(0, len(p) - 1) for p in plan.queries) < plain
    pairs = Counter(p for parts in plan.queries for p in set(zip(parts, parts[1:], strict=False)))
    assert max(pairs.values(), default=0) < 2
