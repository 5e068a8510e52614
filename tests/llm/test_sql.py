"""Queries that SQL can express, on the given tables and on odd rows."""

import os

import duckdb
import pytest

from codeloom.llm import mixing, oracles, quality_rules, queries, url_filters
from tests import oracle
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"


def rows(df):
    return oracle.rows_of(df.columns, [tuple(r) for r in df.collect()])


def from_duck(con, sql):
    cursor = con.execute(sql)
    return oracle.rows_of([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_given_tables(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert rows(queries.QUERIES[name](spark, SF)) == from_duck(oracle.connect(SF), oracles.ORACLES[name])


def duck_with(docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return con


@pytest.mark.parametrize("make", [fixtures.odd_docs, fixtures.no_docs])
def test_odd_documents(spark, tmp_path, make):
    docs = make(spark)
    con = duck_with(docs, tmp_path)
    mixed = mixing.mixed_sizes(docs).drop("copies")
    assert rows(mixed) == from_duck(con, oracles.ORACLES["op1_mixing"])
    cleaned = quality_rules.clean_lines(docs).drop("clean_text")
    assert rows(cleaned) == from_duck(con, oracles.ORACLES["op8_quality_rules"])


def test_targets_reach_their_share(spark):
    docs = spark.createDataFrame([(k, "w " * n, "en", s, 0) for k, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 30), ("d", 500)])], fixtures.DOCS)
    found = {r.source: r for r in mixing.source_targets(mixing.document_sizes(docs)).collect()}
    assert found["a"].target == 20 and found["c"].target == 60
    assert sum(r.target for r in found.values()) == pytest.approx(1.5 * 1540)
    assert all(r.target <= 2 * r.source_size for r in found.values())


def test_mix_emits_what_the_sizes_say(spark):
    docs = fixtures.odd_docs(spark)
    copies = {}
    for r in mixing.mixed_sizes(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    emitted = {}
    for r in mixed.collect():
        emitted[r.doc_id] = emitted.get(r.doc_id, 0) + 1
    assert emitted == {k: n for k, n in copies.items() if n}


URLS = [
    "https://a.example.com/en/7?x#y", "http://EXAMPLE.com/en/6", "http://example.com/fr/", "x.net/de/", "ftp://net/de/8", "http://www.example.net/de/88/",
    "http://example.net/de/7", "http://notexample.net/de/8", "a://b://c.org/es/", "http://org/es/?", "http://?q", "http://", "://", "", None,
    "http://example.net#/de/8", "http://b.org\n/es/", "HTTP://X.ORG/es/x/" + "y" * 5000, "http://" + "a." * 3000 + "com/en/", "http://exämple.Com/en/ä",
]


def test_urls(spark, tmp_path):
    pages = spark.createDataFrame([(k % 7 if k != 3 else None, u, "h", "r") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string")
    con = duckdb.connect()
    pages.write.parquet(str(tmp_path / "pages"))
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    found = rows(url_filters.judge_urls(pages, url_filters.rule_table(spark)))
    assert found == from_duck(con, oracles.ORACLES["op4_url_filters"])
    assert sum(found.values()) == 2 * len(URLS)
    assert url_filters.judge_urls(pages.limit(0), url_filters.rule_table(spark)).collect() == []
    assert {r.verdict for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, [])).collect()} == {"allow"}
