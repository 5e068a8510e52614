"""Language, toxicity and HTML models: held-out accuracy, and single parts against plain versions."""

import math
import time
import zlib
from collections import Counter
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import html_blocks, html_extraction, language_id, toxicity
from codeloom.llm.labelled_pages import labelled_pages
from tests.llm import fixtures

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = language_id.identify_languages(docs).collect()
    tested = [r for r in found if r.held_out]
    assert len(found) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in found)


def plain_bits(samples: list[bytes], known: set[bytes], data: bytes) -> float:
    """Bits of a code with escapes (method C, with exclusion), worked out byte by byte from plain counts."""
    counts: dict[bytes, dict[int, int]] = {}
    for text in samples:
        for i, byte in enumerate(text):
            for order in range(min(i, 3) + 1):
                seen = counts.setdefault(text[i - order : i], {})
                seen[byte] = seen.get(byte, 0) + 1

    @cache
    def chance(context: bytes | None, byte: int) -> float:
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        seen = counts.get(context)
        if not seen:
            return chance(shorter, byte)
        left = sum(chance(shorter, x) for x in range(256) if x not in seen)
        total = sum(seen.values()) + (len(seen) if left > 0 else 0)
        return seen[byte] / total if byte in seen else chance(shorter, byte) * len(seen) / total / left

    bits = 0.0
    for i, byte in enumerate(data):
        context = next(c for c in (data[i - k : i] for k in range(min(i, 3), -1, -1)) if c in known)
        bits -= math.log2(chance(context, byte))
    return bits


def test_code_lengths_equal_plain_escape_computation():
    """Every byte is a symbol of its own, scripts and all; a rare language has its own contexts beside a common one."""
    samples = {"a": ["abracadabra " * 12, "banana"], "b": ["xyzzy " * 3], "c": ["слово и дело " * 4, "日本"]}
    model = language_id.fit(samples)
    raw = {lang: [t.encode() for t in texts] for lang, texts in samples.items()}
    known = {b""}
    for texts in raw.values():
        seen = Counter(t[i - k : i] for t in texts for k in (1, 2, 3) for i in range(k, len(t)))
        known |= {c for c, n in seen.items() if n >= language_id.LEAST_SEEN}
    for text in ("abra banana", "xyzzy xy", "дело 日", "\x00qé"):
        expected = [plain_bits(raw[lang], known, text.encode()) for lang in sorted(raw)]
        assert model.lengths(text) == pytest.approx(expected, rel=1e-4)


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    fitted = {}
    monkeypatch.setattr(language_id, "fit", lambda samples: fitted.update(samples))
    docs = spark.range(500).selectExpr("cast(0 as long) doc_id", "concat('text ', id) text", "if(id < 300, 'a', concat('l', id)) lang")
    language_id.learn(docs.unionAll(docs.limit(0)), texts=20)
    assert {lang: len(texts) for lang, texts in fitted.items()} == {lang: 20 if lang == "a" else 1 for lang in fitted} and "a" in fitted


def test_odd_texts_have_languages(spark):
    docs = fixtures.odd_docs(spark)
    found = language_id.identify_languages(docs).collect()
    assert len(found) == docs.count()
    assert {r.lang_pred for r in found if r.doc_id in (4, 5, 6, 10)} == {"und"}
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and not {4, 5, 6, 10} & {r.doc_id for r in kept.collect()}
    assert language_id.identify_languages(fixtures.no_docs(spark)).collect() == []
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.identify_languages(unlabelled).collect()} == {"und"}


def test_long_text_scores_piece_by_piece(monkeypatch):
    model = language_id.fit({"a": [fixtures.prose(1, 500)], "b": ["zu der und die das ist " * 50]})
    text = fixtures.prose(9, 3000)
    whole = model.score(text)
    monkeypatch.setattr(language_id, "PIECE", 1000)
    assert model.score(text) == pytest.approx(whole)


def test_toxicity_held_out(spark):
    """Some labelled texts were overwritten with junk and have nothing left that tells."""
    large = SF.replace("sf0.01", "sf0.1")
    docs, labels = spark.read.parquet(f"{large}/documents.parquet"), spark.read.parquet(f"{large}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.score_toxicity(docs, labels).collect()
    tested = [(r.score, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    good, bad = [x for x, y in tested if y], [x for x, y in tested if not y]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.93
    assert sum(x >= 0.5 for x in bad) <= 0.01 * len(bad)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=1, max_size=8), st.lists(st.text("abcd", min_size=1, max_size=8), min_size=1, max_size=8, unique=True))
def test_automaton_equals_edit_distance(word, terms):
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms})
    allowed = 1 if len(word) >= toxicity.FUZZY_LENGTH else 0
    nearest = min(distance(word, t) for t in terms)
    found = lexicon.match(word)
    assert (found and found[1]) == (nearest if nearest <= allowed else None)


def test_stems_and_windows():
    known = toxicity._Known(toxicity.Lexicon({"lowei*": 2.0, "idiot": 1.0}))
    assert known["Loweischaft,"] == (2.0, 0) and known["idi0t"] == (1.0, 1) and known["lowe"] is None
    abuse, quote = toxicity.features("you are an idiot", known), toxicity.features('he said "idiot" aloud', known)
    assert abuse[0] > 0 and abuse[2] == 0 and abuse[3] > 0
    assert quote[0] == 0 and quote[2] > 0


def test_odd_texts_have_toxicity(spark):
    docs = fixtures.odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (3, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == docs.count()
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score_toxicity(fixtures.no_docs(spark), labels).collect() == []


def test_labelled_pages_are_learned():
    model = html_extraction.train(labelled_pages())
    wrong = total = 0
    for page in labelled_pages():
        blocks = html_blocks.leaf_blocks(page)
        wrong += sum(b.main != m for b, m in zip(blocks, model.labels(blocks), strict=True))
        total += len(blocks)
    assert wrong <= 0.01 * total


def test_unseen_layout_and_viterbi():
    """A layout that was left out of training, and the best of all label sequences by trying them."""
    pages = labelled_pages()
    model = html_extraction.train([p for p in pages if "post-body" not in p])
    page = next(p for p in pages if "post-body" in p)
    blocks = html_blocks.leaf_blocks(page)
    assert sum(b.main == m for b, m in zip(blocks, model.labels(blocks), strict=True)) >= 0.8 * len(blocks)
    few = blocks[5:15]
    weight = [sum(model.weights.get(f, 0) for f in html_extraction.block_features(b)) for b in few]
    best = max(range(1 << len(few)), key=lambda c: sum(w for i, w in enumerate(weight) if c >> i & 1) + sum(model.turns[c >> i & 1, c >> i + 1 & 1] for i in range(len(few) - 1)))
    assert model.labels(few) == [bool(best >> i & 1) for i in range(len(few))]


def test_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_extraction.extract_main_text(pages).collect():
        article = re.search("<article>(.*?)</article>", source[r.page_id], re.S)
        plain = re.sub("<[^>]*>", " ", re.sub("</?b>", "", article[1]))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_markup():
    page = '<p>a &amp; b&nbsp;&nbsp;c<br>d<b>e</b><script>"</p>"</script> x < y <!-- z --><li>one<li>two<ul><li>three</ul></p><td'
    assert [b.text for b in html_blocks.leaf_blocks(page)] == ["a & b c de x < y", "one", "two", "three", "<td"]
    assert html_blocks.leaf_blocks(None) == [] == html_blocks.leaf_blocks("")


@pytest.mark.parametrize("icon", [
    '<svg class="i"/>', "<svg/>", "<svg hidden/>", "<iframe src=x />", '<object data="x"/>', "<svg-icon name='i'></svg-icon>", "<template-x>", "<object-view/>",
    "<canvas>", "<iframe src=x>", "<svg>drawn</svg>", "<svg width=1/>drawn</svg>", "<canvas>none</canvas >", "<math/><svg/>", '<svg title="a>b"/>',
])
def test_elements_without_text_end_where_they_close(icon):
    page = f"<p>before</p>{icon}<article>main text</article><p>after</p>"
    assert [b.text for b in html_blocks.leaf_blocks(page)] == ["before", "main text", "after"]


def test_icons_apart_and_scripts_to_the_end():
    page = "<p>one</p><svg/><p>two</p><svg><title>t</title></svg><p>three</p><script src=x /><p>code</p>"
    assert [b.text for b in html_blocks.leaf_blocks(page)] == ["one", "two", "three"]


def test_deep_elements_stay_paired():
    page = "<section>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>last</p></section>"
    deep, last = html_blocks.leaf_blocks(page)
    assert (deep.own, deep.tags, last.own, last.tags) == ("div", {"section", "div"}, "p", {"section", "p"})


def test_formulas_objects_and_noscript_keep_their_text():
    page = "<p>Let <math><mi>x</mi></math> be real.</p><object data=x>shown</object><noscript>plain</noscript><p>end</p>"
    assert [b.text for b in html_blocks.leaf_blocks(page)] == ["Let x be real.", "shown", "plain", "end"]


def test_quotes_in_tags():
    page = """<p title="a>b">one</p><p title='">two</p><p class='x'>three</p><a href="x>four</p>"""
    assert [b.text for b in html_blocks.leaf_blocks(page)] == ["one", "two", "three", "four"]


@pytest.mark.parametrize("piece", ["<a ", "<svg ", "<a '", '<a "', "<a '>", '<a ">', "<a '\">", "</svg ", "<svg></svg ", "<!--", "<!", "<svg>", "<p class=x ", "<div>x", "<p><figure>x", "<li>", "<script ", "</p>", "<a x='>'\">", "<object><li>x"])
def test_time_is_linear_in_hostile_markup(piece):
    page = piece * (1_000_000 // len(piece))
    times = []
    for part in (page, page + ">"):
        began = time.process_time()
        html_blocks.leaf_blocks(part)
        times.append(time.process_time() - began)
    assert max(times) < 6  # a second on an idle machine, and some for slow ones


def test_odd_pages(spark):
    rows = [(1, "u", "<article><p>" + "word " * 300_000), (2, None, None), (None, "u", ""), (3, "u", "<" * 5000), (3, "u", "<p>" * 3000 + "x"), (4, "u", "no markup at all.")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_extraction.extract_main_text(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert {len(r.text) for r in found if r.page_id == 1} == {300_000 * 5 - 1}
    assert html_extraction.extract_main_text(pages.limit(0)).collect() == []
