"""Near duplicates, decontamination, token counts and the pipeline against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import decontamination, language_id, mixing, near_dedup, secret_scans, tables, token_counts
from codeloom.llm.shingles import shingle_set
from codeloom.llm.tables import stored
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"


def plain_components(rows, similar=85):
    sets, parent = {}, {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for t in s:
            holders[t].append(d)
    for d, s in sets.items():
        for e, k in Counter(e for t in s for e in holders[t] if e < d).items():
            if 100 * k >= similar * (len(s) + len(sets[e]) - k):
                x, y = find(d), find(e)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check_components(docs, similar=85):
    want = plain_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], similar)
    got = near_dedup.near_duplicates(docs, similar).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(rng, base, copies, edits):
    """Copies with some words changed; near the threshold where edits are many."""
    out = []
    for _ in range(copies):
        words = base.split(" ")
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
        out.append(" ".join(words))
    return out


def test_families_and_shared_passages(spark):
    rng = random.Random(3)
    texts = []
    for k, (size, copies, edits) in enumerate([(12, 30, 2), (30, 40, 3), (60, 40, 4), (120, 90, 5), (300, 60, 12), (900, 20, 30)]):
        texts += family(rng, fixtures.prose(100 + k, size), copies, edits)
    passage = fixtures.prose(7, 70)
    texts += [f"{fixtures.prose(200 + k, 60)} {passage} {fixtures.prose(300 + k, 10)}" for k in range(80)]
    texts += [passage] * 40 + ["one two three four", "one two three four five", "", None, "x"] * 2
    check_components(fixtures.docs_of(spark, texts))


def test_given_documents(spark):
    check_components(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_documents_are_deduplicated(spark):
    docs = fixtures.odd_docs(spark)
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3, -1)} == {-1}
    assert all(r.kept for r in found if r.doc_id is None or r.doc_id in (4, 5, 6))
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [-1, 4, 5, 6, 7, 8, 10, 11, 12] and ids.count(None) == 2
    assert near_dedup.near_duplicates(fixtures.no_docs(spark)).collect() == [] == near_dedup.drop_near_duplicates(fixtures.no_docs(spark)).collect()


def test_levels_lose_no_pair_of_small_sets():
    rng = np.random.default_rng(1)
    for n in (6, 11, 12, 20, 40, 41, 80, 90, 91, 150, 170):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            apart = 3 * n // 17
            b = np.unique(np.concatenate([a[rng.permutation(n)[apart:]], rng.integers(0, 2**63, 0).astype(np.uint64)]))
            assert 100 * len(b) < 85 * n or set(near_dedup.list_keys(a).tolist()) & set(near_dedup.list_keys(b).tolist())


@pytest.mark.parametrize("similar", [80, 85])
def test_lists_lose_no_pair_of_the_smallest_sets(similar):
    rng = np.random.default_rng(2)
    for n in range(5, {80: 8, 85: 12}[similar]):
        apart = (100 - similar) * n // 100
        for _ in range(300 if apart else 0):
            # Hashes of one residue, as small sets may have.
            a = np.unique(rng.integers(0, 2**55, n).astype(np.uint64) << np.uint64(2))
            b = np.sort(a[rng.permutation(len(a))[apart:]])
            assert 100 * len(b) < similar * len(a) or set(near_dedup.list_keys(a, similar).tolist()) & set(near_dedup.list_keys(b, similar).tolist())


def test_pairs_that_meet_in_one_list_are_found(spark, monkeypatch):
    rng = random.Random(4)
    texts = []
    for k in range(12):
        words = fixtures.prose(400 + k, 230).split(" ")
        texts += [" ".join(words), " ".join([*words[: 204 + k % 3], *(f"w{rng.randrange(1000)}" for _ in range(20))])]
    # No pair meets often enough to be among the first.
    monkeypatch.setattr(near_dedup, "_meetings", lambda n: near_dedup.F.lit(1000))
    check_components(fixtures.docs_of(spark, texts))
    texts = [t for k, base in enumerate(texts[:4]) for t in family(rng, base, 12, 6)]
    check_components(fixtures.docs_of(spark, texts))


@pytest.mark.parametrize("similar", [80, 85])
def test_estimates_lose_no_pair_at_the_threshold(similar):
    least = round(near_dedup._least_estimate(similar) * near_dedup.SKETCH)
    p, n = similar / 100, near_dedup.SKETCH
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least)) <= 1e-9


def test_stage_drops_near_copies_from_its_own_threshold(spark):
    words = [f"w{k}" for k in range(100)]
    twice = " ".join("other" if k in (30, 60) else w for k, w in enumerate(words))
    thrice = " ".join("other" if k in (20, 50, 80) else w for k, w in enumerate(words))
    docs = fixtures.docs_of(spark, [" ".join(words), twice, thrice])  # similar in 86 of 106 and 81 of 111 shingles
    assert [r.doc_id for r in near_dedup.drop_near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1, 2]
    assert [r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, SF).orderBy("doc_id").collect()] == [0, 2]


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 501), (501, 500)], "a long, b long")
    found = {r.id: r.component for r in near_dedup.components(links).collect()}
    assert all(found[k] == 1 for k in range(1, 201)) and found[500] == found[501] == 500


@pytest.mark.parametrize("similar", [80, 85])
def test_given_documents_at_both_thresholds(spark, similar):
    check_components(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), similar)


def test_texts_under_one_id_are_judged_each_on_its_own(spark):
    x, y, z = (fixtures.prose(700 + k, 90) for k in range(3))
    near = y.split(" ")
    near[50] = "changed"
    rows = [(3, x), (5, x), (5, y), (7, " ".join(near)), (7, z), (7, z), (7, z.upper()), (None, x), (8, ""), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], fixtures.DOCS)
    kept = Counter((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(docs).collect())
    assert kept == Counter([(3, x), (5, y), (7, z.upper()), (None, x), (8, ""), (8, "")])
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == {(3, 3), (5, 3), (5, 5), (7, 5), (7, 7), (None, None), (8, 8)}


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))
    texts = [t for k in range(3) for t in family(random.Random(k), fixtures.prose(800 + k, 60), 5, 2)]
    near_dedup.near_duplicates(fixtures.docs_of(spark, texts)).collect()
    assert len(list(tmp_path.iterdir())) == 1


def test_marks_hold_for_all_ids(spark):
    ids = spark.createDataFrame([(k * 7,) for k in range(500)] + [(None,), (-5,)], "doc_id long")
    marks = near_dedup._Marks(ids)
    assert ids.filter(marks.hold("doc_id")).count() == 502
    assert spark.range(10_000, 30_000).filter(marks.hold("id")).count() < 20


def test_shingles():
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a\u00a0b")) == 1
    assert (shingle_set("A b\tc D\r\ne") == shingle_set("a B C d e")).all() and len(shingle_set(" \n")) == 0
    assert not set(shingle_set("a b c d").tolist()) & set(shingle_set("a b c d e").tolist())


QUESTION = "A train leaves Boston at 9 am and runs 60 km in an hour. How far is it from Boston when Alice boards it 3 hours later?"


def leaks(spark, texts, items):
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(fixtures.docs_of(spark, texts), benchmark).collect()}


def test_templates(spark):
    other = QUESTION.replace("9", "11").replace("60", "85").replace("Boston", "Denver").replace("Alice", "Carla").replace("km", "miles")
    mixed_up = other.replace("from Denver", "from Austin")
    texts = [f"{fixtures.prose(1, 50)} {t} {fixtures.prose(2, 50)}" for t in (QUESTION, other, mixed_up)] + [fixtures.prose(3, 400), None, "", QUESTION[:40]]
    found = leaks(spark, texts, [QUESTION, None, "", "short"])
    assert set(found) == {(0, 0), (1, 0)}
    assert found[0, 0].changed == 0 and found[1, 0].changed >= 4


def test_changed_values_cost_only_their_windows():
    words = [w for w in fixtures.prose(9, 90).lower().replace(".", "").split() if w not in decontamination.UNITS | decontamination.NUMBERS][:60]
    words[5] = words[30] = words[50] = "Paris"
    item = " ".join(words)
    index = decontamination.ItemIndex([(1, item)])
    windows = index.count[0]
    one_other = " ".join([*words[:50], "Lyon", *words[51:]])
    assert index.matches(one_other) == [(1, windows, 1.0, 3, 1)]
    clashing = " ".join([*words[:5], "Rome", *words[6:50], "Lyon", *words[51:]])
    (_, found, _, slots, changed), = index.matches(clashing)
    assert found == windows - 6 - 8 and (slots, changed) == (1, 0)


@pytest.mark.parametrize(("old", "new"), [(("5", "5"), ("7", "9")), (("3", "4"), ("6", "6"))])
def test_numbers_change_each_by_itself(old, new):
    question = "Tom buys {} ripe apples at the market and later sells {} of the pears to a friend who lives near the river."
    index = decontamination.ItemIndex([(1, question.format(*old))])
    assert [m[0] for m in index.matches(question.format(*new))] == [1]


def test_leaks_equal_plain_search(spark):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, " ".join(r.text.split())) for r in benchmark.collect()]
    rows = [(r.doc_id, " ".join((r.text or "").split())) for r in docs.collect()]
    inside = {(d, i) for d, text in rows for i, item in items if item.strip(".,") in text}
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, benchmark).collect()}
    assert inside and inside <= found and len(found) <= len(inside) + 1
    assert {r.doc_id for r in decontamination.drop_leaks(docs, benchmark).collect()} == {d for d, _ in rows} - {d for d, _ in found}


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontamination.find_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, decontamination.find_leaks(docs, benchmark).collect())) == whole


def test_odd_documents_have_leaks(spark):
    docs = fixtures.odd_docs(spark)
    benchmark = spark.createDataFrame([(1, fixtures.prose(2, 300)), (None, "a b c d e f g h i"), (2, None), (3, "one two")], "item_id long, text string")
    # "one two" is numbers alone, which tells nothing.
    assert {r.doc_id for r in decontamination.find_leaks(docs, benchmark).collect()} == {-1, 1, 2, 3}
    assert decontamination.drop_leaks(docs, benchmark).columns == docs.columns
    assert decontamination.find_leaks(docs, benchmark.limit(0)).collect() == [] == decontamination.find_leaks(fixtures.no_docs(spark), benchmark).collect()


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rng = random.Random(2)
    pieces = list("ab Z9'sll\t\n\r  .é²ß¿×÷ªº¼…—€ñ") + ["<|endoftext|>", "'re", "   ", "日", "\u2028", "\xa0", "🙂", "the", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [fixtures.prose(1, 40_000), None, "", "x" * 5000]
    found = {r.doc_id: r for r in token_counts.count_tokens(fixtures.docs_of(spark, texts), vocabulary()).collect()}
    for k, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[k].n_tokens, found[k].n_bytes, found[k].over_limit) == (n, len((text or "").encode()), n > 512), text


def test_full_caches_start_again(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 50)
    lengths, fresh = token_counts._Lengths(vocabulary(), {"the": 1}), token_counts._Lengths(vocabulary(), {})
    for k in range(20):
        text = fixtures.prose(k, 100)
        assert lengths.counts([text, text]) == [len(fresh.tokenizer.encode(text).ids)] * 2


def test_odd_documents_have_tokens(spark):
    docs = fixtures.odd_docs(spark)
    assert token_counts.count_tokens(docs, vocabulary()).count() == docs.count()
    assert token_counts.count_tokens(fixtures.no_docs(spark), vocabulary()).collect() == []


def test_pipeline_equals_its_stages_in_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language_id.learn(docs)
    kept = {d: r for d, r in rows.items() if model.score(r.text)[0] != "und" and model.score(r.text)[1] >= 0.5}
    parts = plain_components([(d, r.text) for d, r in kept.items()], corpus_pipeline.SIMILAR)
    kept = {d: r for d, r in kept.items() if parts[d][1] == d}
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    index = decontamination.ItemIndex([(r.item_id, r.text) for r in benchmark.collect()])
    kept = {d: r for d, r in kept.items() if not index.matches(r.text)}
    stages, after = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stored(stage(spark, stages, SF), name)
        if name == "decontamination":
            assert {r.doc_id: r for r in stages.collect()} == kept
            after = stages
    spans = {r.doc_id: r.spans for r in secret_scans.find_secrets(after).collect()}
    redacted = {}
    for d, r in kept.items():
        text, done = "", 0
        for start, end in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans[d].split(",") if x):
            text += r.text[done:start] + "[secret]" if start >= done else ""
            done = max(done, end)
        redacted[d] = text + (r.text or "")[done:]
    assert {r.doc_id: r.text for r in stages.collect()} == redacted
    copies = {r.doc_id: r.copies for r in mixing.mixed_sizes(stages).collect()}
    mixed = corpus_pipeline.run(spark, SF)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert Counter(r.doc_id for r in got) == Counter({d: n for d, n in copies.items() if n})
    assert all(r.text == redacted[r.doc_id] for r in got)


def test_pipeline_takes_odd_rows(spark):
    for docs in (fixtures.odd_docs(spark), fixtures.no_docs(spark)):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.columns == columns
            docs.count()
