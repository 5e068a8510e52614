"""Secret scans against a plain scan with the same patterns and the same battery."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from codeloom.llm import secret_scans as s
from tests.llm import fixtures

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ALPHABET = s.ALPHABET


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def p_value(word):
    word = word.rstrip("=") or word
    n = len(word)
    k, same = next((k, same) for pattern, k, same in s.ENCODINGS if re.search(pattern, word))
    squares = sum(c * c for c in Counter(word).values())
    free = k - 1
    chi = k / n * squares - n
    uniform = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    x = [ALPHABET.index(c) + 1 for c in word]
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    if not spread:
        return 1.0
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / spread
    if abs(uniform) > s.VETO or abs(serial + 1 / n) * math.sqrt(n) > s.VETO:
        return 1.0
    usual = same * n * (n - 1) / 2
    kind = [s.CLASSES[v - 1] for v in x]
    runs = 1 + sum(a != b for a, b in zip(kind, kind[1:]))
    few = (usual - (squares - n) / 2) / math.sqrt(1.5 * usual)
    c = s.CLASS_CHANGE
    changed = (runs - 1 - c * (n - 1)) / math.sqrt(c * (1 - c) * (n - 1))
    return 0.5 * math.erfc((few + changed) / 2)


def plain(texts, rate):
    base = [base_spans(t or "") for t in texts]
    tested = [
        [(m.start(), m.end(), p_value(m[0]), int(math.log2(len(m[0].rstrip("=") or m[0]))))
         for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or "") if not any(b[0] < m.end() and m.start() < b[2] for b in bs)]
        for t, bs in zip(texts, base)
    ]
    steps = defaultdict(list)
    step = lambda p: math.floor(-10 * math.log10(max(p, 10.0**-s.SMALLEST)))
    for spans in tested:
        for _, _, p, band in spans:
            steps[band].append(step(p))
    least = {}
    for band, all_steps in steps.items():
        for x in sorted(set(all_steps)):
            if x > 0 and 10 ** (-x / 10) * len(all_steps) <= rate * sum(y >= x for y in all_steps):
                least[band] = x
                break
    out = []
    for bs, spans in zip(base, tested):
        more = [(a, 3, b, "random") for a, b, p, band in spans if band in least and step(p) >= least[band]]
        out.append((bs, sorted(bs + more)))
    return out


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def some_texts():
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n, of=letters: "".join(rng.choice(of) for _ in range(n))
    texts = [f"{fixtures.prose(k, 30)} {key(40)} {fixtures.prose(k, 20)}" for k in range(20)]
    texts += [f"é🙂 {fixtures.prose(k, 5)} src/main/java/com/example/deep/path some_long_identifier_name_here" for k in range(20)]
    texts += [key(64, "0123456789ABCDEF"), "Donaudampfschifffahrtsgesellschaft", "a" * 500, letters, "=" * 40, "ab" * 40, key(3000), "1" * 30]
    texts += ["password=token=abcdefgh", "token=token: abcdefgh", "PassWord : 'hunter22'", "api-key=123456", "apikey=12345 api_key=123456", "secret=a.b/c=d-e_f"]
    texts += ["AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 13, "xAKIA" + "C" * 40, "abcdef0123456789abcdef01", "abcdef0123456789abcdef0", "token=" + "ab12" * 10]
    texts += ["token: " + "deadbeef" * 4 + " " + "deadbeef" * 4, None, "", "password=" * 50]
    return texts


def test_spans_equal_a_plain_scan(spark):
    texts = some_texts()
    found = {r.doc_id: r for r in s.find_secrets(fixtures.docs_of(spark, texts), rate=0.05).collect()}
    reported = 0
    for k, (base, spans) in enumerate(plain(texts, 0.05)):
        r = found[k]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(b[1] == kind for b in base) for kind in range(3)), texts[k]
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest(), texts[k]
        assert r.spans == written(spans), texts[k]
        reported += len(spans) - len(base)
    assert reported >= 20


def test_clean_text_is_left_alone(spark):
    texts = [fixtures.prose(k, 400) for k in range(30)] + ["see src/main/java/com/example/App and keitlichenlichkeitbeheitung"]
    docs = fixtures.docs_of(spark, texts)
    assert {r.spans for r in s.find_secrets(docs).collect()} == {""}
    assert [r.text for r in s.redact_secrets(docs).orderBy("doc_id").collect()] == texts


def test_redaction(spark):
    texts = ["é password=hunter22 x", "AKIA" + "B" * 16 + " and " + "ab12cd34" * 4, "nothing", None]
    docs = fixtures.docs_of(spark, texts)
    found = [r for r in s.redact_secrets(docs).orderBy("doc_id").collect()]
    assert [r.text for r in found] == ["é [secret] x", "[secret] and [secret]", "nothing", None]
    assert [r.n_chars for r in found[:3]] == [len(r.text) for r in found[:3]]


def test_odd_documents(spark):
    docs = fixtures.odd_docs(spark)
    assert s.find_secrets(docs).count() == docs.count()
    redacted = s.redact_secrets(docs)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    assert s.find_secrets(fixtures.no_docs(spark)).collect() == [] == s.redact_secrets(fixtures.no_docs(spark)).collect()
