import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scopes
from codeloom.functions.pattern_tables import PATTERNS, SCHEMAS
from codeloom.operators import context, extraction, languages

PYTHON = '''import os
from app.db import session as s, models

class Base:
    pass

class User(Base, ABC):
    # a comment

    def save(self, x):
        if x:
            return self.check(x)
        return helper(x)

    async def check(self, x) -> bool:
        return True

def helper(a):
    return len(a)
'''
TYPESCRIPT = '''import { A, B as C } from './b';
import def from "lib";

export class Svc extends Base implements IOne, ITwo {
  run(x: number): number {
    const s = "not a } brace";
    return this.calc(x);
  }
  calc(y: number): number {
    return y;
  }
}

export const twice = (n: number): number => {
  return n * 2;
}

router.post('/things', handler);
'''
JAVA = '''package a.b;
import java.util.List;
@RestController
public class OrderController extends Base implements X {
    @GetMapping("/orders")
    public List<String> list(String q) {
        return null;
    }
}
'''
GO = 'package main\n\nimport "fmt"\n\ntype Srv struct {\n  n int\n}\n\nfunc (s *Srv) Run(a int) error {\n}\n\nfunc main() {\n  fmt.Println(1)\n}\n'
RUST = 'use std::io;\n\npub struct P {\n}\n\nimpl Tr for P {\n}\n\npub fn go(x: i32) -> i32 {\n  x\n}\n'
CSHARP = 'using System.Linq;\nnamespace N\n{\n    [HttpGet("/z")]\n    public class K : B\n    {\n        public int Do(int a) { return a; }\n    }\n}\n'
FASTAPI = 'from fastapi import APIRouter\n\nrouter = APIRouter()\n\n@router.get("/u")\nasync def users(db):\n    return await load(db)\n\ndef load(db):\n    return db.all()\n'
NEST = "import { Controller } from '@nestjs/common';\n@Controller('cats')\nexport class CatsController {\n  @Get(':id')\n  find(id: string): string {\n    return id;\n  }\n}\n"


@pytest.fixture(scope="module")
def corpus(spark):
    texts = {"a.py": PYTHON, "b.ts": TYPESCRIPT, "C.java": JAVA, "d.go": GO, "e.rs": RUST, "f.cs": CSHARP, "cats.controller.ts": NEST}
    rows = spark.createDataFrame([("p", k, v) for k, v in texts.items()], "project_id string, path string, content string")
    files = languages.match_schemas(languages.detect_language(rows))
    return extraction.with_nodes(extraction.find_matches(files)).cache()


def nodes_of(corpus, path):
    return {(r.type, r.name): (r.line_start, r.line_end) for r in extraction.extract_nodes(corpus).filter(F.col("file") == path).collect()}


def test_python_nodes_and_scopes(corpus):
    nodes = nodes_of(corpus, "a.py")
    assert nodes[("File", "a.py")] == (1, 20)
    assert nodes[("Class", "Base")] == (4, 5)
    assert nodes[("Class", "User")] == (7, 16)
    # The leading blank line belongs to the match, so a method starts on it.
    assert nodes[("Function", "save")][1] in (10, 13) and ("Function", "helper") in nodes
    assert ("Import", "app.db") in nodes and ("Import", "os") in nodes


def test_typescript_scopes_skip_braces_in_strings(corpus):
    nodes = nodes_of(corpus, "b.ts")
    assert nodes[("Class", "Svc")] == (4, 12)
    assert nodes[("Method", "run")] == (5, 8) and nodes[("Method", "calc")] == (9, 11)
    assert nodes[("Function", "twice")] == (14, 16)
    assert ("Endpoint", "/things") in nodes


def test_other_languages(corpus):
    assert {("Class", "OrderController"), ("Endpoint", "/orders"), ("Method", "list"), ("Import", "java.util.List")} <= set(nodes_of(corpus, "C.java"))
    assert {("Package", "main"), ("Class", "Srv"), ("Method", "Run"), ("Function", "main"), ("Import", "fmt")} <= set(nodes_of(corpus, "d.go"))
    assert {("Import", "std::io"), ("Class", "P"), ("Implementation", "P"), ("Function", "go")} <= set(nodes_of(corpus, "e.rs"))
    assert {("Import", "System.Linq"), ("Class", "K"), ("ApiEndpoint", "/z"), ("Method", "Do")} <= set(nodes_of(corpus, "f.cs"))


def test_imports_inheritance_and_calls(corpus):
    imports = {(r.path, r.import_name, r.alias, r.to_id, r.line) for r in extraction.extract_imports(corpus).filter("path IN ('a.py', 'b.ts')").collect()}
    assert imports == {("a.py", "os", None, "os", 1), ("a.py", "session", "s", "app.db.session", 2), ("a.py", "models", None, "app.db.models", 2),
                       ("b.ts", "A", None, "./b", 1), ("b.ts", "B", "C", "./b", 1), ("b.ts", "def", None, "lib", 2)}
    parents = {(r.from_name, r.type, r.parent_name, r.is_resolved) for r in extraction.extract_inheritance(corpus).filter("path IN ('a.py', 'b.ts')").collect()}
    assert parents == {("User", "INHERITS", "Base", True), ("Svc", "INHERITS", "Base", False), ("Svc", "IMPLEMENTS", "IOne", False), ("Svc", "IMPLEMENTS", "ITwo", False)}
    calls = {(r.from_name, r.target_name, r.is_resolved, r.confidence) for r in extraction.extract_calls(corpus).filter("path = 'b.ts'").collect()}
    assert ("run", "calc", True, 0.9) in calls and ("Svc", "calc", True, 0.8) in calls


def plain_calls(row):
    """Calls of a prepared file, line by line, from its nodes."""
    ids = {}
    for kinds in (extraction.CALLABLE, ("Class",)):
        ids |= {n.name: n.id for n in row.nodes if n.type in kinds}
    found, seen = set(), set()
    for n in row.nodes:
        if n.id in seen:
            continue
        seen.add(n.id)
        if n.type in ("Class", *extraction.CALLABLE):
            text = "\n".join(row.lines[n.line_start - 1 : n.line_end])
            for rule, group in extraction.CALLS["python" if row.language == "python" else "other"]:
                names = {m.group(group) for m in re.finditer(rule, text)} - {n.name, *extraction.NOT_CALLS}
                found |= {(row.path, n.id, ids.get(x, x), x, x in ids, n.type == "Class") for x in names if len(x) > 1}
    return found


def test_calls_equal_a_plain_version_in_every_language(spark, corpus):
    twice = "class Run:\n    def go(self):\n        return Run(go(helper()))\n\ndef helper():\n    pass\n\ndef helper():\n    go()\n\ndef Run():\n    helper()\n"
    rows = spark.createDataFrame([("p", k, v) for k, v in {"twice.py": twice, "api/r.py": FASTAPI, "empty.py": "", "none.go": "package main\n"}.items()],
                                 "project_id string, path string, content string")
    more = extraction.with_nodes(extraction.find_matches(languages.match_schemas(languages.detect_language(rows))))
    files = corpus.unionByName(more).cache()
    expected = set().union(*map(plain_calls, files.collect()))
    got = extraction.extract_calls(files).collect()
    assert {(r.path, r.from_id, r.to_id, r.target_name, r.is_resolved, r.from_class_scope) for r in got} == expected
    assert len(got) == len(expected) and {"a.py", "b.ts", "twice.py", "api/r.py", "d.go"} <= {r.path for r in got}


def test_first_class_of_a_name_is_the_parent(spark):
    text = "class A:\n    pass\n\nclass A(Base):\n    pass\n\nclass B(A, Enum):\n    pass\n"
    rows = spark.createDataFrame([("p", "x.py", text)], "project_id string, path string, content string")
    files = extraction.with_nodes(extraction.find_matches(languages.match_schemas(languages.detect_language(rows))))
    first = {n.name: n.id for n in reversed(files.first().nodes) if n.type == "Class"}
    got = {(r.from_id, r.to_id, r.parent_name, r.is_resolved) for r in extraction.extract_inheritance(files).collect()}
    assert got == {(first["A"], "Base", "Base", False), (first["B"], first["A"], "A", True)}


def test_handler_edge_needs_current_class(corpus):
    edges = extraction.template_edges(corpus).filter("path = 'cats.controller.ts'").collect()
    assert [(e.type, e.node_name) for e in edges] == [("HANDLED_BY", "find")]


def test_every_node_is_contained_once(spark, corpus):
    nodes, edges = extraction.extract_mesh(corpus.drop("lines", "matches", "heads", "nodes", "file_id"))
    assert nodes.count() == nodes.select("id").distinct().count()
    inner = nodes.filter("type <> 'File'").count()
    assert edges.filter("type = 'CONTAINS'").select("to_id").distinct().count() == inner
    assert extraction.contains_default(nodes, edges).count() == 0


def test_user_patterns(spark):
    schemas = {**SCHEMAS, "todo": (["python"], 0.3, ["TODO"], [], [])}
    patterns = [*PATTERNS, ("todo", "notes", "todo", r"TODO\((\w+)\): (.+)$", {"who": (1, "uppercase", None), "what": 2}, ("Note", "what", {"owner": "who", "kind": "todo"}), None, 1)]
    rows = spark.createDataFrame([("p", "x.py", "a = 1\n# TODO(ann): fix it\n")], "project_id string, path string, content string")
    files = languages.match_schemas(languages.detect_language(rows), schemas=schemas)
    ready = extraction.with_nodes(extraction.find_matches(files, patterns), patterns)
    (note,) = extraction.extract_nodes(ready, patterns).filter("type = 'Note'").collect()
    assert (note.name, note.line_start, note.line_end, note.properties) == ("fix it", 2, 3, {"owner": "ANN", "kind": "todo"})


def test_language_rules(spark):
    cases = [("a/b.PY", "", "python"), (".gitignore", "x", "unknown"), ("run", "#!/usr/bin/env node\n", "javascript"), ("x", "def f(a):\n", "python"),
             ("Gemfile", "zz", "ruby"), ("y", "fn main() {\n", "rust"), ("z", "SELECT 1", "sql"), ("go.mod", "zz", "go")]
    rows = spark.createDataFrame(cases, "path string, content string, want string")
    assert [r.language for r in languages.detect_language(rows).collect()] == [c[2] for c in cases]


def test_exports_honour_all(spark):
    text = '__all__ = ["f"]\nclass A(B):\n    pass\ndef f(x) -> int:\n    pass\ndef _g():\n    pass\n'
    rows = spark.createDataFrame([("p", "m.py", "python", text)], "project_id string, path string, language string, content string")
    assert [(r.name, r.signature) for r in context.extract_exports(rows).collect()] == [("f", "def f(x) -> int")]


def plain_indent_end(lines, start, indent):
    own = indent or (len(lines[start - 1]) - len(lines[start - 1].lstrip()) if start <= len(lines) else 0)
    last = start
    for at in range(start + 1, len(lines) + 1):
        line = lines[at - 1]
        if not line.strip() or line.strip().startswith("#"):
            continue
        if len(line) - len(line.lstrip()) <= own:
            break
        last = at
    return max(last, start + 1)


def plain_brace_end(lines, start):
    count, opened = 0, False
    for at in range(start, len(lines) + 1):
        outside, quote, escaped = [], None, False
        for k, c in enumerate(lines[at - 1]):
            before = lines[at - 1][k - 1] if k else ""
            if c in "\"'`" and before != "\\" and quote in (None, c):
                quote = None if quote else c
            elif quote is None and c in "{}":
                outside.append(1 if c == "{" else -1)
        if opened:
            if count <= 0:
                return at
            for step in outside:
                count += step
                if count <= 0:
                    return at
            continue
        if at >= start + 5:
            break
        count += lines[at - 1].count("{") - lines[at - 1].count("}")
        opened = "{" in lines[at - 1]
        if opened and count == 0:
            return at
    return len(lines) if opened else start + 1


def test_scopes_against_plain_ones():
    rng = random.Random(9)
    for _ in range(300):
        lines = [rng.choice(["", " ", "  ", "    ", "\t"]) + rng.choice(["", "x", "# y", "def f():", "z"]) for _ in range(rng.randint(1, 150))]
        found = scopes.IndentScopes(lines)
        for start in range(1, len(lines) + 1):
            indent = rng.choice([0, 0, 1, 4])
            assert found.end(start, indent) == plain_indent_end(lines, start, indent), (lines, start)
        pieces = ["{", "}", "a", "'{'", '"}"', "`", "\\'", "{}", " ", "{ x", "f(a) {"]
        lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 150))]
        found = scopes.BraceScopes(lines)
        for start in range(1, len(lines) + 1):
            assert found.end(start) == plain_brace_end(lines, start), (lines, start)


def test_scopes_of_a_large_file_are_quick():
    python = [line for k in range(2000) for line in (f"def f{k}():", *["    x = 1  " + "y" * 30] * 14)]
    script = [line for k in range(2000) for line in (f"function f{k}() {{", *["  x = '}';  " + "y" * 30] * 13, "}")]
    for kind, lines in ((scopes.IndentScopes, python), (scopes.BraceScopes, script)):
        assert len("\n".join(lines)) > 1 << 20
        began = time.process_time()
        found = kind(lines)
        assert [found.end(k * 15 + 1) for k in range(2000)] == [k * 15 + 15 for k in range(2000)]
        assert time.process_time() - began < 3


def test_an_expression_runs_only_where_its_required_text_is():
    wanted = {r"^from\s+(\w+)\s+import": "import", r"(?:app|router)\.get\(": ".get(", r"a(?:bc)?de": "de", r"(?:abc)+x": "abc", r"x(?!long)y": "x", r"(?i)class": "",
              r"long|short": "", r"(?i:long)s": "s", r"[abc]\d": "", r"(?:ab){0,2}": "", r"(ab)(cd)": "abcd", r"ab??c": "a", r"a\bb$": "ab", r"(?>xy)z": "z"}
    rng = random.Random(4)
    for rule, text in wanted.items():
        found = re.compile(rule)
        assert extraction.required_text(found) == text, rule
        for _ in range(300):
            some = "".join(rng.choices(["a", "b", "ab", "bc", "cd", "de", "x", "y", "xy", "z", "long", "LONG", "s", "1", "class", " import", "from q", "app.get("], k=6))
            assert text in some or not found.search(some)
    rules = extraction.compiled(PATTERNS)
    for content in (PYTHON, TYPESCRIPT, JAVA, GO, RUST, CSHARP):
        assert all(extraction.required_text(rule) in m[0] for rule in rules.values() for m in rule.finditer(content))
    assert sum(extraction.required_text(rule) != "" for rule in rules.values()) == len(rules)


def test_ends_of_scopes_near_and_far():
    rng = random.Random(6)
    for size in (1, 5, scopes.NEAR, scopes.NEAR + 1, 40, 300):
        lines = [" " * rng.choice([0, 2, 4, 4, 4, 4, 4, 4, 6, 8]) + rng.choice(["x", "x", "x", "# c", ""]) for _ in range(size)]
        found = scopes.IndentScopes(lines)
        depth = [len(line) - len(line.lstrip()) for line in lines]
        for start in range(1, size + 1):
            last = start
            for k in range(start, size):
                if lines[k].strip() and not lines[k].lstrip().startswith("#"):
                    if depth[k] <= depth[start - 1]:
                        break
                    last = k + 1
            assert found.end(start) == max(last, start + 1)
