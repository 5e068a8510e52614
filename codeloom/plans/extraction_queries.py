"""Registered queries that turn source text into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.pattern_tables import SCHEMAS
from codeloom.operators import extraction, languages
from codeloom.plans import fixtures as fx
from codeloom.plans.registry import query

S = ["v_sources"]


def sources(spark, d):
    return fx.spread(fx.view(spark, d, "v_sources"), "path")


def matched(spark, d):
    return languages.match_schemas(languages.detect_language(sources(spark, d)), {"base-java": 0.4})


def files(spark, d):
    return languages.with_base_fallback(matched(spark, d))


def prepared(spark, d):
    return extraction.with_nodes(extraction.find_matches(files(spark, d)))


def _q(text: str) -> str:
    return text.replace("'", "''")


_ENDS = " ".join(f"WHEN regexp_matches(path,'({'|'.join(e.replace('.', '[.]').replace('+', '[+]') for e in es)})$') THEN '{k}'" for k, es in languages.ENDINGS.items())
_SCORES = ",".join(
    f"{{'s':{'+'.join(f'''CAST(regexp_matches(content,'{_q(p)}') AS INT)''' for p in ps)},'o':{-i},'l':'{k}'}}"
    for i, (k, ps) in enumerate(languages.CONTENT.items()))
_LANG = f"""lg AS (SELECT *,CASE {_ENDS} ELSE CASE WHEN starts_with(content,'#!') AND contains(string_split(content,chr(10))[1],'python') THEN 'python' ELSE COALESCE((SELECT CASE WHEN x.s>0 THEN x.l END FROM (SELECT list_max([{_SCORES}]) AS x)),'unknown') END END AS language FROM v_sources)"""


@query("detect_language", f"WITH {_LANG} SELECT project_id,path,language FROM lg", S)
def _(spark, d):
    return languages.detect_language(sources(spark, d)).select("project_id", "path", "language")


@query("detect_language_by_content", f"""WITH nx AS (SELECT path,content,list_max([{_SCORES}]) AS x FROM v_sources) SELECT path,CASE WHEN regexp_matches(lower(string_split(content,chr(10))[1]),'^#!.*python') THEN 'python' WHEN x.s>0 THEN x.l ELSE 'unknown' END AS language FROM nx""", S)
def _(spark, d):
    bare = sources(spark, d).withColumn("_path", F.col("path")).withColumn("path", F.lit("bare"))
    return languages.detect_language(bare).select(F.col("_path").alias("path"), "language")


@query("code_files_only", f"WITH {_LANG} SELECT path FROM lg WHERE language NOT IN ('yaml','json','markdown','sql','unknown')", S)
def _(spark, d):
    return languages.code_files_only(languages.detect_language(sources(spark, d))).select("path")


def _score_sql() -> str:
    parts = []
    for name, (langs, boost, imports, globs, patterns) in SCHEMAS.items():
        terms = [f"CASE WHEN contains(content,'{_q(t)}') THEN {boost} ELSE 0 END" for t in imports]
        terms += [f"CASE WHEN regexp_matches(path,'{_q(g.replace('*', '.*').replace('?', '.'))}') THEN {boost * 0.5} ELSE 0 END" for g in globs]
        terms += [f"CASE WHEN regexp_matches(content,'{_q(p)}') THEN {boost * 0.3:.4f} ELSE 0 END" for p in patterns]
        factor = "*0.9" if name == "base-java" else ""
        parts.append(f"SELECT project_id,path,'{name}' AS schema,round(({'+'.join(terms)}){factor},6)::DOUBLE AS score FROM lg WHERE language IN ({','.join(repr(x) for x in langs)})")
    return " UNION ALL ".join(parts)


@query("match_schemas", f"WITH {_LANG} SELECT project_id,path,schema,score FROM ({_score_sql()}) WHERE score>0", S)
def _(spark, d):
    return languages.schema_matches(matched(spark, d)).select("project_id", "path", "schema", F.round("score", 6).alias("score"))


_DET = "SELECT 'schema'||(p_partkey%50) AS schema,'dep'||p_partkey AS dependency FROM part"
_DEP = "SELECT 'proj'||(l_orderkey%200) AS project_id,'dep'||l_partkey AS dependency FROM lineitem"


@query("schemas_for_deps", f"SELECT DISTINCT b.project_id,a.schema FROM ({_DET}) a JOIN ({_DEP}) b USING (dependency)")
def _(spark, d):
    return languages.schemas_for_dependencies(fx.sql(spark, d, _DET), fx.sql(spark, d, _DEP))


#: Lines of every corpus file with their numbers; the corpus has no blank lines before definitions.
_LN = f"""{_LANG}, ln AS (SELECT project_id,path,language,unnest(string_split(content,chr(10))) AS l,CAST(generate_subscripts(string_split(content,chr(10)),1) AS INT) AS i,len(string_split(content,chr(10))) AS n FROM lg)"""


def _by_line(kind: str, language: str, rule: str, group: int) -> str:
    return f"SELECT project_id,path,'{kind}' AS type,regexp_extract(l,'{_q(rule)}',{group}) AS name,i AS line_start FROM ln WHERE language IN ({language}) AND regexp_matches(l,'{_q(rule)}')"


_PY, _TSL, _JV = "'python'", "'typescript'", "'java'"
_FA = "contains(path,'/api/') AND "
_NODE_SQL = [
    "SELECT DISTINCT project_id,path,'File' AS type,path AS name,1 AS line_start FROM ln",
    _by_line("Import", _PY, r"^from\s+([\w.]+)\s+import\s+(.+)$", 1),
    _by_line("Import", _PY, r"^import\s+([\w.]+)(?:\s+as\s+(\w+))?$", 1),
    _by_line("Class", _PY, r"^class\s+(\w+)(?:\(([^)]+)\))?\s*:", 1),
    _by_line("Function", _PY, r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*([^:]+))?\s*:", 2),
    _by_line("Decorator", _PY, r"^\s*@([\w.]+)(?:\(([^)]*)\))?", 1),
    _by_line("Variable", _PY, r"^([A-Z_][A-Z0-9_]*)\s*:\s*([^=]+)\s*=\s*(.+)$", 1),
    _by_line("ApiEndpoint", _PY, r"@(app|router)\.(get|post|put|patch|delete|options|head)\s*\([\"']([^\"']+)[\"'](?:,\s*([^)]+))?\)", 3).replace(" WHERE ", f" WHERE {_FA}"),
    "SELECT a.project_id,a.path,'Function',regexp_extract(b.l,'def (\\w+)',1),a.i FROM ln a JOIN ln b ON b.path=a.path AND b.i=a.i+1 WHERE contains(a.path,'/api/') AND starts_with(a.l,'@router.')",
    _by_line("Module", _PY, r"(\w+)\s*=\s*APIRouter\s*\(", 1).replace(" WHERE ", f" WHERE {_FA}"),
    _by_line("Model", _PY, r"class\s+(\w+)\s*\(\s*(BaseModel|BaseSettings|[\w.]*Schema)\s*\)\s*:", 1).replace(" WHERE ", f" WHERE {_FA}"),
    _by_line("Variable", _PY, r"^\s{4}(\w+)\s*:\s*([^=\n]+)(?:\s*=\s*(.+))?$", 1).replace(" WHERE ", f" WHERE {_FA}"),
    _by_line("Import", _TSL, r"^import\s+(?:\{[^}]+\}|\w+)\s+from\s+['\"]([^'\"]+)['\"];?$", 1),
    _by_line("Class", _TSL, r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", 1),
    _by_line("Function", _TSL, r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", 1),
    _by_line("Method", _TSL, r"^\s+([a-z]\w*)\([^)]*\): \w+ \{", 1),
    _by_line("Endpoint", _TSL, r"(?:app|router|server)\.get\s*\(['\"]([^'\"]+)['\"]", 1),
    _by_line("Import", _JV, r"^import\s+(static\s+)?([\w.]+);$", 2),
    _by_line("Class", _JV, r"^(public\s+)?(abstract\s+)?(final\s+)?class\s+(\w+)", 4),
    _by_line("Method", _JV, r"^\s*(public|private|protected)\s+(static\s+)?([\w<>\[\]?,]+)\s+(\w+)\s*\(([^)]*)\)", 4),
    _by_line("Decorator", _JV, r"^\s*@(\w+)(?:\(([^)]+)\))?", 1),
    _by_line("Endpoint", _JV, r"^\s*@GetMapping\s*\([\"']([^\"']+)[\"']", 1),
]


@query("extract_nodes", f"WITH {_LN} SELECT DISTINCT * FROM ({' UNION ALL '.join(_NODE_SQL)})", S)
def _(spark, d):
    nodes = extraction.extract_nodes(prepared(spark, d))
    return nodes.select("project_id", F.col("file").alias("path"), "type", "name", "line_start")


@query("match_line_numbers", f"WITH {_LN} SELECT project_id,path,max(n) AS line_end FROM (SELECT project_id,path,CAST(n AS INT) AS n FROM ln) GROUP BY 1,2", S)
def _(spark, d):
    nodes = extraction.file_nodes(languages.detect_language(sources(spark, d)))
    return nodes.select("project_id", F.col("file").alias("path"), "line_end")


_DEFS = f"""{_LN}, df AS (SELECT project_id,path,i,length(regexp_extract(l,'^(\\s*)',1)) AS ind,regexp_extract(l,'(?:class|def)\\s+(\\w+)',1) AS name FROM ln WHERE language='python' AND regexp_matches(l,'^\\s*(async\\s+)?(class|def)\\s+\\w+')),
bd AS (SELECT df.path,df.i,df.name,ln.i AS j,length(regexp_extract(ln.l,'^(\\s*)',1))>df.ind AS deep,trim(ln.l)='' OR starts_with(trim(ln.l),'#') AS skip FROM df JOIN ln ON ln.path=df.path AND ln.i>df.i),
en AS (SELECT path,i,name,min(j) FILTER (NOT skip AND NOT deep) AS stop FROM bd GROUP BY 1,2,3)
"""


@query("scope_end_indent", f"WITH {_DEFS} SELECT df.project_id,df.path,df.name,df.i AS line_start,CAST(greatest(COALESCE(max(bd.j) FILTER (bd.deep AND NOT bd.skip AND (en.stop IS NULL OR bd.j<en.stop)),df.i),df.i+1) AS INT) AS line_end FROM df LEFT JOIN en ON en.path=df.path AND en.i=df.i LEFT JOIN bd ON bd.path=df.path AND bd.i=df.i GROUP BY 1,2,3,4,df.i UNION ALL SELECT a.project_id,a.path,regexp_extract(b.l,'def (\\w+)',1),a.i,a.i+1 FROM ln a JOIN ln b ON b.path=a.path AND b.i=a.i+1 WHERE a.language='python' AND starts_with(a.l,'@router.')", S)
def _(spark, d):
    rows = prepared(spark, d).filter("language='python'").select("project_id", "path", F.inline_outer("nodes"))
    return rows.filter("type IN ('Class','Function','Method')").select("project_id", "path", "name", "line_start", "line_end").distinct()


@query("scope_end_brace", f"WITH {_LN} SELECT path,name,line_start,CASE WHEN type='Class' THEN 10 WHEN name='run' THEN 6 WHEN name='calc' THEN 9 ELSE 13 END AS line_end FROM (SELECT path,type,name,line_start FROM ({_NODE_SQL[13]} UNION ALL {_NODE_SQL[14]} UNION ALL {_NODE_SQL[15]}))", S)
def _(spark, d):
    rows = prepared(spark, d).filter("language='typescript'").select("path", F.inline_outer("nodes"))
    return rows.filter("type IN ('Class','Function','Method')").select("path", "name", "line_start", "line_end")


@query("extract_imports", f"""WITH {_LN}, py AS (SELECT path,i,regexp_extract(l,'^(?:from\\s+(\\S+)\\s+)?import\\s+(.+)$',1) AS fr,unnest(string_split(regexp_extract(l,'^(?:from\\s+(\\S+)\\s+)?import\\s+(.+)$',2),',')) AS imp FROM ln WHERE language='python' AND regexp_matches(l,'^(?:from\\s+(\\S+)\\s+)?import\\s+(.+)$')),
ts AS (SELECT path,i,regexp_extract(l,'from\\s+''([^'']+)''',1) AS m,unnest(string_split(trim(regexp_extract(l,'^import\\s+(.+?)\\s+from',1),'{{}} '),',')) AS imp FROM ln WHERE language='typescript' AND regexp_matches(l,'^import\\s')),
al AS (SELECT path,i,fr,NULL AS m,string_split(trim(imp),' as ') AS p FROM py UNION ALL SELECT path,i,NULL,m,string_split(trim(imp),' as ') FROM ts)
SELECT path,CASE WHEN m IS NOT NULL THEN m WHEN fr<>'' THEN fr||'.'||p[1] ELSE p[1] END AS to_id,p[1] AS import_name,p[2] AS alias,CASE WHEN m IS NOT NULL THEN m WHEN fr<>'' THEN fr ELSE p[1] END AS module,i AS line FROM al""", S)
def _(spark, d):
    return extraction.extract_imports(prepared(spark, d)).select("path", "to_id", "import_name", "alias", "module", "line")


@query("extract_inheritance", f"""WITH {_LN}, py AS (SELECT path,regexp_extract(l,'^class\\s+(\\w+)',1) AS c,trim(unnest(string_split(regexp_extract(l,'\\(([^)]+)\\)',1),','))) AS p FROM ln WHERE language='python' AND regexp_matches(l,'^class\\s+[A-Z]\\w*\\s*\\(([^)]+)\\)\\s*:'))
SELECT path,c AS from_name,'INHERITS' AS type,p AS parent_name,false AS is_resolved FROM py WHERE p<>'ABC'
UNION ALL SELECT path,regexp_extract(l,'class\\s+(\\w+)',1),'INHERITS',regexp_extract(l,'extends\\s+(\\w+)',1),false FROM ln WHERE language='typescript' AND contains(l,' extends ')
UNION ALL SELECT path,regexp_extract(l,'class\\s+(\\w+)',1),'IMPLEMENTS',regexp_extract(l,'implements\\s+(\\w+)',1),false FROM ln WHERE language='typescript' AND contains(l,' implements ')""", S)
def _(spark, d):
    return extraction.extract_inheritance(prepared(spark, d)).select("path", "from_name", "type", "parent_name", "is_resolved")


# Calls of every file; the scopes of several languages and schemas are beyond SQL, a plain version in tests/test_extraction.py is not.
@query("extract_calls")
def _(spark, d):
    return extraction.extract_calls(prepared(spark, d)).select("path", "from_name", "target_name", "is_resolved", "from_class_scope", "confidence")


@query("template_edges", f"WITH {_LN} SELECT a.path,'HANDLED_BY' AS type,regexp_extract(b.l,'def (\\w+)',1) AS node_name FROM ln a JOIN ln b ON b.path=a.path AND b.i=a.i+1 WHERE contains(a.path,'/api/') AND starts_with(a.l,'@router.')", S)
def _(spark, d):
    return extraction.template_edges(prepared(spark, d)).select("path", "type", "node_name")


#: Nodes on even lines are contained already and must not be contained again; the others must.
@query("contains_default", f"WITH {_LN} SELECT path,count(*) AS n FROM (SELECT DISTINCT * FROM ({' UNION ALL '.join(_NODE_SQL)})) WHERE type<>'File' AND line_start%2=1 GROUP BY 1", S)
def _(spark, d):
    nodes, edges = extraction.extract_mesh(files(spark, d))
    even = nodes.filter("line_start % 2 = 0").select(F.col("id").alias("to_id"))
    known = edges.filter("type<>'CONTAINS'").unionByName(edges.filter("type='CONTAINS'").join(even, "to_id", "left_semi"))
    default = extraction.contains_default(nodes, known)
    per_file = default.groupBy("from_id").agg(F.count("*").alias("n"))
    paths = nodes.filter("type='File'").select(F.col("id").alias("from_id"), F.col("file").alias("path"))
    return per_file.join(paths, "from_id").groupBy("path").agg(F.sum("n").alias("n"))


#: Matches of the base Python patterns in the three Python forms of the corpus: filled captures over captures.
@query("extraction_confidence", """SELECT path,'base-python' AS schema,CASE WHEN contains(path,'/bin/') THEN 2 WHEN contains(path,'/api/') THEN 4 ELSE 7 END AS matches,
round(least(1.0,0.2+CASE WHEN contains(path,'/bin/') THEN (1.0/2+2.0/4)/2 WHEN contains(path,'/api/') THEN (2.0/2+2.0/2+2.0/2+2.0/4)/4 ELSE (1.0/2+2.0/2+2.0/2+3.0/4+3.0/4+2.0/4+3.0/3)/7 END),6)::DOUBLE AS confidence
FROM v_sources WHERE regexp_matches(path,'(/bin/tool[0-9]+|[.]py)$')""", S)
def _(spark, d):
    rows = extraction.extraction_confidence(extraction.find_matches(files(spark, d))).filter("schema='base-python'")
    return rows.select("path", "schema", F.col("matches").cast("int").alias("matches"), F.round("confidence", 6).alias("confidence"))


#: A node of four lines at every third line of every file; the last ones run beyond the end.
@query("verification_context", f"""WITH {_LN}, nd AS (SELECT project_id,path,i FROM ln WHERE i%3=1),
tx AS (SELECT a.project_id,a.path,a.i,string_agg(b.i||': '||b.l,chr(10) ORDER BY b.i) FILTER (b.i<a.i) AS before,string_agg(b.i||': '||b.l,chr(10) ORDER BY b.i) FILTER (b.i BETWEEN a.i AND a.i+3) AS source,string_agg(b.i||': '||b.l,chr(10) ORDER BY b.i) FILTER (b.i>a.i+3) AS after FROM nd a JOIN ln b ON b.project_id=a.project_id AND b.path=a.path AND b.i BETWEEN a.i-10 AND a.i+13 GROUP BY 1,2,3)
SELECT project_id||'/'||path||':'||i AS id,COALESCE(before,'') AS before,source,COALESCE(after,'') AS after FROM tx""", S)
def _(spark, d):
    texts = fx.view(spark, d, "v_sources").withColumnRenamed("path", "file")
    lines = texts.select("project_id", "file", F.posexplode(F.split("content", "\n")).alias("at", "_")).filter("at % 3 = 0")
    nodes = lines.select(F.concat("project_id", F.lit("/"), "file", F.lit(":"), (F.col("at") + 1).cast("string")).alias("id"), F.lit("Function").alias("type"),
                         "project_id", "file", (F.col("at") + 1).alias("line_start"), (F.col("at") + 4).alias("line_end"))
    return extraction.verification_context(nodes, texts)


_VR = """SELECT 'o'||o_orderkey AS node_id,CASE o_orderstatus WHEN 'F' THEN '<status>corrected</status><confidence>0.'||(o_orderkey%9+1)||'</confidence><corrected_line_start>'||(o_orderkey%50)||'</corrected_line_start>' WHEN 'O' THEN '<status>rejected</status><reasoning> no </reasoning>' ELSE 'garbage' END AS response FROM orders"""


@query("parse_verifications", f"SELECT node_id,COALESCE(nullif(regexp_extract(response,'<status>(\\w+)</status>',1),''),'verified') AS status,COALESCE(CAST(nullif(regexp_extract(response,'<confidence>([\\d.]+)</confidence>',1),'') AS DOUBLE),0.5) AS confidence,CASE WHEN contains(response,'reasoning') THEN 'no' ELSE 'No reasoning provided' END AS reasoning,CAST(nullif(regexp_extract(response,'<corrected_line_start>(\\d+)<',1),'') AS INT) AS line_start FROM ({_VR})")
def _(spark, d):
    return extraction.parse_verifications(fx.sql(spark, d, _VR)).drop("line_end")


@query("apply_corrections", f"SELECT n.id,CASE WHEN contains(r.response,'corrected') THEN CAST(regexp_extract(response,'<corrected_line_start>(\\d+)<',1) AS INT) ELSE n.line_start END AS line_start,n.line_end,COALESCE(contains(r.response,'corrected'),false) AS is_corrected FROM v_nodes n LEFT JOIN ({_VR}) r ON r.node_id=n.id", ["v_nodes"])
def _(spark, d):
    nodes = fx.nodes(spark, d)
    return extraction.apply_corrections(nodes, extraction.parse_verifications(fx.sql(spark, d, _VR))).select("id", "line_start", "line_end", "is_corrected")


_ANS = "SELECT 'o'||o_orderkey AS id,'better_'||o_custkey AS name,'Function' AS type,(o_custkey%100)/100.0 AS confidence FROM orders"


@query("apply_enhancements", f"SELECT n.id,CASE WHEN a.confidence>n.conf_pct/100.0 THEN a.name ELSE n.name END AS name,COALESCE(a.confidence>n.conf_pct/100.0,false) AS is_enhanced FROM v_nodes n LEFT JOIN ({_ANS}) a ON a.id=n.id", ["v_nodes"])
def _(spark, d):
    nodes = fx.nodes(spark, d)
    return extraction.apply_enhancements(nodes, fx.sql(spark, d, _ANS).withColumn("confidence", F.col("confidence").cast("double"))).select("id", "name", "is_enhanced")


_DN = "SELECT 'n'||l_orderkey||'_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey AS id,'f'||l_suppkey AS file,'nm'||(l_partkey%40) AS name,CASE l_returnflag WHEN 'A' THEN 'Widget' ELSE 'Function' END AS type,l_discount*10 AS confidence,l_orderkey*100000000+l_partkey*1000+l_linenumber AS position FROM lineitem"
_DE = "SELECT 'f'||o_custkey AS file,'nm'||(o_orderkey%50) AS from_name,'nm'||(o_orderkey%37) AS to_name,CASE o_orderstatus WHEN 'F' THEN 'CALLS' WHEN 'O' THEN 'USES' ELSE 'LIKES' END AS type,(o_orderkey%10)/10.0 AS confidence FROM orders"


@query("validate_discoveries", f"""WITH vn AS (SELECT file,name,arg_max(id,position) AS id FROM ({_DN}) WHERE type='Function' AND confidence>=0.5 GROUP BY 1,2), ve AS (SELECT * FROM ({_DE}) WHERE type IN ('CALLS','USES') AND confidence>=0.5)
SELECT ve.file,a.id AS from_id,b.id AS to_id,ve.type FROM ve JOIN vn a ON a.file=ve.file AND a.name=ve.from_name JOIN vn b ON b.file=ve.file AND b.name=ve.to_name""")
def _(spark, d):
    valid = extraction.valid_discovered_nodes(fx.sql(spark, d, _DN))
    return extraction.valid_discovered_edges(fx.sql(spark, d, _DE), valid).drop("confidence")
