"""Registered queries over file context and configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import context, languages
from codeloom.plans import fixtures as fx
from codeloom.plans.extraction_queries import _LN, sources
from codeloom.plans.registry import query

S = ["v_sources"]


def _files(spark, d):
    return languages.detect_language(sources(spark, d))


@query("parse_imports", f"""WITH {_LN}, m AS (SELECT path,i,language,l,CASE WHEN language='python' AND starts_with(l,'import ') THEN regexp_extract(l,'^import\\s+([\\w.]+)',1) WHEN language='python' AND starts_with(l,'from ') THEN regexp_extract(l,'^from\\s+([\\w.]+)\\s+import',1) WHEN language='typescript' AND starts_with(l,'import ') THEN regexp_extract(l,'from ''([^'']+)''',1) END AS module FROM ln)
SELECT path,i AS line,module,CASE WHEN language='python' AND starts_with(l,'from ') THEN len(string_split(l,',')) WHEN contains(l,'{{') THEN len(string_split(l,',')) ELSE 1 END AS n_symbols,starts_with(module,'.') OR starts_with(module,'/') AS is_relative,CASE WHEN starts_with(module,'fastapi') THEN 'fastapi' END AS framework FROM m WHERE module IS NOT NULL""", S)
def _(spark, d):
    return context.parse_imports(_files(spark, d)).select(
        "path", "line", "module", F.size("symbols").cast("bigint").alias("n_symbols"), "is_relative", "framework")


_MAN = """SELECT 'proj'||p_partkey AS project_id,CASE p_size%3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'pyproject.toml' ELSE 'requirements.txt' END AS file,CASE p_size%3 WHEN 0 THEN '{"name":"x","dependencies":{"react":"^'||p_size||'","lib'||p_partkey||'":"1.0"},"devDependencies":{"jest":"2"}}' WHEN 1 THEN '[project]'||chr(10)||'dependencies = ['||chr(10)||'  "fastapi>=0.1",'||chr(10)||'  "lib'||p_partkey||'",'||chr(10)||']' ELSE 'django==4'||chr(10)||'# note'||chr(10)||'lib-'||p_partkey||'>=1' END AS content FROM part"""
_DEPS = f"""mn AS ({_MAN}), dp AS (SELECT project_id,'react' AS dependency,'^'||regexp_extract(content,'"react":"\\^(\\d+)"',1) AS version,false AS is_dev,'framework' AS category FROM mn WHERE file='package.json'
UNION ALL SELECT project_id,'lib'||substr(project_id,5),'1.0',false,'unknown' FROM mn WHERE file='package.json' UNION ALL SELECT project_id,'jest','2',true,'testing' FROM mn WHERE file='package.json'
UNION ALL SELECT project_id,'fastapi','*',false,'unknown' FROM mn WHERE file='pyproject.toml' UNION ALL SELECT project_id,'lib'||substr(project_id,5),'*',false,'unknown' FROM mn WHERE file='pyproject.toml'
UNION ALL SELECT project_id,'django','*',false,'unknown' FROM mn WHERE file='requirements.txt' UNION ALL SELECT project_id,'lib-'||substr(project_id,5),'*',false,'unknown' FROM mn WHERE file='requirements.txt')"""


@query("parse_manifests", f"WITH {_DEPS} SELECT * FROM dp")
def _(spark, d):
    return context.parse_manifests(fx.sql(spark, d, _MAN))


@query("detect_frameworks", f"""WITH {_DEPS}, fw AS (SELECT project_id,CASE dependency WHEN 'react' THEN 'react' WHEN 'jest' THEN 'jest' WHEN 'fastapi' THEN 'fastapi' WHEN 'django' THEN 'django' END AS name FROM dp), d AS (SELECT project_id,name,count(*) AS nd FROM fw WHERE name IS NOT NULL GROUP BY 1,2),
i AS (SELECT project_id,'fastapi' AS name,count(*) AS ni FROM v_sources WHERE contains(path,'/api/') GROUP BY 1)
SELECT project_id,name,round(least(1.0,CASE WHEN ni>0 THEN 0.7+(ni-1)*0.1+COALESCE(nd,0)*0.2 ELSE 0.6+(nd-1)*0.2 END),6)::DOUBLE AS confidence,COALESCE(ni,0) AS n_imports,COALESCE(nd,0) AS n_dependencies FROM d FULL OUTER JOIN i USING (project_id,name)""", S)
def _(spark, d):
    imports = context.parse_imports(_files(spark, d))
    return context.detect_frameworks(imports, context.parse_manifests(fx.sql(spark, d, _MAN)))


_REL = """SELECT 'proj' AS project_id,'src/p'||(l_suppkey%50)||'/f'||l_partkey||'.ts' AS path,CASE l_linenumber%4 WHEN 0 THEN './f'||l_orderkey WHEN 1 THEN '../p'||(l_suppkey%7)||'/f'||(l_orderkey/7) WHEN 2 THEN '@/p1/f'||l_orderkey||'.ts' ELSE './d'||(l_orderkey/9) END AS module,l_linenumber*100000000+l_orderkey AS line FROM lineitem"""
_REL = _REL.replace("(l_orderkey/7)", "CAST(FLOOR(l_orderkey/7) AS BIGINT)").replace("(l_orderkey/9)", "CAST(FLOOR(l_orderkey/9) AS BIGINT)")
_TREE = """SELECT DISTINCT 'proj' AS project_id,'src/p'||(l_suppkey%50)||CASE l_linenumber%3 WHEN 0 THEN '/d'||l_partkey||'/index.js' WHEN 1 THEN '/f'||l_partkey||'.ts' ELSE '/f'||l_partkey||'.tsx' END AS path FROM lineitem"""


@query("related_files", f"""
WITH im AS (SELECT DISTINCT project_id,path,module,line FROM ({_REL})), fl AS ({_TREE}), tg AS (SELECT *,CASE WHEN starts_with(module,'./') THEN regexp_extract(path,'^(.*)/[^/]*$',1)||substr(module,2) WHEN starts_with(module,'../') THEN 'src'||substr(module,3) ELSE 'src'||substr(module,2) END AS t FROM im),
ca AS (SELECT *,t AS r,99 AS pl FROM tg UNION ALL SELECT tg.*,t||e,p FROM tg,(VALUES ('.ts',0),('/index.ts',1),('.tsx',2),('/index.tsx',3),('.js',4),('/index.js',5)) v(e,p) WHERE NOT contains(regexp_extract(t,'[^/]*$'),'.')),
be AS (SELECT path,module,line,arg_min(r,pl) AS resolved FROM ca JOIN fl ON fl.path=ca.r GROUP BY 1,2,3), un AS (SELECT path,resolved,arg_min(module,(line,module)) AS module,min(line) AS line FROM be GROUP BY 1,2)
SELECT path,resolved,module FROM un""".replace("JOIN fl ON fl.path=ca.r", "JOIN (SELECT path AS fp FROM fl) f ON f.fp=ca.r"))
def _(spark, d):
    imports = fx.sql(spark, d, _REL).distinct()
    return context.related_files(imports, fx.sql(spark, d, _TREE), {"@": "src"}).select("path", "resolved", "module")


@query("extract_exports", f"""WITH {_LN}
SELECT path,regexp_extract(l,'^class\\s+(\\w+)',1) AS name,'class' AS kind,rtrim(l,':') AS signature FROM ln WHERE language='python' AND starts_with(l,'class ')
UNION ALL SELECT path,regexp_extract(l,'def\\s+(\\w+)',1),'function',rtrim(replace(l,'async ',''),':') FROM ln WHERE language='python' AND regexp_matches(l,'^(async )?def ')
UNION ALL SELECT path,regexp_extract(l,'class\\s+(\\w+)',1),'class',trim(regexp_extract(l,'(class .*)\\{{',1)) FROM ln WHERE language='typescript' AND starts_with(l,'export class')
UNION ALL SELECT path,regexp_extract(l,'function\\s+(\\w+)',1),'function',trim(regexp_extract(l,'(function .*)\\{{',1)) FROM ln WHERE language='typescript' AND starts_with(l,'export function')
UNION ALL SELECT c.path,regexp_extract(c.l,'class\\s+(\\w+)',1)||'.'||regexp_extract(m.l,'^  (\\w+)\\(',1),'function',regexp_extract(c.l,'class\\s+(\\w+)',1)||'.'||trim(regexp_extract(m.l,'^\\s+(.*)\\{{',1)) FROM ln c JOIN ln m ON m.path=c.path AND regexp_matches(m.l,'^  \\w+\\(.*\\{{') WHERE c.language='typescript' AND starts_with(c.l,'export class')""", S)
def _(spark, d):
    return context.extract_exports(_files(spark, d)).select("path", "name", "kind", "signature")


_ENV = """SELECT 'proj'||o_custkey AS project_id,'# c'||chr(10)||'A_'||o_orderkey||' = "v'||o_orderkey||'"'||chr(10)||'B='||o_orderpriority||'=x'||chr(10)||'bad'||chr(10) AS content,'conf/'||lpad(CAST(o_orderkey AS VARCHAR(20)),12,'0')||'.env' AS path FROM orders"""


@query("parse_env_files", f"WITH e AS ({_ENV}) SELECT project_id,regexp_extract(content,'(A_\\d+)',1) AS name,'v'||regexp_extract(content,'A_(\\d+)',1) AS value FROM e UNION ALL SELECT project_id,'B',arg_max(regexp_extract(content,'\\nB=([^\\n]*)',1),path) FROM e GROUP BY 1")
def _(spark, d):
    return context.parse_env_files(fx.sql(spark, d, _ENV)).drop("method")


_CFG = """SELECT 'proj'||p_partkey AS project_id,'{"db":{"host":"h'||p_partkey||'","port":'||p_size||',"opt":{"on":true,"tags":["a"]}},"z":{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"deep":"first"}}}}}}}},"host":"top","none":null,"b":{"deep":"last'||p_size||'"}}' AS content FROM part"""


@query("flatten_config", f"""WITH c AS ({_CFG}), b AS (SELECT project_id,regexp_extract(content,'"host":"(h\\d+)"',1) AS h,regexp_extract(content,'"port":(\\d+)',1) AS p FROM c)
SELECT project_id,unnest(['db.host','db.port','port','db.opt.on','on','host','z.a.b.c.d.e.f.g.deep','b.deep','deep']) AS name,unnest([h,p,p,'true','true','top','first','last'||p,'last'||p]) AS value FROM b""")
def _(spark, d):
    return context.flatten_config(fx.spread(fx.sql(spark, d, _CFG), "project_id")).drop("method")
