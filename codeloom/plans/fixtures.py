"""Relational views that read the given tables as the library's datasets.

One SQL text per view, valid in Spark and in DuckDB. Spark registers it as a
temporary view; an oracle query prepends it as a common table expression. Every
view reads its base tables whole; CASE expressions only assign roles to rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _lines(text: str) -> str:
    """SQL text with ``~`` standing for a newline in the generated file."""
    return f"replace({text}, '~', chr(10))"


_PY = _lines(
    "'import os~from mod'||(o_custkey%50)||' import helper_'||(o_custkey%97)||', Base'||(o_custkey%13)||' as B'||(o_custkey%13)"
    "||'~class Order'||o_orderkey||'(Base'||(o_custkey%13)||', ABC):~    def total(self, x):~        return helper_'||(o_custkey%97)"
    "||'(x)~    def ship(self):~        # note~        self.total(1)~        return fmt_'||(o_orderkey%31)||'(self.total(2))~def run_'||o_orderkey"
    "||'(a, b):~    o = Order'||o_orderkey||'()~    return o.ship()~LIMIT: int = '||o_orderkey||'~'"
)
_FASTAPI = _lines(
    "'from fastapi import APIRouter, Depends~router = APIRouter(prefix=\"/p'||(o_custkey%20)||'\")~class Item'||o_orderkey"
    "||'(BaseModel):~    name: str~    qty: int = 1~@router.get(\"/items/'||(o_orderkey%7)||'\")~async def list_items_'||o_orderkey"
    "||'(q):~    return load_'||(o_custkey%11)||'(q)~'"
)
_TS = _lines(
    "'import { A'||(o_custkey%9)||', B as C } from ''./mod'||(o_custkey%50)||''';~import def'||(o_custkey%5)||' from ''lib'||(o_custkey%7)"
    "||''';~export class Svc'||o_orderkey||' extends BaseSvc'||(o_custkey%13)||' implements IFace'||(o_custkey%3)"
    "||' {~  run(x: number): number {~    return this.calc(x) + A'||(o_custkey%9)||'(x);~  }~  calc(y: number): number {~    return y;~  }~}~export function make'||o_orderkey"
    "||'(a: string): Svc'||o_orderkey||' {~  return new Svc'||o_orderkey||'();~}~app.get(''/v1/'||(o_custkey%25)||''', handler);~'"
)
_JAVA = _lines(
    "'package com.acme.m'||(o_custkey%9)||';~import com.acme.Base'||(o_custkey%13)||';~public class Ord'||o_orderkey||' extends Base'||(o_custkey%13)"
    "||' {~  @GetMapping(\"/o/'||(o_custkey%25)||'\")~  public String get'||o_orderkey||'(String a) {~    return a;~  }~}~'"
)
_SCRIPT = _lines("'#!/usr/bin/env python3~import sys~def main_'||o_orderkey||'(argv):~    return len(argv)~'")

VIEWS: dict[str, str] = {
    # nodes of the code mesh
    "v_nodes": """
SELECT 'c'||c_custkey AS id,'File' AS type,c_name AS name,'proj'||c_nationkey AS project_id,CASE WHEN c_custkey%3=0 THEN 'dev' ELSE 'main' END AS branch,'src/'||c_mktsegment||'/c'||c_custkey||'.py' AS file,1 AS line_start,1000 AS line_end,100 AS conf_pct,CAST(NULL AS VARCHAR(9)) AS method,CAST(NULL AS VARCHAR(99)) AS path FROM customer
UNION ALL SELECT 'o'||o_orderkey,'Function','fn_'||(o_orderkey%997),'proj'||c_nationkey,CASE WHEN c_custkey%3=0 THEN 'dev' ELSE 'main' END,'src/'||c_mktsegment||'/c'||c_custkey||'.py',CAST((o_orderkey%90)*10+1 AS INT),CAST((o_orderkey%90)*10+6+o_orderkey%20 AS INT),CAST(50+o_orderkey%50 AS INT),NULL,NULL FROM orders JOIN customer ON o_custkey=c_custkey
UNION ALL SELECT 'p'||p_partkey,'Method','m_'||(p_partkey%499),'proj'||(p_partkey%25),'main','lib/'||p_brand||'.ts',CAST((p_partkey%90)*10+2 AS INT),CAST((p_partkey%90)*10+9 AS INT),CAST(40+p_partkey%60 AS INT),NULL,NULL FROM part
UNION ALL SELECT 'k'||p_partkey,'Class','Cls'||p_partkey,'proj'||(p_partkey%25),'main','lib/'||p_brand||'.ts',CAST((p_partkey%90)*10+1 AS INT),CAST((p_partkey%90)*10+10 AS INT),80,NULL,NULL FROM part
UNION ALL SELECT 'm'||n_nationkey,'Model','model_'||n_name,'proj'||n_nationkey,'main','svc/models'||n_nationkey||'.py',CAST(n_nationkey*20+1 AS INT),CAST(n_nationkey*20+9 AS INT),90,NULL,NULL FROM nation
UNION ALL SELECT 's'||s_suppkey,CASE WHEN s_suppkey%2=0 THEN 'Queue' ELSE 'ApiEndpoint' END,s_name,'proj'||s_nationkey,'main','svc/s'||s_suppkey||'.java',1,30,70,CASE WHEN s_suppkey%2=0 THEN NULL WHEN s_suppkey%3=0 THEN 'POST' ELSE 'GET' END,CASE WHEN s_suppkey%2=0 THEN NULL ELSE '/api/'||s_nationkey||'/{id}' END FROM supplier""",
    # edges of the code mesh; about half of the IMPORTS targets do not exist
    "v_edges": """
SELECT DISTINCT 'o'||l_orderkey AS from_id,'p'||l_partkey AS to_id,'CALLS' AS type,false AS cross_project FROM lineitem
UNION ALL SELECT DISTINCT 'o'||l_orderkey,'s'||l_suppkey,CASE WHEN l_suppkey%2=0 THEN 'PUBLISHES_TO' ELSE 'CALLS_SERVICE' END,l_suppkey%2=1 FROM lineitem
UNION ALL SELECT DISTINCT 'p'||p,'s'||s,CASE WHEN s%2=0 THEN 'SUBSCRIBES_TO' ELSE 'USES' END,false FROM (SELECT MAX(l_partkey) AS p,l_suppkey AS s FROM lineitem GROUP BY l_suppkey,l_returnflag) x
UNION ALL SELECT 'k'||p_partkey,'k'||CAST(FLOOR(p_partkey/2) AS BIGINT),'INHERITS',false FROM part WHERE p_partkey>0
UNION ALL SELECT 'c'||o_custkey,'o'||o_orderkey,'CONTAINS',false FROM orders
UNION ALL SELECT 'k'||p_partkey,'p'||p_partkey,'CONTAINS',false FROM part WHERE p_size>25
UNION ALL SELECT 'c'||c_custkey,'c'||(c_custkey*2+1),'IMPORTS',false FROM customer
UNION ALL SELECT DISTINCT 'm'||a.s_nationkey,'m'||b.c_nationkey,CASE WHEN b.c_nationkey%2=0 THEN 'READS_FROM' ELSE 'WRITES_TO' END,false FROM supplier a JOIN customer b ON a.s_suppkey=b.c_custkey""",
    # semantic memory
    "v_beliefs": """
SELECT 'belief-'||d.doc_id AS id,d.text AS content,CAST(d.doc_id%101 AS INT) AS conv_pct,d.source AS domain,d.lang AS category,CAST(d.doc_id%13 AS INT) AS usage_count,COALESCE(l.quality,0) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id""",
    "v_principles": """
SELECT 'principle-'||p_partkey AS id,CASE WHEN p_size>25 THEN 'Never' ELSE 'Prefer to' END||' use '||CASE WHEN p_retailprice>1000 THEN 'regex' WHEN p_size>40 THEN 'keyword lists and regex' ELSE 'keyword rules' END||' for '||p_type||' '||p_name||CASE WHEN p_type='ECONOMY' THEN ' security' WHEN p_type='PROMO' THEN ' validation and logging' WHEN p_type='STANDARD' THEN ' testing' ELSE ' error handling' END AS content,p_type AS domain,CAST(50+p_partkey%51 AS INT) AS conv_pct FROM part""",
    "v_patterns": """
SELECT 'pattern-'||s_suppkey AS id,s_name AS name,'pattern for '||n_name||' '||CASE WHEN s_acctbal>0 THEN 'retry queue' ELSE 'fallback cache' END AS description,n_name AS domain,CAST(s_suppkey%101 AS INT) AS conv_pct,CAST(s_suppkey%17 AS INT) AS usage_count FROM supplier JOIN nation ON s_nationkey=n_nationkey""",
    "v_review_items": """
SELECT 'review-'||event_id AS id,event_type AS item_type,ts AS flagged_at,value>50 AS resolved FROM events""",
    "v_outcomes": """
SELECT event_id,ts,'belief-'||user_id AS belief_id,CASE event_type WHEN 'purchase' THEN 'helpful' WHEN 'click' THEN 'helpful' WHEN 'view' THEN 'not_helpful' WHEN 'error' THEN 'misleading' ELSE 'outdated' END AS outcome FROM events""",
    "v_adjustments": """
SELECT event_id,ts,'belief-'||user_id AS belief_id,CASE event_type WHEN 'purchase' THEN 'reinforce' WHEN 'click' THEN 'reinforce' WHEN 'view' THEN 'weaken' WHEN 'signup' THEN 'modify' ELSE CASE WHEN value>95 THEN 'delete' ELSE 'archive' END END AS action,CASE WHEN value>20 THEN 'text '||event_id ELSE NULL END AS new_content FROM events""",
    # trust
    "v_verifications": """
SELECT event_id,ts,'schema'||(user_id%4) AS schema_id,'pattern'||(user_id%20) AS pattern_name,CASE WHEN event_type='error' AND event_id%7=0 THEN 'rejected' WHEN event_type IN ('error','click') AND user_id%10=3 THEN 'corrected' ELSE 'verified' END AS result FROM events""",
    "v_pattern_versions": """
SELECT DISTINCT 'schema'||(user_id%4)||'/pattern'||(user_id%20)||'/v'||(1+user_id%3) AS id,'schema'||(user_id%4) AS schema_id,'pattern'||(user_id%20) AS name,CAST(1+user_id%3 AS INT) AS version,'re'||(user_id%20) AS regex,user_id%3=2 AND user_id%20<>7 AS is_active FROM events""",
    "v_corrections": """
SELECT event_id AS id,'schema'||(user_id%4)||'/pattern'||(user_id%20) AS pattern_id,'code '||event_id AS snippet,ts AS created_at FROM events""",
    # telemetry
    "v_events": """
SELECT event_id,ts,CASE event_type WHEN 'view' THEN 'memory.search' WHEN 'click' THEN 'mcp.tool.called' WHEN 'purchase' THEN 'mcp.tool.result' WHEN 'error' THEN 'system.error' ELSE 'agent.action' END AS event_type,CASE WHEN value>50 THEN 'mcp' ELSE 'api' END AS source,'u'||user_id AS user_id,props FROM events""",
    "v_calls": """
SELECT 'req-'||o_orderkey AS request_id,'mcp.tool.called' AS event_type,o_orderdate AS ts,'{"tool":"t'||(o_custkey%7)||'"}' AS data FROM orders
UNION ALL SELECT 'req-'||o_orderkey,CASE o_orderstatus WHEN 'F' THEN 'mcp.tool.error' WHEN 'O' THEN 'mcp.tool.result' ELSE 'mcp.tool.late' END,o_orderdate+INTERVAL 1 MINUTE*CASE WHEN o_orderkey%5=0 THEN 45 ELSE 1 END,CASE o_orderstatus WHEN 'F' THEN '{"error":"e'||(o_orderkey%9)||'"}' ELSE '{"count":'||(o_orderkey%9)||'}' END FROM orders""",
    "v_usage": """
SELECT conv_id,turn,CASE conv_id%5 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'O1' WHEN 2 THEN 'gpt-4o-2024-08-06' WHEN 3 THEN 'gemma2-9b-it' ELSE 'unknown-model' END AS model_id,CASE WHEN conv_id%2=0 THEN 'openai' ELSE 'other' END AS provider,CASE WHEN role='assistant' THEN 0 ELSE CAST(FLOOR(length(text)/4) AS BIGINT) END AS prompt_tokens,CASE WHEN role='assistant' THEN CAST(FLOOR(length(text)/4) AS BIGINT) ELSE 0 END AS completion_tokens FROM conversations""",
    # change review
    "v_file_changes": """
SELECT 'r'||(l_orderkey%200) AS review_id,CASE l_linenumber%7 WHEN 0 THEN 'src/auth/f' WHEN 1 THEN 'src/api/f' WHEN 2 THEN 'tests/test_f' WHEN 3 THEN 'docs/f' WHEN 4 THEN 'dist/f' WHEN 5 THEN 'src/core/f' ELSE 'src/models/f' END||l_partkey||CASE l_linenumber%7 WHEN 3 THEN '.md' ELSE '.py' END AS path,CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines_added,CAST(SUM(l_linenumber) AS BIGINT) AS lines_deleted,false AS is_binary FROM lineitem GROUP BY 1,2""",
    "v_diffs": "SELECT 'd'||o_orderkey AS diff_id,"
    + _lines(
        "'diff --git a/src/m'||o_orderkey||'.py b/src/m'||o_orderkey||'.py~index 11..22 100644~--- a/src/m'||o_orderkey||'.py~+++ b/src/m'||o_orderkey"
        "||'.py~@@ -1,3 +1,4 @@ def f'||o_orderkey||'~ ctx~-old '||o_custkey||'~+new~+'||CASE WHEN o_orderstatus='P' THEN '' ELSE 'x' END||'~@@ -20 +21,2 @@~ y~+z~'"
        "||'diff --git a/old'||o_custkey||'.ts b/new'||o_custkey||'.ts~rename from old'||o_custkey||'.ts~rename to new'||o_custkey||'.ts~'"
        "||CASE WHEN o_orderstatus='F' THEN 'diff --git a/img.png b/img.png~new file mode 100644~Binary files differ~' ELSE 'diff --git a/gone.go b/gone.go~deleted file mode 100644~--- a/gone.go~+++ /dev/null~@@ -1,2 +0,0 @@~-a~-  ~' END"
    )
    + " AS diff FROM orders",
    "v_responses": "SELECT 'e'||event_id AS response_id,'src/f'||user_id||'.py' AS file,"
    + _lines(
        "'<summary> Seen '||event_type||' ~</summary>'||CASE WHEN event_type='view' THEN '' ELSE '<issue severity=\"'||CASE event_type WHEN 'error' THEN 'blocking' WHEN 'click' THEN 'warning' ELSE 'suggestion' END||'\"><message>Missing '||CASE WHEN value>60 THEN 'validation' WHEN value>30 THEN 'error handling' ELSE 'docs' END||'~ here</message><line>'||(event_id%300)||'</line></issue>' END||CASE WHEN value>50 THEN '<issue severity=''warning''><suggestion>log it</suggestion></issue>' ELSE '' END"
    )
    + " AS response FROM events",
    # links between projects
    "v_refs": """
SELECT 'api' AS type,CASE WHEN s_suppkey%3=0 THEN 'POST ' ELSE 'GET ' END||'/api/'||s_nationkey||'/items' AS identifier,'consume' AS direction,'s'||s_suppkey AS node_id,'proj'||s_nationkey AS project_id FROM supplier
UNION ALL SELECT 'api',CASE c_custkey%3 WHEN 0 THEN 'https://h'||(c_custkey%5)||'.example.com/api/'||(c_custkey%25)||'/items?x=1' WHEN 1 THEN 'GET /api/'||(c_custkey%25)||'/items' ELSE 'get /API/'||(c_custkey%25)||'/items' END,'produce','c'||c_custkey,'proj'||c_nationkey FROM customer
UNION ALL SELECT 'queue',CASE WHEN o_orderkey%7=0 THEN '$'||'{QUEUE_'||o_custkey||'}' WHEN o_orderkey%3=0 THEN 'arn:aws:sqs:eu:1:q'||o_custkey WHEN o_orderkey%3=1 THEN 'Q'||o_custkey ELSE 'q'||o_custkey END,CASE o_orderkey%5 WHEN 0 THEN 'produce' WHEN 1 THEN 'consume' ELSE 'both' END,'o'||o_orderkey,'proj'||(o_orderkey%25) FROM orders""",
    "v_config": """
SELECT DISTINCT 'proj'||(o_orderkey%25) AS project_id,'QUEUE_'||o_custkey AS name,CASE o_orderstatus WHEN 'F' THEN 'q' WHEN 'O' THEN 'Q' ELSE 'x.q' END||o_custkey AS value,CASE o_orderstatus WHEN 'F' THEN 'env' WHEN 'O' THEN 'docker-compose' ELSE 'config' END AS method FROM orders""",
    # source text and repository history
    "v_sources": "SELECT 'svc'||(o_custkey%25)||CASE o_orderpriority WHEN '1-URGENT' THEN '/m'||o_orderkey||'.py' WHEN '2-HIGH' THEN '/api/m'||o_orderkey||'.py' WHEN '3-MEDIUM' THEN '/m'||o_orderkey||'.ts' WHEN '5-LOW' THEN '/bin/tool'||o_orderkey ELSE '/M'||o_orderkey||'.java' END AS path,'proj'||(o_custkey%25) AS project_id,CASE o_orderpriority WHEN '1-URGENT' THEN "
    + _PY + " WHEN '2-HIGH' THEN " + _FASTAPI + " WHEN '3-MEDIUM' THEN " + _TS + " WHEN '5-LOW' THEN " + _SCRIPT + " ELSE " + _JAVA
    + " END AS content FROM orders",
    "v_name_status": "SELECT 'run'||o_custkey AS range_id,CASE o_orderstatus WHEN 'F' THEN 'A'||chr(9)||'src/m'||o_orderkey||'.py' WHEN 'O' THEN 'M'||chr(9)||'src/m'||o_orderkey||'.py' ELSE CASE WHEN o_orderkey%2=0 THEN 'R087'||chr(9)||'src/old'||o_orderkey||'.py'||chr(9)||'src/m'||o_orderkey||'.py' ELSE CASE WHEN o_orderkey%3=0 THEN 'C100'||chr(9)||'a'||chr(9)||'b' ELSE 'D'||chr(9)||'src/m'||o_orderkey||'.py' END END END AS line FROM orders",
    "v_runs": """
SELECT 'run'||o_orderkey AS id,'proj'||(o_custkey%25) AS project_id,CASE o_orderstatus WHEN 'F' THEN 'main' ELSE 'dev' END AS branch,md5('c'||o_orderkey) AS commit_sha,o_orderdate AS extracted_at,CAST(o_orderkey%40 AS INT) AS files_processed,CAST(o_custkey%5 AS INT) AS files_skipped FROM orders""",
    "v_file_results": """
SELECT 'f'||l_orderkey||'_'||l_partkey||'_'||l_suppkey||'_'||l_linenumber AS file,CASE l_returnflag WHEN 'A' THEN 'python' WHEN 'N' THEN 'typescript' ELSE 'java' END AS language,CAST(1+l_linenumber%3 AS INT) AS tier,CAST(FLOOR(l_quantity) AS INT) AS n_nodes,CAST(l_linenumber AS INT) AS n_edges,CAST(l_partkey%5 AS INT) AS corrections,CAST(CASE WHEN l_suppkey%10=0 THEN 1 ELSE 0 END AS INT) AS rejections,CAST(FLOOR(l_quantity)+l_linenumber AS INT) AS expected_nodes,'schema'||(l_suppkey%8) AS schema_id,CAST(FLOOR(l_extendedprice) AS BIGINT) AS size FROM lineitem""",
}


def register(spark: SparkSession, sf_dir: str, text: str | None = None) -> None:
    """Temporary views for the base tables, or for those a SQL text names."""
    words = set(re.findall(r"\w+", text)) if text is not None else set(TABLES)
    for table in TABLES:
        if table in words:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    register(spark, sf_dir, text)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in ``sf_dir``."""
    return sql(spark, sf_dir, VIEWS[name])


#: Rows of generated text in a task.
SPREAD_ROWS = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Generated text over all cores: it is far larger than the table it derives
    from, whose few row groups would otherwise fix the number of tasks. Tasks grow
    in number with the rows, which are counted from the footers of the files, not in size."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(tasks, key)


def ctes(*names: str) -> str:
    """``WITH`` text defining the named views, to be followed by a query."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_nodes`` in the library's layout, with the properties map."""
    raw = view(spark, sf_dir, "v_nodes")
    bag = F.map_filter(
        F.create_map(F.lit("method"), F.col("method"), F.lit("path"), F.col("path")),
        lambda _, v: v.isNotNull(),
    )
    return raw.select(
        "id", "type", "name", "project_id", "branch", "file", "line_start", "line_end",
        (F.col("conf_pct") / 100.0).alias("confidence"),
        bag.alias("properties"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_edges")


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_beliefs").withColumn("conviction", F.col("conv_pct") / 100.0)


def principles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_principles").withColumn("conviction", F.col("conv_pct") / 100.0)


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_patterns").withColumn("conviction", F.col("conv_pct") / 100.0)
