"""Registered queries over change reviews, telemetry and project links."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators import extraction, linking, review, telemetry
from codeloom.plans import fixtures as fx
from codeloom.plans.registry import query

FC, DF, RS = ["v_file_changes"], ["v_diffs"], ["v_responses"]


def _alt(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


_CLASS = (
    f"CASE WHEN is_binary OR regexp_matches(path,'{_alt(review.NOISE)}') THEN 'noise' WHEN regexp_matches(path,'{_alt(review.CRITICAL_PATHS + review.CRITICAL_FILES)}') THEN 'critical' "
    f"WHEN regexp_matches(path,'{_alt(review.TESTS + review.DOCS)}') THEN CASE WHEN lines_added+lines_deleted>50 THEN 'important' ELSE 'minor' END "
    f"WHEN regexp_matches(path,'{_alt(review.IMPORTANT)}') THEN 'important' WHEN lines_added+lines_deleted>50 THEN 'important' ELSE 'minor' END"
)


@query("classify_files", f"SELECT review_id,path,lines_added+lines_deleted AS lines_changed,{_CLASS} AS file_class FROM v_file_changes", FC)
def _(spark, d):
    return review.classify_files(fx.view(spark, d, "v_file_changes")).select("review_id", "path", "lines_changed", "file_class")


@query("prioritize_files", f"""WITH c AS (SELECT review_id,path,lines_added+lines_deleted AS lines_changed,{_CLASS} AS file_class FROM v_file_changes),
r AS (SELECT *,count(*) FILTER (file_class='critical') OVER (PARTITION BY review_id) AS nc,row_number() OVER (PARTITION BY review_id ORDER BY CASE file_class WHEN 'critical' THEN 0 WHEN 'important' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END,lines_changed DESC,path) AS rn FROM c)
SELECT review_id,path,file_class,lines_changed,file_class='critical' OR (file_class<>'noise' AND rn<=20) AS to_review FROM r""", FC)
def _(spark, d):
    return review.prioritize_files(fx.view(spark, d, "v_file_changes"), 20)


_DOM = "CASE " + " ".join(f"WHEN regexp_matches(lower(path),'{'|'.join(v)}') THEN '{k}'" for k, v in review.DOMAINS.items()) + " END"


@query("detect_domain", f"SELECT review_id,path,{_DOM} AS domain FROM v_file_changes", FC)
def _(spark, d):
    return review.detect_domain(fx.view(spark, d, "v_file_changes")).select("review_id", "path", "domain")


#: Orders as reviews of a few files, with and without tests, API and documentation.
_ORDERS = """SELECT 'o'||l_orderkey AS review_id,CASE l_partkey%9 WHEN 0 THEN 'src/routes/f' WHEN 1 THEN 'src/api/f' WHEN 2 THEN 'tests/test_f' WHEN 3 THEN 'guide/f' WHEN 4 THEN 'Docs/f' ELSE 'src/core/f' END||l_suppkey||'_'||l_linenumber||CASE l_partkey%9 WHEN 3 THEN '.md' ELSE '.py' END AS path,CAST(FLOOR(l_quantity) AS INT) AS lines_added,CAST(l_linenumber AS INT) AS lines_deleted FROM lineitem"""


@query("cross_file_findings", f"""WITH f AS (SELECT review_id,count(*) AS n,bool_or(contains(lower(path),'test')) AS t,count(*) FILTER (NOT contains(lower(path),'test') AND lines_added+lines_deleted>20) AS b,bool_or(contains(lower(path),'api') OR contains(lower(path),'routes')) AS a,bool_or(ends_with(path,'.md') OR contains(lower(path),'doc')) AS o FROM ({_ORDERS} UNION ALL SELECT review_id,path,lines_added,lines_deleted FROM v_file_changes) GROUP BY 1)
SELECT review_id,'warning' AS severity,'missing_tests' AS finding,b AS n_files FROM f WHERE n>=2 AND NOT t AND b>0 UNION ALL SELECT review_id,'suggestion','missing_docs',0 FROM f WHERE n>=2 AND a AND NOT o""", FC)
def _(spark, d):
    columns = ["review_id", "path", "lines_added", "lines_deleted"]
    return review.cross_file_findings(fx.sql(spark, d, _ORDERS).unionByName(fx.view(spark, d, "v_file_changes").select(*columns)))


_LINES = """ln AS (SELECT diff_id,i,l,sum(CASE WHEN regexp_matches(l,'^diff --git a/.+ b/.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS fno,sum(CASE WHEN regexp_matches(l,'^@@ -\\d+(?:,\\d+)? \\+\\d+(?:,\\d+)? @@') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY i) AS hno FROM (SELECT diff_id,unnest(string_split(diff,chr(10))) AS l,generate_subscripts(string_split(diff,chr(10)),1) AS i FROM v_diffs)),
lf AS (SELECT *,min(hno) OVER (PARTITION BY diff_id,fno) AS h0,first_value(l) OVER (PARTITION BY diff_id,fno ORDER BY i) AS hd FROM ln WHERE fno>0),
fi AS (SELECT diff_id,CAST(fno-1 AS INT) AS file_no,regexp_extract(any_value(hd),'^diff --git a/(.+) b/(.+)$',2) AS path,regexp_extract(any_value(hd),'^diff --git a/(.+) b/(.+)$',1) AS oldp,max(CASE WHEN starts_with(l,'rename from ') THEN substr(l,13) END) AS ren,COALESCE(arg_max(CASE WHEN starts_with(l,'new file mode') THEN 'added' WHEN starts_with(l,'deleted file mode') THEN 'deleted' WHEN starts_with(l,'rename from ') THEN 'renamed' END,i) FILTER (starts_with(l,'new file mode') OR starts_with(l,'deleted file mode') OR starts_with(l,'rename from ')),'modified') AS status,bool_or(starts_with(l,'Binary files')) AS is_binary,count(*) FILTER (hno>h0 AND starts_with(l,'+') AND NOT starts_with(l,'+++')) AS lines_added,count(*) FILTER (hno>h0 AND starts_with(l,'-') AND NOT starts_with(l,'---')) AS lines_deleted,count(DISTINCT hno) FILTER (hno>h0) AS n_hunks FROM lf GROUP BY 1,2)"""


def _files(spark, d):
    return review.diff_files(fx.spread(fx.view(spark, d, "v_diffs"), "diff_id"))


@query("parse_diff", f"WITH {_LINES} SELECT diff_id,file_no,path,CASE WHEN ren IS NOT NULL THEN ren WHEN oldp<>path THEN oldp END AS old_path,status,is_binary,lines_added,lines_deleted,CAST(n_hunks AS INT) AS n_hunks FROM fi", DF)
def _(spark, d):
    return _files(spark, d).withColumn("n_hunks", F.size("hunks")).drop("raw_diff", "hunks")


@query("diff_hunks", f"""WITH {_LINES} SELECT diff_id,CAST(fno-1 AS INT) AS file_no,CAST(hno-h0-1 AS INT) AS hunk_no,CAST(regexp_extract(l,'^@@ -(\\d+)',1) AS INT) AS old_start,CAST(COALESCE(nullif(regexp_extract(l,'^@@ -\\d+,(\\d+)',1),''),'1') AS INT) AS old_count,CAST(regexp_extract(l,'\\+(\\d+)',1) AS INT) AS new_start,CAST(COALESCE(nullif(regexp_extract(l,'\\+\\d+,(\\d+)',1),''),'1') AS INT) AS new_count,trim(regexp_extract(l,'^@@ [^@]*@@(.*)$',1)) AS header FROM lf WHERE starts_with(l,'@@ -')""", DF)
def _(spark, d):
    return review.diff_hunks(_files(spark, d)).drop("path", "content")


@query("diff_stats", f"WITH {_LINES} SELECT count(*) AS files_changed,CAST(sum(lines_added) AS BIGINT) AS additions,CAST(sum(lines_deleted) AS BIGINT) AS deletions FROM fi", DF)
def _(spark, d):
    return review.diff_stats(_files(spark, d))


@query("formatting_only", f"WITH {_LINES} SELECT diff_id,CAST(fno-1 AS INT) AS file_no,count(*) FILTER (ch)=0 OR count(*) FILTER (ch AND trim(substr(l,2))='')*10>count(*) FILTER (ch)*8 AS is_formatting_only FROM (SELECT *,(starts_with(l,'+') AND NOT starts_with(l,'+++')) OR (starts_with(l,'-') AND NOT starts_with(l,'---')) AS ch FROM lf) GROUP BY 1,2", DF)
def _(spark, d):
    return review.formatting_only(_files(spark, d)).select("diff_id", "file_no", "is_formatting_only")


@query("chunk_hunks")
def _(spark, d):
    return review.chunk_hunks(_files(spark, d), max_tokens=20)


_ISS = """ii AS (SELECT response_id,file,unnest(regexp_extract_all(response,'(?s)<issue\\s+severity=[''"]?(blocking|warning|suggestion)[''"]?\\s*>(.*?)</issue>',1)) AS severity,unnest(regexp_extract_all(response,'(?s)<issue\\s+severity=[''"]?(blocking|warning|suggestion)[''"]?\\s*>(.*?)</issue>',2)) AS body FROM v_responses)"""


def _issues(spark, d):
    return review.parse_review_responses(fx.view(spark, d, "v_responses"))


@query("parse_review_responses", f"""WITH {_ISS} SELECT response_id,file,severity,COALESCE(trim(nullif(regexp_extract(body,'(?s)<message>(.*?)</message>',1),''),' '||chr(10)),'Issue found') AS message,CAST(nullif(regexp_extract(body,'<line>(\\d+)</line>',1),'') AS INT) AS line,nullif(regexp_extract(body,'(?s)<suggestion>(.*?)</suggestion>',1),'') AS suggestion FROM ii""", RS)
def _(spark, d):
    return _issues(spark, d).drop("issue_no")


@query("response_summaries", "SELECT response_id,trim(regexp_extract(response,'(?s)<summary>(.*?)</summary>',1),' '||chr(10)) AS summary FROM v_responses", RS)
def _(spark, d):
    return review.response_summaries(fx.view(spark, d, "v_responses"))


@query("review_assessment", f"""WITH {_ISS}, c AS (SELECT file AS review_id,count(*) FILTER (severity='blocking') AS n_blocking,count(*) FILTER (severity='warning') AS n_warning,count(*) FILTER (severity='suggestion') AS n_suggestion FROM ii GROUP BY 1)
SELECT *,CASE WHEN n_blocking>0 OR n_warning>3 THEN 'request_changes' WHEN n_warning>0 THEN 'needs_discussion' ELSE 'approve' END AS assessment FROM c""", RS)
def _(spark, d):
    return review.review_assessment(_issues(spark, d).withColumnRenamed("file", "review_id"))


_KW = "+".join(f"CASE WHEN contains(lower(X),'{k}') THEN {1 << i} ELSE 0 END" for i, k in enumerate(review.PRINCIPLE_KEYWORDS))


@query("match_principles", f"""WITH {_ISS}, m AS (SELECT response_id AS issue_id,{_KW.replace('X', 'body')} AS s FROM ii), p AS (SELECT {_KW.replace('X', 'content')} AS signature,count(*) AS n_principles FROM v_principles GROUP BY 1)
SELECT DISTINCT issue_id,CAST(signature AS INT) AS signature,n_principles FROM m JOIN p ON (m.s & p.signature)<>0""", RS + ["v_principles"])
def _(spark, d):
    issues = _issues(spark, d).select(F.col("response_id").alias("issue_id"), "message")
    return review.match_principles(issues, fx.principles(spark, d))


@query("review_cost", "SELECT conv_id,CAST(sum(prompt_tokens+completion_tokens) AS BIGINT) AS tokens,round(sum(prompt_tokens+completion_tokens)*0.00078::DOUBLE,6) AS cost_cents FROM v_usage GROUP BY 1", ["v_usage"])
def _(spark, d):
    usage = fx.view(spark, d, "v_usage").withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return review.review_cost(usage, "conv_id", "tokens")


@query("needs_sync", """WITH h AS (SELECT 'proj'||c_nationkey AS project_id,md5('c'||max(c_custkey)) AS head_sha FROM customer GROUP BY 1 UNION ALL SELECT 'fresh'||r_regionkey,'x' FROM region),
l AS (SELECT project_id,commit_sha,row_number() OVER (PARTITION BY project_id ORDER BY extracted_at DESC,id DESC) AS rn FROM v_runs)
SELECT h.project_id,head_sha,commit_sha AS last_sha FROM h LEFT JOIN l ON l.project_id=h.project_id AND rn=1 WHERE commit_sha IS NULL OR commit_sha<>head_sha""", ["v_runs"])
def _(spark, d):
    runs = fx.view(spark, d, "v_runs")
    heads = fx.sql(spark, d, "SELECT 'proj'||c_nationkey AS project_id,md5('c'||max(c_custkey)) AS head_sha FROM customer GROUP BY 1 UNION ALL SELECT 'fresh'||r_regionkey,'x' FROM region")
    return review.needs_sync(heads, runs)


# ---------------------------------------------------------------- telemetry

EV = ["v_events"]


@query("recent_events", "SELECT event_id,event_type,source,user_id FROM v_events WHERE starts_with(event_type,'m') AND source='mcp' ORDER BY ts DESC,event_id DESC LIMIT 100", EV)
def _(spark, d):
    return telemetry.recent_events(fx.view(spark, d, "v_events"), prefix="m", source="mcp").select("event_id", "event_type", "source", "user_id")


@query("bounded_history", "SELECT event_id,event_type FROM v_events ORDER BY ts DESC,event_id DESC LIMIT 1000", EV)
def _(spark, d):
    return telemetry.bounded_history(fx.view(spark, d, "v_events")).select("event_id", "event_type")


@query("event_counts", "SELECT event_type,source,count(*) AS n FROM v_events GROUP BY 1,2", EV)
def _(spark, d):
    return telemetry.event_counts(fx.view(spark, d, "v_events"))


@query("pair_events", """SELECT s.request_id,(epoch_us(CAST(e.ts AS TIMESTAMP))-epoch_us(CAST(s.ts AS TIMESTAMP)))/1000.0::DOUBLE AS duration_ms,e.event_type='mcp.tool.error' AS is_error,json_extract_string(s.data,'$.tool') AS tool,json_extract_string(e.data,'$.error') AS error,json_extract_string(e.data,'$.count') AS n FROM v_calls s JOIN v_calls e ON e.request_id=s.request_id AND e.event_type IN ('mcp.tool.result','mcp.tool.error') WHERE s.event_type='mcp.tool.called'""", ["v_calls"])
def _(spark, d):
    paired = telemetry.pair_events(fx.view(spark, d, "v_calls"))
    p = F.col("payload")
    return paired.select("request_id", "duration_ms", "is_error", p["tool"].alias("tool"), p["error"].alias("error"), p["count"].alias("n"))


_PRICED = "pr AS (SELECT *,CASE lower(model_id) WHEN 'gpt-4o-mini' THEN 15 WHEN 'o1' THEN 1500 WHEN 'gpt-4o-2024-08-06' THEN 250 WHEN 'gemma2-9b-it' THEN 0 ELSE 300 END AS pi,CASE lower(model_id) WHEN 'gpt-4o-mini' THEN 60 WHEN 'o1' THEN 6000 WHEN 'gpt-4o-2024-08-06' THEN 1000 WHEN 'gemma2-9b-it' THEN 0 ELSE 1500 END AS po FROM v_usage)"
US = ["v_usage"]


@query("price_usage", f"WITH {_PRICED} SELECT conv_id,turn,model_id,pi AS input_cents,po AS output_cents,round((prompt_tokens*pi+completion_tokens*po)/1000000,6) AS cost_cents FROM pr", US)
def _(spark, d):
    return telemetry.price_usage(fx.view(spark, d, "v_usage")).drop("provider", "prompt_tokens", "completion_tokens")


_SUM = "CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,CAST(sum(prompt_tokens+completion_tokens) AS BIGINT) AS total_tokens,round(sum(prompt_tokens*pi+completion_tokens*po)/1000000,6) AS cost_cents"


@query("usage_summary", f"WITH {_PRICED} SELECT model_id,provider,count(*) AS calls,{_SUM} FROM pr GROUP BY 1,2", US)
def _(spark, d):
    return telemetry.usage_summary(fx.view(spark, d, "v_usage"))


@query("session_usage", f"WITH {_PRICED} SELECT conv_id,count(*) AS calls,CAST(sum(prompt_tokens+completion_tokens) AS BIGINT) AS total_tokens,round(sum(prompt_tokens*pi+completion_tokens*po)/1000000,6) AS cost_cents,count(DISTINCT model_id) AS models FROM pr GROUP BY 1", US)
def _(spark, d):
    return telemetry.session_usage(fx.view(spark, d, "v_usage"), "conv_id")


RU = ["v_runs"]


@query("extraction_chain", "SELECT id,project_id,branch,lag(id) OVER (PARTITION BY project_id,branch ORDER BY extracted_at,id) AS previous_id FROM v_runs", RU)
def _(spark, d):
    return telemetry.extraction_chain(fx.view(spark, d, "v_runs")).select("id", "project_id", "branch", "previous_id")


@query("last_extraction", "SELECT project_id,branch,arg_max(id,(extracted_at,id)) AS id,arg_max(commit_sha,(extracted_at,id)) AS commit_sha FROM v_runs GROUP BY 1,2", RU)
def _(spark, d):
    return telemetry.last_extraction(fx.view(spark, d, "v_runs")).drop("extracted_at")


@query("extraction_history", "SELECT id,project_id,branch,substr(commit_sha,1,7) AS short_sha FROM v_runs WHERE branch='main'", RU)
def _(spark, d):
    return telemetry.extraction_history(fx.view(spark, d, "v_runs"), branch="main").select("id", "project_id", "branch", "short_sha")


# ------------------------------------------------------------------ linking

RC = ["v_refs", "v_config"]

#: The pair loop in SQL: every producer against every consumer of its type, first hit wins.
_PAIRS = r"""
cf AS (SELECT project_id,name,value,row_number() OVER (PARTITION BY project_id,name ORDER BY CASE method WHEN 'env' THEN 1 WHEN 'docker-compose' THEN 2 ELSE 3 END,value) AS rn FROM v_config),
rr AS (SELECT r.*,COALESCE(replace(identifier,'$'||'{'||cf.name||'}',cf.value),identifier) AS rs FROM v_refs r LEFT JOIN cf ON rn=1 AND cf.project_id=r.project_id AND contains(r.identifier,'$'||'{'||cf.name||'}') AND contains(r.identifier,'$')),
rk AS (SELECT *,CASE WHEN type='queue' THEN CASE WHEN starts_with(identifier,'arn:aws:sqs:') THEN string_split(identifier,':')[-1] WHEN contains(identifier,'.') THEN string_split(identifier,'.')[-1] ELSE identifier END WHEN type='api' THEN CASE WHEN contains(identifier,'://') THEN regexp_extract(identifier,'^[a-z]+://[^/?#]+([^?#]*)',1) ELSE identifier END END AS pt FROM rr),
g AS (SELECT type,project_id,identifier,direction,rs,pt,regexp_replace(pt,'^(GET|POST|PUT|DELETE|PATCH)\s+','') AS nv,count(*) AS n FROM rk GROUP BY ALL),
ky AS (SELECT *,unnest([lower(identifier),lower(rs),pt,CASE WHEN type='api' THEN nv END]) AS k FROM g),
pc AS (SELECT DISTINCT p.type,p.project_id AS from_project,p.identifier AS from_identifier,p.direction AS from_direction,p.n AS n_from,c.project_id AS to_project,c.identifier AS to_identifier,c.direction AS cd,c.n AS cn,
CASE WHEN p.identifier=c.identifier THEN 1 WHEN lower(p.identifier)=lower(c.identifier) THEN 2 WHEN p.rs=c.rs THEN 3 WHEN lower(p.rs)=lower(c.rs) THEN 4 WHEN p.pt=c.pt THEN 5 WHEN p.type='api' AND p.nv=c.nv THEN 6 END AS rk
FROM ky p JOIN ky c ON p.type=c.type AND p.k=c.k AND p.project_id<>c.project_id WHERE p.direction IN ('produce','both') AND c.direction IN ('consume','both')),
mt AS (SELECT type,from_project,from_identifier,from_direction,to_project,to_identifier,rk,n_from,CAST(sum(cn) AS BIGINT) AS n_to,CASE rk WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.85 WHEN 4 THEN 0.75 WHEN 5 THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence,CASE WHEN rk<=2 THEN 'literal' WHEN rk<=4 THEN 'config' ELSE 'pattern' END AS method FROM pc WHERE rk IS NOT NULL GROUP BY ALL)"""


def _matches(spark, d):
    return linking.match_references(fx.view(spark, d, "v_refs"), fx.view(spark, d, "v_config"))


@query("match_references", f"WITH {_PAIRS} SELECT type,from_project,from_identifier,from_direction,to_project,to_identifier,confidence,method,n_from,n_to,n_from*n_to AS n_pairs FROM mt", RC)
def _(spark, d):
    return _matches(spark, d).drop("rank")


@query("resolve_identifiers", f"WITH {_PAIRS} SELECT DISTINCT project_id,identifier,rs AS resolved FROM rr WHERE rs<>identifier", RC)
def _(spark, d):
    return linking.resolve_identifiers(fx.view(spark, d, "v_refs"), fx.view(spark, d, "v_config")).drop("confidence")


@query("create_links", f"""WITH {_PAIRS} SELECT CASE WHEN type='queue' THEN 'queue' ELSE 'api' END AS link_type,confidence,CASE method WHEN 'pattern' THEN 'ai' ELSE method END AS resolution_method,from_project AS source_project,from_identifier AS source_identifier,to_project AS target_project,to_identifier AS target_identifier,CASE WHEN type='queue' THEN CASE WHEN from_direction='produce' THEN 'PUBLISHES_TO' ELSE 'SUBSCRIBES_TO' END ELSE 'CALLS_SERVICE' END AS edge_type,false AS is_reverse FROM mt
UNION ALL SELECT CASE WHEN type='queue' THEN 'queue' ELSE 'api' END,confidence,CASE method WHEN 'pattern' THEN 'ai' ELSE method END,to_project,to_identifier,from_project,from_identifier,CASE WHEN type='queue' THEN 'SUBSCRIBES_TO' ELSE 'HANDLED_BY' END,true FROM mt""", RC)
def _(spark, d):
    return linking.create_links(_matches(spark, d)).drop("reference_type", "from_direction", "n_pairs")


@query("link_members", f"""WITH {_PAIRS} SELECT DISTINCT r.type,r.project_id,r.identifier,'producer' AS role,r.node_id FROM v_refs r JOIN mt ON mt.type=r.type AND mt.from_project=r.project_id AND mt.from_identifier=r.identifier WHERE r.direction IN ('produce','both')
UNION ALL SELECT DISTINCT r.type,r.project_id,r.identifier,'consumer',r.node_id FROM v_refs r JOIN mt ON mt.type=r.type AND mt.to_project=r.project_id AND mt.to_identifier=r.identifier WHERE r.direction IN ('consume','both')""", RC)
def _(spark, d):
    return linking.link_members(_matches(spark, d), fx.view(spark, d, "v_refs"))


@query("link_stats", f"WITH {_PAIRS} SELECT type,CAST(sum(n_from*n_to) AS BIGINT) AS matches,CAST(sum(n_from*n_to) AS BIGINT) AS links,CAST(2*sum(n_from*n_to) AS BIGINT) AS edges FROM mt GROUP BY 1", RC)
def _(spark, d):
    return linking.link_stats(linking.link_counts(fx.view(spark, d, "v_refs"), fx.view(spark, d, "v_config")))


@query("link_counts", f"WITH {_PAIRS} SELECT type,CAST(rk AS INT) AS rank,confidence,method,CAST(sum(n_from*n_to) AS BIGINT) AS n_pairs FROM mt GROUP BY 1,2,3,4", RC)
def _(spark, d):
    return linking.link_counts(fx.view(spark, d, "v_refs"), fx.view(spark, d, "v_config"))


@query("link_hubs", r"""WITH pr AS (SELECT type,lower(identifier) AS key,project_id,count(*) FILTER (direction IN ('produce','both')) AS p,count(*) FILTER (direction IN ('consume','both')) AS c FROM v_refs GROUP BY 1,2,3)
SELECT type,key,count(*) FILTER (p>0) AS from_projects,count(*) FILTER (c>0) AS to_projects,CAST(sum(p) AS BIGINT) AS n_from,CAST(sum(c) AS BIGINT) AS n_to,CAST(sum(p)*sum(c)-sum(p*c) AS BIGINT) AS n_pairs FROM pr GROUP BY 1,2""", RC)
def _(spark, d):
    hubs = linking.link_hubs(fx.view(spark, d, "v_refs"), fx.view(spark, d, "v_config"), ((2,),))
    return hubs.withColumn("key", F.get("key", F.lit(0))).drop("set")


@query("project_links", f"""WITH {_PAIRS}, mine AS (SELECT * FROM mt WHERE from_project='proj3' OR to_project='proj3')
SELECT CASE WHEN type='queue' THEN 'queue' ELSE 'api' END AS link_type,confidence,from_project AS source_project,from_identifier AS source_identifier,to_project AS target_project,to_identifier AS target_identifier,false AS is_reverse,n_from*n_to AS n_pairs FROM mine
UNION ALL SELECT CASE WHEN type='queue' THEN 'queue' ELSE 'api' END,confidence,to_project,to_identifier,from_project,from_identifier,true,n_from*n_to FROM mine""", RC)
def _(spark, d):
    found = linking.match_references(fx.view(spark, d, "v_refs"), fx.view(spark, d, "v_config"), project_id="proj3")
    return linking.create_links(found).drop("reference_type", "from_direction", "edge_type", "resolution_method")


@query("collect_references", """SELECT CASE type WHEN 'Queue' THEN 'queue' WHEN 'ApiEndpoint' THEN 'api' ELSE 'database' END AS type,CASE type WHEN 'ApiEndpoint' THEN method||' '||path ELSE name END AS identifier,CASE type WHEN 'ApiEndpoint' THEN 'consume' ELSE 'both' END AS direction,id AS node_id,project_id FROM v_nodes WHERE type IN ('Queue','ApiEndpoint','Model')""", ["v_nodes"])
def _(spark, d):
    return linking.collect_references(fx.nodes(spark, d)).select("type", "identifier", "direction", "node_id", "project_id")


_BAG = "SELECT 'l'||s_suppkey AS id,'proj'||s_nationkey AS project_id,'f.py' AS file,CASE WHEN s_suppkey%3=0 THEN 'kafka_topic' WHEN s_suppkey%3=1 THEN 'base_url' ELSE 'colour' END AS k,s_name AS v FROM supplier"


@query("collect_property_references", f"SELECT id AS node_id,CASE k WHEN 'kafka_topic' THEN 'topic' ELSE 'api' END AS type,CASE k WHEN 'kafka_topic' THEN 'both' ELSE 'produce' END AS direction,v AS identifier,k AS source FROM ({_BAG}) WHERE k<>'colour'")
def _(spark, d):
    nodes = fx.sql(spark, d, _BAG).withColumn("properties", F.create_map("k", "v"))
    return linking.collect_property_references(nodes).select("node_id", "type", "direction", "identifier", "source")


@query("scalar_functions", r"""SELECT node_id,CASE WHEN starts_with(identifier,'arn:aws:sqs:') THEN string_split(identifier,':')[-1] WHEN contains(identifier,'.') THEN string_split(identifier,'.')[-1] ELSE identifier END AS queue_name,CASE WHEN contains(identifier,'://') THEN regexp_extract(identifier,'^[a-z]+://[^/?#]+([^?#]*)',1) ELSE identifier END AS api_path,regexp_replace(identifier,'^(GET|POST|PUT|DELETE|PATCH)\s+','') AS no_verb,CASE WHEN contains(identifier,'.') THEN string_split(identifier,'.')[-1] ELSE identifier END AS table_name,contains(identifier,'$') AS has_variable,ltrim(lower(regexp_replace(identifier,'([A-Z])','_\1','g')),'_') AS snake,regexp_replace(identifier,':(\w+)','{\1}','g') AS braces FROM v_refs""", ["v_refs"])
def _(spark, d):
    i = F.col("identifier")
    return fx.view(spark, d, "v_refs").select(
        "node_id", scalars.queue_name(i).alias("queue_name"), scalars.api_path(i).alias("api_path"), scalars.without_verb(i).alias("no_verb"),
        scalars.table_name(i).alias("table_name"), scalars.has_variable(i).alias("has_variable"), scalars.snake_case(i).alias("snake"),
        scalars.brace_path(i).alias("braces"))


@query("capture_transforms", r"""SELECT node_id,t AS text,upper(t) AS uppercase,lower(t) AS lowercase,regexp_replace(t,'^\s+|\s+$','','g') AS trim,lower(j[1])||j[2:] AS "camelCase",regexp_replace(lower(regexp_replace(t,'([A-Z])','_\1','g')),'^_','') AS snake_case FROM (SELECT node_id,t,p[1]||array_to_string(list_transform(p[2:],lambda x: upper(x[1])||x[2:]),'') AS j FROM (SELECT node_id,t,regexp_split_to_array(t,'[-_\s]+') AS p FROM (SELECT node_id,identifier||'  ' AS t FROM v_refs)))""", ["v_refs"])
def _(spark, d):
    text = F.concat("identifier", F.lit("  "))
    changes = ("uppercase", "lowercase", "trim", "camelCase", "snake_case")
    return fx.view(spark, d, "v_refs").select(
        "node_id", extraction.capture_transform(text, F.lit("")).alias("text"), *[extraction.capture_transform(text, F.lit(c)).alias(c) for c in changes])
