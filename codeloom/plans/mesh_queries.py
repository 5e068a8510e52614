"""Registered queries over the code mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import docs, graph, mesh
from codeloom.plans import fixtures as fx
from codeloom.plans.registry import query

N, E = ["v_nodes"], ["v_nodes", "v_edges"]


def _ne(spark, d):
    return fx.nodes(spark, d), fx.edges(spark, d)


@query("get_nodes", "SELECT id,type,name,project_id,branch,file,line_start,line_end FROM v_nodes WHERE branch='main'", N)
def _(spark, d):
    return mesh.get_nodes(fx.nodes(spark, d), branch="main").select(
        "id", "type", "name", "project_id", "branch", "file", "line_start", "line_end")


@query("get_edges", """SELECT e.from_id,e.to_id,e.type FROM v_edges e JOIN v_nodes a ON a.id=e.from_id AND a.branch='main' JOIN v_nodes b ON b.id=e.to_id""", E)
def _(spark, d):
    return mesh.get_edges(*_ne(spark, d), branch="main").select("from_id", "to_id", "type")


@query("find_functions", "SELECT id,name,project_id,file FROM v_nodes WHERE type IN ('Function','Method') AND regexp_full_match(name,'fn_[0-9]*7|m_1.*')", N)
def _(spark, d):
    return mesh.find_functions(fx.nodes(spark, d), name_pattern="fn_[0-9]*7|m_1.*").select("id", "name", "project_id", "file")


@query("find_api_endpoints", "SELECT id,method,path FROM v_nodes WHERE type IN ('ApiEndpoint','Endpoint') AND method='GET' AND regexp_full_match(path,'/api/.*')", N)
def _(spark, d):
    return mesh.find_api_endpoints(fx.nodes(spark, d), method="get", path_pattern="/api/.*").select("id", "method", "path")


@query("search_by_name", "SELECT id,name,type FROM v_nodes WHERE regexp_matches(name,'(?i).*cls1.*')", N)
def _(spark, d):
    return mesh.search_by_name(fx.nodes(spark, d), "cls1").select("id", "name", "type")


@query("find_file_contents", "SELECT id,file,line_start FROM v_nodes WHERE contains(file,'Brand#1')", N)
def _(spark, d):
    return mesh.find_file_contents(fx.nodes(spark, d), "Brand#1").select("id", "file", "line_start")


_LOCATIONS = """SELECT 'c'||c_custkey AS location_id,'src/'||c_mktsegment||'/c'||c_custkey||'.py' AS file,CAST((c_custkey%90)*10 AS INT) AS line_from,CAST((c_custkey%90)*10+30 AS INT) AS line_to FROM customer"""


@query("node_at_location", f"""
WITH loc AS ({_LOCATIONS}), hit AS (SELECT l.location_id,n.id,n.type,n.line_start,n.line_end,row_number() OVER (PARTITION BY l.location_id ORDER BY n.line_end-n.line_start,n.id) AS rn
FROM loc l JOIN v_nodes n ON n.file=l.file AND n.line_start<=l.line_to AND n.line_end>=l.line_from WHERE n.type<>'File')
SELECT location_id,id,type,line_start,line_end FROM hit WHERE rn=1""", N)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    return mesh.node_at_location(nodes, fx.sql(spark, d, _LOCATIONS)).select("location_id", "id", "type", "line_start", "line_end")


@query("find_callers", """SELECT e.from_id AS caller_id,c.name AS caller_name,c.file AS caller_file,e.to_id AS target_id,t.name AS target_name
FROM v_edges e JOIN v_nodes c ON c.id=e.from_id JOIN v_nodes t ON t.id=e.to_id WHERE e.type='CALLS'""", E)
def _(spark, d):
    return mesh.find_callers(*_ne(spark, d)).select("caller_id", "caller_name", "caller_file", "target_id", "target_name")


@query("find_callers_of", """SELECT e.from_id AS caller_id,c.name AS caller_name,c.line_start AS caller_line_start,e.to_id AS target_id
FROM v_edges e JOIN v_nodes c ON c.id=e.from_id JOIN v_nodes t ON t.id=e.to_id WHERE e.type='CALLS' AND t.name='m_7' ORDER BY c.file,c.line_start,e.from_id,e.to_id LIMIT 50""", E)
def _(spark, d):
    return mesh.find_callers(*_ne(spark, d), function_name="m_7", limit=50).select(
        "caller_id", "caller_name", "caller_line_start", "target_id")


@query("find_callees", """SELECT e.from_id AS caller_id,c.name AS caller_name,e.to_id AS callee_id,t.name AS callee_name
FROM v_edges e JOIN v_nodes c ON c.id=e.from_id JOIN v_nodes t ON t.id=e.to_id WHERE e.type='CALLS'""", E)
def _(spark, d):
    return mesh.find_callees(*_ne(spark, d)).select("caller_id", "caller_name", "callee_id", "callee_name")


@query("trace_queue_flow", """
WITH pub AS (SELECT e.to_id AS queue_id,e.from_id AS node_id FROM v_edges e JOIN v_nodes n ON n.id=e.from_id WHERE e.type='PUBLISHES_TO'),
con AS (SELECT x.queue_id,x.node_id FROM (SELECT to_id AS queue_id,from_id AS node_id FROM v_edges WHERE type='SUBSCRIBES_TO' UNION ALL SELECT from_id,to_id FROM v_edges WHERE type='SUBSCRIBES_TO') x JOIN v_nodes n ON n.id=x.node_id)
SELECT p.queue_id,q.name AS queue_name,'producer' AS role,p.node_id,(SELECT count(*) FROM con c WHERE c.queue_id=p.queue_id) AS other_ends FROM pub p JOIN v_nodes q ON q.id=p.queue_id WHERE EXISTS (SELECT 1 FROM con c WHERE c.queue_id=p.queue_id)
UNION ALL SELECT c.queue_id,q.name,'consumer',c.node_id,(SELECT count(*) FROM pub p WHERE p.queue_id=c.queue_id) FROM con c JOIN v_nodes q ON q.id=c.queue_id WHERE EXISTS (SELECT 1 FROM pub p WHERE p.queue_id=c.queue_id)""", E)
def _(spark, d):
    return mesh.trace_queue_flow(*_ne(spark, d)).select("queue_id", "queue_name", "role", "node_id", "other_ends")


@query("cross_project_links", """SELECT e.from_id,e.to_id,a.project_id AS from_project_id,b.project_id AS to_project_id,e.type FROM v_edges e JOIN v_nodes a ON a.id=e.from_id JOIN v_nodes b ON b.id=e.to_id
WHERE e.cross_project AND e.type IN ('CONNECTS_VIA_API','CALLS_SERVICE') AND (a.project_id='proj3' OR b.project_id='proj3')""", E)
def _(spark, d):
    return mesh.cross_project_links(*_ne(spark, d), project_id="proj3", link_type="api").select(
        "from_id", "to_id", "from_project_id", "to_project_id", "type")


@query("resolve_edges", """SELECT e.from_id,e.to_id,e.type,a.project_id,b.id IS NULL AS is_unresolved FROM v_edges e JOIN v_nodes a ON a.id=e.from_id LEFT JOIN v_nodes b ON b.id=e.to_id""", E)
def _(spark, d):
    return mesh.resolve_edges(*_ne(spark, d)).select("from_id", "to_id", "type", "project_id", "is_unresolved")


@query("unresolved_references", """SELECT e.to_id AS name,a.project_id,a.branch,count(*) AS n_edges FROM v_edges e JOIN v_nodes a ON a.id=e.from_id LEFT JOIN v_nodes b ON b.id=e.to_id WHERE b.id IS NULL GROUP BY 1,2,3""", E)
def _(spark, d):
    return mesh.unresolved_references(mesh.resolve_edges(*_ne(spark, d)))


@query("dependencies", """SELECT a.name AS source,b.name AS target,e.type,a.project_id FROM v_edges e JOIN v_nodes a ON a.id=e.from_id JOIN v_nodes b ON b.id=e.to_id""", E)
def _(spark, d):
    return mesh.dependencies(*_ne(spark, d)).select("source", "target", "type", "project_id")


@query("neighbourhood", """
WITH c AS (SELECT e.to_id AS id,'caller' AS role,e.type,e.from_id AS other_id,n.name AS other_name FROM v_edges e JOIN v_nodes n ON n.id=e.from_id JOIN v_nodes t ON t.id=e.to_id WHERE e.type='CALLS'),
o AS (SELECT e.from_id AS id,'outgoing' AS role,e.type,e.to_id AS other_id,n.name AS other_name FROM v_edges e JOIN v_nodes n ON n.id=e.to_id JOIN v_nodes s ON s.id=e.from_id)
SELECT id,role,type,other_id,other_name FROM (SELECT *,row_number() OVER (PARTITION BY id ORDER BY other_name,other_id,type) AS rn FROM c) WHERE rn<=10
UNION ALL SELECT id,role,type,other_id,other_name FROM (SELECT *,row_number() OVER (PARTITION BY id ORDER BY other_name,other_id,type) AS rn FROM o) WHERE rn<=20""", E)
def _(spark, d):
    return mesh.neighbourhood(*_ne(spark, d))


@query("dedup_by_id", """SELECT from_id AS id,min(to_id) AS to_id FROM v_edges GROUP BY 1""", ["v_edges"])
def _(spark, d):
    rows = fx.edges(spark, d).select(F.col("from_id").alias("id"), "to_id")
    return mesh.dedup_by_id(rows, ["to_id"])


@query("project_stats", "SELECT project_id,type,count(*) AS n FROM v_nodes GROUP BY 1,2", N)
def _(spark, d):
    return mesh.project_stats(fx.nodes(spark, d))


@query("mesh_statistics", """
WITH n AS (SELECT project_id,branch,count(*) AS n_nodes,count(DISTINCT file) AS n_files,count(DISTINCT type) AS n_types FROM v_nodes GROUP BY 1,2),
e AS (SELECT a.project_id,a.branch,count(*) AS n_edges FROM v_edges e JOIN v_nodes a ON a.id=e.from_id GROUP BY 1,2),
r AS (SELECT project_id,branch,commit_sha,row_number() OVER (PARTITION BY project_id,branch ORDER BY extracted_at DESC,id DESC) AS rn FROM v_runs)
SELECT n.project_id,n.branch,n_nodes,n_files,n_types,COALESCE(n_edges,0) AS n_edges,commit_sha AS last_commit FROM n LEFT JOIN e ON e.project_id=n.project_id AND e.branch=n.branch LEFT JOIN r ON r.project_id=n.project_id AND r.branch=n.branch AND rn=1""", ["v_nodes", "v_edges", "v_runs"])
def _(spark, d):
    return mesh.mesh_statistics(*_ne(spark, d), fx.view(spark, d, "v_runs"))


@query("list_projects", """
SELECT n.*,strftime(r.last,'%Y-%m-%d') AS last_extraction FROM (SELECT project_id,count(DISTINCT branch) AS n_branches,string_agg(DISTINCT branch,',' ORDER BY branch) AS branches,count(*) AS n_nodes FROM v_nodes GROUP BY 1) n
LEFT JOIN (SELECT project_id,max(extracted_at) AS last FROM v_runs GROUP BY 1) r USING (project_id)""", ["v_nodes", "v_runs"])
def _(spark, d):
    return mesh.list_projects(fx.nodes(spark, d), fx.view(spark, d, "v_runs")).withColumn(
        "last_extraction", F.date_format("last_extraction", "yyyy-MM-dd"))


@query("search_projects", """
SELECT n.*,strftime(r.last,'%Y-%m-%d') AS last_extraction FROM (SELECT project_id,count(DISTINCT branch) AS n_branches,string_agg(DISTINCT branch,',' ORDER BY branch) AS branches,count(*) AS n_nodes FROM v_nodes WHERE contains(lower(project_id),'oj1') GROUP BY 1) n
LEFT JOIN (SELECT project_id,max(extracted_at) AS last FROM v_runs GROUP BY 1) r USING (project_id)""", ["v_nodes", "v_runs"])
def _(spark, d):
    return mesh.list_projects(fx.nodes(spark, d), fx.view(spark, d, "v_runs"), "OJ1").withColumn(
        "last_extraction", F.date_format("last_extraction", "yyyy-MM-dd"))


@query("project_files", "SELECT DISTINCT project_id,branch,file FROM v_nodes", N)
def _(spark, d):
    return mesh.project_files(fx.nodes(spark, d))


@query("extraction_statistics", """SELECT count(*) FILTER (size<=50000) AS files_processed,count(*) FILTER (size>50000) AS files_skipped,count(*) FILTER (size<=50000 AND tier=1) AS tier1,count(*) FILTER (size<=50000 AND tier=2) AS tier2,count(*) FILTER (size<=50000 AND tier=3) AS tier3,CAST(sum(n_nodes) FILTER (size<=50000) AS BIGINT) AS total_nodes,CAST(sum(n_edges) FILTER (size<=50000) AS BIGINT) AS total_edges FROM v_file_results""", ["v_file_results"])
def _(spark, d):
    return mesh.extraction_statistics(fx.view(spark, d, "v_file_results"), max_bytes=50_000)


@query("containing_class", """
WITH m AS (SELECT m.id AS method_id,c.id AS class_id,row_number() OVER (PARTITION BY m.id ORDER BY c.line_start,c.id) AS rn FROM v_nodes m JOIN v_nodes c ON c.file=m.file AND c.project_id=m.project_id AND c.line_start<m.line_start AND (c.line_end>m.line_end OR c.line_end=m.line_start) WHERE m.type='Method' AND c.type='Class')
SELECT class_id,method_id,'CONTAINS' AS type,0.7::DOUBLE AS confidence FROM m WHERE rn=1 AND NOT EXISTS (SELECT 1 FROM v_edges e WHERE e.type='CONTAINS' AND e.from_id=class_id AND e.to_id=method_id)""", E)
def _(spark, d):
    return mesh.containing_class(*_ne(spark, d))


@query("mesh_diff", """
WITH l AS (SELECT type,name,file,count(*) AS n,sum(line_start) AS s,min(id) AS i,max(id) AS j FROM v_nodes WHERE branch='main' GROUP BY 1,2,3), r AS (SELECT type,name,replace(file,'HOUSEHOLD','BUILDING') AS file,count(*) AS n FROM v_nodes WHERE branch='main' OR type='Function' GROUP BY 1,2,3)
SELECT COALESCE(l.type,r.type) AS type,COALESCE(l.name,r.name) AS name,COALESCE(l.file,r.file) AS file,CASE WHEN r.n IS NULL THEN 'only_left' WHEN l.n IS NULL THEN 'only_right' ELSE 'changed' END AS change FROM l FULL OUTER JOIN r ON l.type=r.type AND l.name=r.name AND l.file=r.file WHERE l.n IS NULL OR r.n IS NULL OR l.n<>r.n""", N)
def _(spark, d):
    nodes = fx.nodes(spark, d)
    right = nodes.filter("branch='main' OR type='Function'").withColumn("file", F.replace(F.col("file"), F.lit("HOUSEHOLD"), F.lit("BUILDING")))
    return mesh.mesh_diff(nodes.filter("branch='main'"), right, ["line_start", "line_end"])


@query("suggest_reviewers", """
WITH c AS (SELECT t.file AS changed_file,s.file AS referencing_file,count(*) AS refs FROM v_edges e JOIN v_nodes t ON t.id=e.to_id JOIN v_nodes s ON s.id=e.from_id WHERE e.type IN ('IMPORTS','USES','CALLS') GROUP BY 1,2)
SELECT changed_file,referencing_file,refs,CASE WHEN refs>3 THEN 'high' ELSE 'medium' END AS priority FROM (SELECT *,row_number() OVER (PARTITION BY changed_file ORDER BY refs DESC,referencing_file) AS rn FROM c) WHERE rn<=5""", E)
def _(spark, d):
    nodes, edges = _ne(spark, d)
    return mesh.suggest_reviewers(nodes, edges, nodes.select("file"))


_IMPACT = """
WITH fn AS (SELECT file,name FROM v_nodes WHERE type IN ('Function','Method')),
ca AS (SELECT a.name AS from_name,a.file AS from_file,b.name AS to_name FROM v_edges e JOIN v_nodes a ON a.id=e.from_id JOIN v_nodes b ON b.id=e.to_id WHERE e.type='CALLS'),
up AS (SELECT to_name AS name,from_file FROM ca),
dn AS (SELECT from_name AS name FROM ca),
u AS (SELECT fn.file,count(*) AS callers,count(DISTINCT from_file) FILTER (from_file<>fn.file) AS affected_files FROM fn JOIN up USING (name) GROUP BY 1),
w AS (SELECT fn.file,count(*) AS callees FROM fn JOIN dn USING (name) GROUP BY 1),
ep AS (SELECT file,count(*) AS endpoints FROM v_nodes WHERE type IN ('ApiEndpoint','Endpoint') GROUP BY 1),
lk AS (SELECT file,count(*) AS links FROM (SELECT n.file,e.from_id,e.to_id,e.type FROM v_edges e JOIN v_nodes n ON n.id=e.from_id WHERE e.cross_project UNION SELECT n.file,e.from_id,e.to_id,e.type FROM v_edges e JOIN v_nodes n ON n.id=e.to_id WHERE e.cross_project) GROUP BY 1),
im AS (SELECT f.file,COALESCE(affected_files,0) AS affected_files,COALESCE(callers,0) AS callers,COALESCE(callees,0) AS callees,COALESCE(endpoints,0) AS endpoints,COALESCE(links,0) AS links FROM (SELECT DISTINCT file FROM v_nodes) f LEFT JOIN u USING (file) LEFT JOIN w USING (file) LEFT JOIN ep USING (file) LEFT JOIN lk USING (file))
"""


@query("impact_analysis", _IMPACT + "SELECT *,CASE WHEN links>0 OR endpoints>5 THEN 'high' WHEN endpoints>0 OR callers>10 THEN 'medium' ELSE 'low' END AS risk FROM im", E)
def _(spark, d):
    nodes, edges = _ne(spark, d)
    return mesh.impact_analysis(nodes, edges, nodes.select("file"))


@query("impact_warnings", _IMPACT + "SELECT file,'cross_project' AS warning FROM im WHERE links>0 UNION ALL SELECT file,'api' FROM im WHERE endpoints>0 UNION ALL SELECT file,'many_callers' FROM im WHERE callers>10", E)
def _(spark, d):
    nodes, edges = _ne(spark, d)
    return mesh.impact_warnings(mesh.impact_analysis(nodes, edges, nodes.select("file")))


# ------------------------------------------------------------ documentation

_DOC_NODES = """SELECT id,type,name,project_id,file,line_start,method,path,CAST(NULL AS VARCHAR(9)) AS status,CAST(NULL AS VARCHAR(9)) AS loc FROM v_nodes
UNION ALL SELECT 'ap'||l_suppkey||'_'||l_partkey||'_'||l_linenumber,'ApiParameter',CASE WHEN l_linenumber=3 THEN 'id' ELSE 'arg'||l_partkey END,'proj'||s_nationkey,'svc/s'||s_suppkey||'.java',CAST(l_linenumber*20 AS INT),NULL,NULL,NULL,CASE WHEN l_returnflag='R' THEN 'body' END FROM lineitem JOIN supplier ON l_suppkey=s_suppkey
UNION ALL SELECT 'ar'||s_suppkey,'ApiResponse','r','proj'||s_nationkey,'svc/s'||s_suppkey||'.java',CAST(s_suppkey%90 AS INT),NULL,NULL,CAST(200+s_suppkey%5 AS VARCHAR(9)),NULL FROM supplier"""


def _doc_nodes(spark, d):
    fx.view(spark, d, "v_nodes").createOrReplaceTempView("v_nodes")
    raw = fx.sql(spark, d, _DOC_NODES)
    bag = F.map_filter(F.create_map(F.lit("method"), F.col("method"), F.lit("path"), F.col("path"), F.lit("status"), F.col("status"),
                                    F.lit("location"), F.col("loc")), lambda _, v: v.isNotNull())
    return raw.select("id", "type", "name", "project_id", "file", "line_start", bag.alias("properties"))


@query("api_docs", f"""
WITH dn AS ({_DOC_NODES}), ep AS (SELECT *,COALESCE(method,'GET') AS m,COALESCE(path,name) AS p FROM dn WHERE type IN ('ApiEndpoint','Endpoint')),
pa AS (SELECT e.id,e.m AS method,e.p AS path,'parameter' AS kind,d.name AS item,'string' AS item_type,COALESCE(d.loc,'query') AS location,false AS required FROM ep e JOIN dn d ON d.type='ApiParameter' AND d.file=e.file AND d.project_id=e.project_id AND abs(d.line_start-e.line_start)<50),
re AS (SELECT e.id,e.m,e.p,d.status FROM ep e JOIN dn d ON d.type='ApiResponse' AND d.file=e.file AND d.project_id=e.project_id AND abs(d.line_start-e.line_start)<50)
SELECT * FROM pa
UNION ALL SELECT x.id,x.m,x.p,'parameter',x.item,'string','path',true FROM (SELECT DISTINCT id,m,p,unnest(regexp_extract_all(path,'\\{{(\\w+)\\}}',1)) AS item FROM ep) x WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.id=x.id AND pa.item=x.item)
UNION ALL SELECT id,m,p,'response',status,NULL,NULL,NULL FROM re
UNION ALL SELECT id,m,p,'response','200',NULL,NULL,NULL FROM ep WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.id=ep.id)""", N)
def _(spark, d):
    return docs.api_docs(_doc_nodes(spark, d)).drop("file", "line_start")


@query("function_docs", """
WITH f AS (SELECT id FROM v_nodes WHERE type IN ('Function','Method'))
SELECT DISTINCT e.to_id AS id,'caller' AS kind,n.name AS item FROM v_edges e JOIN f ON f.id=e.to_id JOIN v_nodes n ON n.id=e.from_id WHERE e.type='CALLS'
UNION ALL SELECT DISTINCT e.from_id,'callee',n.name FROM v_edges e JOIN f ON f.id=e.from_id JOIN v_nodes n ON n.id=e.to_id WHERE e.type='CALLS'""", E)
def _(spark, d):
    return docs.function_docs(*_ne(spark, d))


@query("class_docs", """SELECT DISTINCT e.from_id AS id,CASE WHEN e.type IN ('INHERITS','IMPLEMENTS') THEN 'base' ELSE 'method' END AS kind,n.name AS item FROM v_edges e JOIN v_nodes c ON c.id=e.from_id AND c.type IN ('Class','Interface') JOIN v_nodes n ON n.id=e.to_id WHERE e.type IN ('INHERITS','IMPLEMENTS') OR (e.type='CONTAINS' AND n.type IN ('Function','Method'))""", E)
def _(spark, d):
    return docs.class_docs(*_ne(spark, d))


_EP = "WITH ep AS (SELECT COALESCE(path,name) AS path,file,list_filter(string_split(COALESCE(path,name),'/'),lambda x: x<>'') AS seg FROM v_nodes WHERE type IN ('ApiEndpoint','Endpoint'))"


@query("endpoints_by_prefix", _EP + " SELECT COALESCE(seg[1],'') AS prefix,count(*) AS n FROM ep GROUP BY 1", N)
def _(spark, d):
    return docs.endpoints_by_prefix(fx.nodes(spark, d))


@query("endpoints_by_tag", _EP + " SELECT CASE WHEN seg[1] IS NOT NULL AND NOT starts_with(seg[1],'{') THEN seg[1] ELSE COALESCE(string_split(file,'/')[-2],'default') END AS tag,count(*) AS n FROM ep GROUP BY 1", N)
def _(spark, d):
    return docs.endpoints_by_tag(fx.nodes(spark, d))


_FUNCTION_DOCS = """f AS (SELECT id FROM v_nodes WHERE type IN ('Function','Method')),
up AS (SELECT e.to_id AS id,count(DISTINCT n.name) AS n FROM v_edges e JOIN v_nodes n ON n.id=e.from_id WHERE e.type='CALLS' GROUP BY 1),
dn AS (SELECT e.from_id AS id,count(DISTINCT n.name) AS n FROM v_edges e JOIN v_nodes n ON n.id=e.to_id WHERE e.type='CALLS' GROUP BY 1)"""


@query("file_functions", f"WITH {_FUNCTION_DOCS} SELECT v.project_id,v.file,v.id,v.name,CAST(v.line_start AS INT) AS line_start,COALESCE(up.n,0) AS n_callers,COALESCE(dn.n,0) AS n_callees,CAST(0 AS BIGINT) AS n_parameters FROM v_nodes v JOIN f USING (id) LEFT JOIN up USING (id) LEFT JOIN dn USING (id) WHERE NOT contains(v.name,'.')", E)
def _(spark, d):
    return docs.file_functions(*_ne(spark, d))


@query("functions_by_file", "SELECT project_id,file,count(*) AS n_functions,count(DISTINCT name) AS n_names,min(name) AS first_name,max(name) AS last_name FROM v_nodes WHERE type IN ('Function','Method') AND NOT contains(name,'.') GROUP BY 1,2", N)
def _(spark, d):
    return docs.functions_by_file(fx.nodes(spark, d))


_IMPORTS = "SELECT 'src/'||o_orderpriority||'/m'||o_custkey||'.py' AS file,'m'||o_orderkey AS module FROM orders"


@query("module_dependencies", f"""
WITH im AS (SELECT DISTINCT file,module FROM ({_IMPORTS})), fs AS (SELECT DISTINCT file FROM im), t AS (SELECT module,min(fs.file) AS target FROM (SELECT DISTINCT module FROM im) m JOIN fs ON contains(fs.file,m.module) GROUP BY 1)
SELECT DISTINCT im.file,t.target,regexp_extract(im.file,'^(.*)/[^/]*$',1) AS directory FROM im JOIN t USING (module) WHERE im.file<>t.target""")
def _(spark, d):
    return docs.module_dependencies(fx.sql(spark, d, _IMPORTS))


@query("er_relations", "SELECT a.name AS from_model,b.name AS to_model,e.type FROM v_edges e JOIN v_nodes a ON a.id=e.from_id JOIN v_nodes b ON b.id=e.to_id WHERE e.type IN ('READS_FROM','WRITES_TO','QUERIES') AND a.type IN ('Model','Table') AND b.type IN ('Model','Table')", E)
def _(spark, d):
    return docs.er_relations(*_ne(spark, d))


# ---------------------------------------------------------------- traversal


@query("class_hierarchy", """
WITH RECURSIVE inh AS (SELECT from_id,to_id FROM v_edges WHERE type IN ('INHERITS','IMPLEMENTS')),
up AS (SELECT id AS class_id,id AS related_id,0 AS distance FROM v_nodes WHERE type='Class' UNION SELECT u.class_id,i.to_id,u.distance+1 FROM up u JOIN inh i ON i.from_id=u.related_id WHERE u.distance<5),
dn AS (SELECT id AS class_id,id AS related_id,0 AS distance FROM v_nodes WHERE type='Class' UNION SELECT u.class_id,i.from_id,u.distance+1 FROM dn u JOIN inh i ON i.to_id=u.related_id WHERE u.distance<5)
SELECT class_id,related_id,'up' AS direction,CAST(min(distance) AS INT) AS distance FROM up WHERE class_id<>related_id GROUP BY 1,2
UNION ALL SELECT class_id,related_id,'down',CAST(min(distance) AS INT) FROM dn WHERE class_id<>related_id GROUP BY 1,2""", E)
def _(spark, d):
    return graph.class_hierarchy(*_ne(spark, d)).drop("related_name")


def _calls(spark, d):
    return mesh.find_callees(*_ne(spark, d)).select(F.col("caller_name").alias("caller"), F.col("callee_name").alias("callee"))


@query("call_graph", """
WITH RECURSIVE ca AS (SELECT DISTINCT a.name AS a,b.name AS b FROM v_edges e JOIN v_nodes a ON a.id=e.from_id JOIN v_nodes b ON b.id=e.to_id WHERE e.type='CALLS'), bo AS (SELECT a,b FROM ca UNION SELECT b,a FROM ca),
w AS (SELECT DISTINCT a AS name,0 AS level FROM bo WHERE a='fn_1' UNION SELECT bo.b,w.level+1 FROM w JOIN bo ON bo.a=w.name WHERE w.level<4)
SELECT name,CAST(level AS INT) AS level FROM (SELECT name,level,row_number() OVER (ORDER BY level,name) AS rn FROM (SELECT name,min(level) AS level FROM w GROUP BY 1)) WHERE rn<=30""", E)
def _(spark, d):
    return graph.call_graph(_calls(spark, d), "fn_1")


_SCHEMA_TREE = ("SELECT 's'||p_partkey AS schema_id,CASE WHEN p_partkey>0 THEN 's'||CAST(FLOOR(p_partkey/2) AS BIGINT) END AS extends FROM part",
                "SELECT 's'||l_partkey AS schema_id,'pat'||l_suppkey AS pattern FROM lineitem WHERE l_returnflag='R'")


@query("inherited_patterns", f"""
WITH RECURSIVE sc AS ({_SCHEMA_TREE[0]}), pt AS ({_SCHEMA_TREE[1]}), up AS (SELECT schema_id,schema_id AS anc,0 AS k FROM sc UNION SELECT u.schema_id,s.extends,u.k+1 FROM up u JOIN sc s ON s.schema_id=u.anc WHERE s.extends IS NOT NULL AND u.k<5)
SELECT DISTINCT up.schema_id,pt.pattern FROM up JOIN pt ON pt.schema_id=up.anc""")
def _(spark, d):
    return graph.inherited_patterns(*(fx.sql(spark, d, s) for s in _SCHEMA_TREE))


_TOPICS = "SELECT CASE language WHEN 'python' THEN 'schema:fastapi' WHEN 'typescript' THEN 'schema:nextjs' ELSE 'schema:kotlin' END AS topic,corrections<2 AS success FROM v_file_results"
_ABOVE = ", ".join(f"('{t}','{a}')" for t, a in graph._all_topics())


@query("topic_rollup", f"WITH t AS ({_TOPICS}), up(topic,above) AS (VALUES {_ABOVE}) SELECT above AS topic,count(*) AS n,count(*) FILTER (success) AS ok FROM t JOIN up USING (topic) GROUP BY 1", ["v_file_results"])
def _(spark, d):
    fx.view(spark, d, "v_file_results").createOrReplaceTempView("v_file_results")
    return graph.topic_rollup(fx.sql(spark, d, _TOPICS))
