"""Registered queries over sources, the stored mesh and streams."""

from __future__ import annotations

import uuid
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.plans import fixtures as fx
from codeloom.plans.ask import ask, mesh_sql
from codeloom.plans.memory_queries import _FOLD, _TS
from codeloom.plans.registry import query
from codeloom.plans.review_queries import _PRICED
from codeloom.session import shared_dir, written
from codeloom.sources import files, store
from codeloom.streaming import streams

_CHANGE = r"""ch AS (SELECT range_id,CASE WHEN starts_with(line,'A') THEN 'added' WHEN starts_with(line,'M') THEN 'modified' WHEN starts_with(line,'D') THEN 'deleted' ELSE 'renamed' END AS change,CASE WHEN starts_with(line,'R') THEN string_split(line,chr(9))[3] ELSE string_split(line,chr(9))[2] END AS path,CASE WHEN starts_with(line,'R') THEN string_split(line,chr(9))[2] END AS old_path FROM v_name_status WHERE NOT starts_with(line,'C'))"""
NS = ["v_name_status"]


@query("read_name_status", f"WITH {_CHANGE} SELECT * FROM ch", NS)
def _(spark, d):
    return files.parse_name_status(fx.view(spark, d, "v_name_status"))


@query("changed_set", f"WITH {_CHANGE} SELECT DISTINCT range_id,path,'extract' AS action FROM ch WHERE change<>'deleted' UNION ALL SELECT DISTINCT range_id,COALESCE(old_path,path),'remove' FROM ch WHERE change IN ('deleted','renamed')", NS)
def _(spark, d):
    return files.changed_set(files.parse_name_status(fx.view(spark, d, "v_name_status")))


_LOG = "SELECT o_orderkey||chr(9)||substr(md5('c'||o_orderkey),1,7)||chr(9)||'fix '||o_orderpriority||chr(9)||'dev'||o_custkey||chr(9)||'d'||o_custkey||'@x.org'||chr(9)||'2024' AS line FROM orders"


@query("read_commit_log", "SELECT CAST(o_orderkey AS VARCHAR) AS commit_sha,substr(md5('c'||o_orderkey),1,7) AS commit_short,'fix '||o_orderpriority AS message,'dev'||o_custkey||' <d'||o_custkey||'@x.org>' AS author,'2024' AS committed_at FROM orders")
def _(spark, d):
    return files.parse_commit_log(fx.sql(spark, d, _LOG))


@query("scan_changed_files", f"WITH {_CHANGE} SELECT project_id,path FROM (SELECT project_id,path FROM v_sources) s WHERE EXISTS (SELECT 1 FROM ch WHERE regexp_extract(ch.path,'([^/]*)$',1)=regexp_extract(s.path,'([^/]*)$',1) AND change<>'deleted')", NS + ["v_sources"])
def _(spark, d):
    changed = files.parse_name_status(fx.view(spark, d, "v_name_status")).filter("change <> 'deleted'")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    sources = fx.view(spark, d, "v_sources").withColumn("full", F.col("path")).withColumn("path", name).withColumn("owner", F.col("project_id")).withColumn("project_id", F.lit("p"))
    return files.scan_changed_files(sources, changed.select(F.lit("p").alias("project_id"), name.alias("path"))).select(
        F.col("owner").alias("project_id"), F.col("full").alias("path"))


def _old_new(spark, d):
    nodes = fx.nodes(spark, d)
    new = nodes.filter("project_id IN ('proj1','proj2','proj3') AND type <> 'Class'")
    return nodes, new


_NEWSQL = "nw AS (SELECT * FROM v_nodes WHERE project_id IN ('proj1','proj2','proj3') AND type<>'Class')"
N = ["v_nodes"]


@query("replace_project_branch", f"WITH {_NEWSQL}, b AS (SELECT project_id,branch,count(*) AS removed,count(DISTINCT file) AS files_removed FROM v_nodes GROUP BY 1,2) SELECT project_id,branch,count(*) AS inserted,count(DISTINCT file) AS files_inserted,any_value(removed) AS removed,any_value(files_removed) AS files_removed FROM nw JOIN b USING (project_id,branch) GROUP BY 1,2", N)
def _(spark, d):
    return store.replace_report(*_old_new(spark, d))


@query("merge_incremental", f"WITH {_NEWSQL} SELECT id,name,file FROM v_nodes v WHERE type<>'Queue' AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.project_id=v.project_id AND nw.branch=v.branch AND nw.file=v.file) UNION ALL SELECT id,name||'_2',file FROM nw", N)
def _(spark, d):
    existing, new = _old_new(spark, d)
    new = new.withColumn("name", F.concat("name", F.lit("_2")))
    return store.merge_incremental(existing, new, existing.filter("type = 'Queue'").select("project_id", "branch", "file")).select("id", "name", "file")


@query("clear_project", "SELECT id,project_id FROM v_nodes WHERE project_id<>'proj7'", N)
def _(spark, d):
    return store.clear_project(fx.nodes(spark, d), "proj7").select("id", "project_id")


_FRESH = "SELECT CASE WHEN o_orderstatus='P' THEN 'x' ELSE 'o' END||o_orderkey AS id,'renamed'||o_custkey AS name FROM orders WHERE o_orderstatus<>'F'"


@query("upsert_nodes", f"WITH fr AS ({_FRESH}) SELECT COALESCE(f.id,n.id) AS id,COALESCE(f.name,n.name) AS name,n.method,CASE WHEN f.id IS NULL THEN NULL ELSE '1' END AS seen,CASE WHEN n.id IS NULL THEN 'created' WHEN f.id IS NULL THEN 'kept' ELSE 'updated' END AS status FROM v_nodes n FULL OUTER JOIN fr f ON f.id=n.id", N)
def _(spark, d):
    existing = fx.nodes(spark, d).select("id", "name", "properties")
    new = fx.sql(spark, d, _FRESH).withColumn("properties", F.create_map(F.lit("seen"), F.lit("1")))
    p = F.col("properties")
    return store.upsert_nodes(existing, new).select("id", "name", p["method"].alias("method"), p["seen"].alias("seen"), "status")


_FE = "SELECT DISTINCT 'o'||l_orderkey AS from_id,CASE WHEN l_returnflag='A' THEN 'zz' ELSE 'p' END||l_partkey AS to_id,CASE WHEN l_linestatus='O' THEN 'CALLS' ELSE 'USES' END AS type FROM lineitem"


@query("upsert_edges", f"WITH fe AS (SELECT e.* FROM ({_FE}) e JOIN v_nodes a ON a.id=e.from_id JOIN v_nodes b ON b.id=e.to_id), ol AS (SELECT from_id,to_id,type FROM v_edges) SELECT from_id,to_id,type,CASE WHEN o.f IS NULL THEN 'created' WHEN n.f IS NULL THEN 'kept' ELSE 'updated' END AS status FROM (SELECT *,1 AS f FROM ol) o FULL OUTER JOIN (SELECT *,1 AS f FROM fe) n USING (from_id,to_id,type)", ["v_nodes", "v_edges"])
def _(spark, d):
    empty = F.create_map().cast("map<string,string>")
    existing = fx.edges(spark, d).select("from_id", "to_id", "type").withColumn("properties", empty)
    new = fx.sql(spark, d, _FE).withColumn("properties", empty)
    return store.upsert_edges(existing, new, fx.nodes(spark, d)).drop("properties")


@query("new_vs_existing", f"WITH fr AS ({_FRESH}) SELECT DISTINCT f.id,CASE WHEN n.id IS NULL THEN 'created' ELSE 'updated' END AS status FROM fr f LEFT JOIN v_nodes n ON n.id=f.id", N)
def _(spark, d):
    return store.new_vs_existing(fx.nodes(spark, d), fx.sql(spark, d, _FRESH))


@query("export_mesh", "SELECT n.project_id,n.file,count(DISTINCT n.id) AS n_nodes,count(e.from_id) AS n_edges FROM v_nodes n LEFT JOIN v_edges e ON e.from_id=n.id GROUP BY 1,2", ["v_nodes", "v_edges"])
def _(spark, d):
    documents = store.export_mesh(fx.nodes(spark, d), fx.edges(spark, d))
    return documents.groupBy("project_id", "file").agg(
        F.sum(F.size("nodes")).alias("n_nodes"), F.sum(F.size("edges")).alias("n_edges"))


_INC = "SELECT id,schema_id,name,version+10 AS version,regex,is_active FROM v_pattern_versions WHERE is_active UNION ALL SELECT 'n/'||id,schema_id,name,version,regex,is_active FROM v_pattern_versions WHERE is_active"


@query("import_patterns", f"WITH ic AS ({_INC}) SELECT v.id,v.name,CAST(v.version AS INT) AS version FROM v_pattern_versions v WHERE NOT EXISTS (SELECT 1 FROM ic WHERE ic.id=v.id) UNION ALL SELECT id,name,CAST(version AS INT) FROM ic", ["v_pattern_versions"])
def _(spark, d):
    existing = fx.view(spark, d, "v_pattern_versions")
    existing.createOrReplaceTempView("v_pattern_versions")
    return store.import_patterns(existing, spark.sql(_INC), overwrite=True).select("id", "name", F.col("version").cast("int").alias("version"))


# ------------------------------------------------------------------ streams


def _folders(spark: SparkSession) -> tuple[str, str]:
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/checkpoint"


def _finished(running, spark: SparkSession, path: str) -> DataFrame:
    running.awaitTermination()
    return spark.read.parquet(path)


def _stream(spark: SparkSession, d: str, table: str, sql: str) -> DataFrame:
    """A fixture view over a streamed table."""
    streams.read_table_stream(spark, d, f"{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


@query("event_count_stream", "SELECT event_type,source,count(*) AS n FROM v_events GROUP BY 1,2", ["v_events"])
def _(spark, d):
    path, checkpoint = _folders(spark)
    log = _finished(streams.event_count_stream(_stream(spark, d, "events", fx.VIEWS["v_events"]), path, checkpoint), spark, path)
    return streams.total(log, ["event_type", "source"], ["n"])


@query("event_log_stream", "SELECT event_id,event_type FROM v_events WHERE starts_with(event_type,'mcp') AND source='mcp'", ["v_events"])
def _(spark, d):
    path, checkpoint = _folders(spark)
    events = _stream(spark, d, "events", fx.VIEWS["v_events"])
    return _finished(streams.event_log_stream(events, path, checkpoint, prefix="mcp", source="mcp"), spark, path).select("event_id", "event_type")


@query("paired_stream", "SELECT s.request_id,(epoch_us(CAST(e.ts AS TIMESTAMP))-epoch_us(CAST(s.ts AS TIMESTAMP)))/1000.0::DOUBLE AS duration_ms,e.event_type='mcp.tool.error' AS is_error FROM v_calls s JOIN v_calls e ON e.request_id=s.request_id AND e.event_type IN ('mcp.tool.result','mcp.tool.error') WHERE s.event_type='mcp.tool.called'", ["v_calls"])
def _(spark, d):
    path, checkpoint = _folders(spark)
    streams.paired_stream(_stream(spark, d, "orders", fx.VIEWS["v_calls"]), path, checkpoint).awaitTermination()
    return streams.paired_totals(spark, path).select("request_id", "duration_ms", "is_error")


@query("usage_stream", f"WITH {_PRICED} SELECT conv_id,model_id,count(*) AS calls,CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,round(sum(prompt_tokens*pi+completion_tokens*po)/1000000,6) AS cost_cents FROM pr GROUP BY 1,2", ["v_usage"])
def _(spark, d):
    path, checkpoint = _folders(spark)
    usage = _stream(spark, d, "conversations", fx.VIEWS["v_usage"])
    return streams.usage_totals(_finished(streams.usage_stream(usage, "conv_id", path, checkpoint), spark, path), "conv_id")


@query("verification_stream", f"WITH {_TS} SELECT schema_id,pattern_name,total,verified,corrected,rejected,trust_level FROM ts", ["v_verifications"])
def _(spark, d):
    path, checkpoint = _folders(spark)
    log = _stream(spark, d, "events", fx.VIEWS["v_verifications"])
    return streams.trust_totals(_finished(streams.verification_stream(log, path, checkpoint), spark, path)).drop("accuracy", "correction_rate")


@query("feedback_stream", _FOLD + "SELECT b.id,COALESCE(l.after_pct,b.conv_pct) AS conv_pct,CAST(b.usage_count+COALESCE(l.rn,0) AS BIGINT) AS usage_count FROM v_beliefs b LEFT JOIN (SELECT belief_id,max(rn) AS rn,arg_max(after_pct,rn) AS after_pct FROM f GROUP BY 1) l ON l.belief_id=b.id", ["v_beliefs", "v_outcomes"])
def _(spark, d):
    path, checkpoint = _folders(spark)
    maps = _finished(streams.feedback_stream(_stream(spark, d, "events", fx.VIEWS["v_outcomes"]), path, checkpoint), spark, f"{path}/maps")
    return streams.current_convictions(fx.beliefs(spark, d), maps)


#: A mesh before and after a change of some files of each customer: deleted, modified, renamed.
_BEFORE = """mv AS (SELECT 'src/'||c_mktsegment||'/c'||c_custkey||'.py' AS file,c_custkey%10 AS k,c_custkey AS ck FROM customer WHERE c_custkey%10 IN (1,2,3)),
n0 AS (SELECT n.id,n.type,n.name,n.project_id,n.branch,n.file,n.line_start,mv.k,mv.ck FROM v_nodes n LEFT JOIN mv ON mv.file=n.file)"""
_AFTER = """n2 AS (SELECT id AS old_id,CASE WHEN k=2 AND type<>'File' THEN id||'-2' WHEN k=3 THEN id||'-m' ELSE id END AS id,type,CASE WHEN k=2 AND type<>'File' AND line_start%4=1 THEN 'new_'||name ELSE name END AS name,project_id,branch,CASE WHEN k=3 THEN 'src/moved/c'||ck||'.py' ELSE file END AS file,line_start FROM n0 WHERE k IS NULL OR k<>1)"""
_DRAWN = """e0 AS (SELECT e.from_id,e.to_id,e.type,f.project_id,f.branch,f.file,COALESCE(t.name,e.to_id) AS target_name,COALESCE(t.file=f.file AND t.project_id=f.project_id AND t.branch=f.branch,false) AS in_file FROM v_edges e JOIN n0 f ON f.id=e.from_id LEFT JOIN n0 t ON t.id=e.to_id)"""
_REDRAWN = """e2 AS (SELECT f.id AS from_id,CASE WHEN e.in_file THEN t.id ELSE e.to_id END AS to_id,e.type,f.project_id,f.branch,f.file,e.target_name,e.in_file FROM e0 e JOIN n2 f ON f.old_id=e.from_id LEFT JOIN n2 t ON t.old_id=e.to_id)"""
_SYNC = ",\n".join((_BEFORE, _AFTER, _DRAWN, _REDRAWN))
_LINES = """SELECT 'proj'||c_nationkey AS project_id,CASE WHEN c_custkey%3=0 THEN 'dev' ELSE 'main' END AS branch,CASE c_custkey%10 WHEN 1 THEN 'D' WHEN 2 THEN 'M' ELSE 'R090' END||chr(9)||'src/'||c_mktsegment||'/c'||c_custkey||'.py'||CASE WHEN c_custkey%10=3 THEN chr(9)||'src/moved/c'||c_custkey||'.py' ELSE '' END AS line FROM customer WHERE c_custkey%10 IN (1,2,3)"""


@query("incremental_sync", f"""WITH {_SYNC}, ft AS (SELECT project_id,branch,name,id,row_number() OVER (PARTITION BY project_id,branch,name ORDER BY file,line_start,id) AS rn FROM n2)
SELECT 'node' AS kind,id AS source,name AS target,type,file,project_id,branch FROM n2
UNION ALL SELECT 'edge',e.from_id,CASE WHEN e.in_file THEN e.to_id ELSE COALESCE(ft.id,e.target_name) END,e.type,e.file,e.project_id,e.branch FROM e2 e LEFT JOIN ft ON ft.rn=1 AND ft.project_id=e.project_id AND ft.branch=e.branch AND ft.name=e.target_name""", ["v_nodes", "v_edges"])
def _(spark, d):
    path, checkpoint = _folders(spark)
    nodes, edges = "id,type,name,project_id,branch,file,line_start".split(","), "from_id,to_id,type,target_name,in_file,project_id,branch,file".split(",")
    place, at = ["project_id", "branch", "file"], ["t_project", "t_branch", "t_file"]
    # The mesh before the change is read for what is stored and for what is extracted; it is joined once and written down.
    with ExitStack() as tables:
        n0 = tables.enter_context(written(fx.sql(spark, d, f"{fx.ctes('v_nodes')}, {_BEFORE} SELECT * FROM n0")))
        store.release_shuffles(spark)
        f, t = n0.select("id", *place), n0.select("id", "name", *[F.col(a).alias(b) for a, b in zip(place, at)])
        in_file = F.coalesce(F.expr(" AND ".join(f"{b}={a}" for a, b in zip(place, at))), F.lit(False))
        with written(fx.sql(spark, d, f"{fx.ctes('v_edges')} SELECT from_id,to_id,type FROM v_edges")) as drawn:
            store.release_shuffles(spark)
            with store.joined(drawn, f, ("from_id", "id"), "inner", ["from_id", "to_id", "type", *place]) as owned:
                e0 = tables.enter_context(store.joined(owned, t, ("to_id", "id"), "left", [
                    "from_id", "to_id", "type", *place, F.coalesce("name", "to_id").alias("target_name"), in_file.alias("in_file")]))
        old = n0.select(*nodes)
        store.write_branches(old, f"{path}/nodes")
        for part in store.in_parts(e0.groupBy(*store.KEYS).count()):
            store.write_branches(store.bind_targets(part(e0.select(*edges)), part(old)), f"{path}/edges")
        n0.createOrReplaceTempView("n0")
        n2 = spark.sql(f"WITH {_AFTER} SELECT * FROM n2")
        spark.catalog.dropTempView("n0")

        def extract(wanted):
            files_of = wanted.withColumnRenamed("path", "file")
            here = tables.enter_context(written(n2.join(files_of, place, "left_semi")))
            f, t = here.select("old_id", "id", *place), n2.select("old_id", F.col("id").alias("new_id"))
            drawn = e0.select(F.col("from_id").alias("drawn_id"), "to_id", "type", "target_name", "in_file")
            with store.joined(drawn, f, ("drawn_id", "old_id"), "inner", [F.col("id").alias("from_id"), *drawn.columns[1:], *place]) as owned:
                to_id = F.when(F.col("in_file"), F.col("new_id")).otherwise(F.col("to_id")).alias("to_id")
                return here.select(*nodes), tables.enter_context(store.joined(
                    owned, t, ("to_id", "old_id"), "left", ["from_id", to_id, *edges[2:]]))

        streams.incremental_sync(_stream(spark, d, "customer", _LINES), extract, f"{path}/nodes", f"{path}/edges", checkpoint).awaitTermination()
    common = ["type", "file", "project_id", "branch"]
    return spark.read.parquet(f"{path}/nodes").select(F.lit("node").alias("kind"), F.col("id").alias("source"), F.col("name").alias("target"), *common).unionByName(
        spark.read.parquet(f"{path}/edges").select(F.lit("edge").alias("kind"), F.col("from_id").alias("source"), F.col("to_id").alias("target"), *common))


# ------------------------------------------------ written out and read again


_RUN = ["id", "project_id", "branch", "commit_sha", "files_processed", "files_skipped"]


@query("record_extraction_run", f"SELECT {','.join(_RUN)} FROM v_runs", ["v_runs"])
def _(spark, d):
    """Runs of either branch are appended one after the other; a log holds them all."""
    path = f"{shared_dir(spark)}/run-log-{uuid.uuid4().hex}"
    runs = fx.view(spark, d, "v_runs").select(*_RUN)
    for branch in ("main", "dev"):
        store.record_extraction_run(runs.filter(F.col("branch") == branch), path)
    return spark.read.parquet(path).select(*_RUN)


@query("export_patterns", """SELECT id,schema_id,CASE WHEN version=1 THEN 'own '||name ELSE name END AS name,CAST(version AS INT) AS version,regex,is_active FROM v_pattern_versions""", ["v_pattern_versions"])
def _(spark, d):
    """An export read back adds what a store lacks and leaves what it has under its own name."""
    path = f"{shared_dir(spark)}/patterns-{uuid.uuid4().hex}"
    versions = fx.view(spark, d, "v_pattern_versions").withColumn("version", F.col("version").cast("int"))
    store.export_patterns(versions, path)
    known = versions.filter("version = 1").withColumn("name", F.concat(F.lit("own "), "name"))
    return store.import_patterns(known, spark.read.schema(versions.schema).json(path))


_KEPT = "CASE type WHEN 'ApiEndpoint' THEN {0} END"


@query("property_map", f"SELECT id,{_KEPT.format('method')} AS method,{_KEPT.format('path')} AS path FROM v_nodes", ["v_nodes"])
def _(spark, d):
    """Properties of endpoints come back from JSON; broken and missing texts give empty maps."""
    nodes = fx.nodes(spark, d)
    text = F.when(F.col("type") == "ApiEndpoint", F.to_json("properties")).when(F.col("type") == "Method", F.lit('{"method": ["GET'))
    bag = scalars.property_map(text)
    return nodes.select("id", bag["method"].alias("method"), bag["path"].alias("path"))


@query("operation_ids", r"""SELECT id,lower(method)||'_'||CASE WHEN w='' THEN 'root' ELSE w END AS operation_id FROM (SELECT id,method,trim(regexp_replace(regexp_replace(path,'[{}:]','','g'),'/+','_','g'),'_') AS w FROM (SELECT id,method,path FROM v_nodes WHERE method IS NOT NULL AND path IS NOT NULL UNION ALL SELECT 'root/'||id,method,'/' FROM v_nodes WHERE method IS NOT NULL AND path IS NOT NULL))""", ["v_nodes"])
def _(spark, d):
    """Every endpoint, by its own path and by the empty one."""
    method, path = F.col("properties")["method"], F.col("properties")["path"]
    rows = fx.nodes(spark, d).select("id", method.alias("method"), path.alias("path")).filter("method IS NOT NULL AND path IS NOT NULL")
    rows = rows.unionByName(rows.select(F.concat(F.lit("root/"), "id").alias("id"), "method", F.lit("/").alias("path")))
    return rows.select("id", scalars.operation_id("method", "path").alias("operation_id"))


# ----------------------------------------------------------------- questions


@query("ask", """SELECT e.from_id AS caller_id,e.to_id AS target_id FROM v_edges e JOIN v_nodes c ON c.id=e.from_id JOIN v_nodes t ON t.id=e.to_id WHERE e.type='CALLS' AND t.name='m_9' ORDER BY c.file,c.line_start,e.from_id,e.to_id LIMIT 50""", ["v_nodes", "v_edges"])
def _(spark, d):
    return ask(fx.nodes(spark, d), fx.edges(spark, d), "who calls m_9").select("caller_id", "target_id")


@query("mesh_sql", "SELECT n.type,count(*) AS n FROM v_nodes n JOIN v_edges e ON e.to_id=n.id GROUP BY 1", ["v_nodes", "v_edges"])
def _(spark, d):
    return mesh_sql(spark, fx.nodes(spark, d), fx.edges(spark, d),
                    "SELECT n.type, count(*) AS n FROM mesh_nodes n JOIN mesh_edges e ON e.to_id = n.id GROUP BY n.type")
