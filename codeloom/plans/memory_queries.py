"""Registered queries over knowledge records, feedback and trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import folds, graph, memory, trust
from codeloom.plans import fixtures as fx
from codeloom.plans.registry import query

B, P, T = ["v_beliefs"], ["v_principles"], ["v_patterns"]
MEM = ["v_beliefs", "v_principles", "v_patterns"]
_MEM_SQL = """mem AS (SELECT id,'belief' AS kind,content,lower(content) AS text,conv_pct,domain,category FROM v_beliefs
UNION ALL SELECT id,'principle',content,lower(content),conv_pct,domain,NULL FROM v_principles
UNION ALL SELECT id,'pattern',name||': '||description,lower(name||' '||description),conv_pct,domain,NULL FROM v_patterns)"""


def _pct(column: str):
    return F.round(F.col(column) * 100, 0).cast("int").alias("conv_pct")


def _memory(spark, d):
    return memory.memory_union(fx.beliefs(spark, d), fx.principles(spark, d), fx.patterns(spark, d))


@query("list_beliefs", "SELECT id,conv_pct,domain,category FROM v_beliefs WHERE category='fr' AND conv_pct>=40", B)
def _(spark, d):
    return memory.list_beliefs(fx.beliefs(spark, d), category="fr", min_conviction=0.4).select("id", "conv_pct", "domain", "category")


@query("list_principles", "SELECT id,content,conv_pct FROM v_principles WHERE domain='ECONOMY' AND conv_pct>=70", P)
def _(spark, d):
    return memory.list_principles(fx.principles(spark, d), "ECONOMY", 0.7).select("id", "content", "conv_pct")


@query("list_patterns", "SELECT id,name,usage_count,conv_pct FROM v_patterns", T)
def _(spark, d):
    return memory.list_patterns(fx.patterns(spark, d)).select("id", "name", "usage_count", "conv_pct")


@query("review_queue", "SELECT id,item_type,strftime(flagged_at,'%Y-%m-%d %H:%M:%S') AS flagged_at FROM v_review_items WHERE NOT resolved", ["v_review_items"])
def _(spark, d):
    return memory.review_queue(fx.view(spark, d, "v_review_items")).select(
        "id", "item_type", F.date_format("flagged_at", "yyyy-MM-dd HH:mm:ss").alias("flagged_at"))


@query("resolve_reviews", "SELECT id,resolved OR item_type='click' AS resolved,CASE WHEN item_type='click' THEN 'remove' END AS resolution FROM v_review_items", ["v_review_items"])
def _(spark, d):
    items = fx.view(spark, d, "v_review_items")
    done = items.filter("item_type='click'").select("id", F.lit("remove").alias("resolution"))
    return memory.resolve_reviews(items, done).select("id", "resolved", "resolution")


@query("memory_union", f"WITH {_MEM_SQL} SELECT id,kind,content,conv_pct FROM mem", MEM)
def _(spark, d):
    return _memory(spark, d).select("id", "kind", "content", _pct("conviction"))


@query("memory_counts", "SELECT 'beliefs' AS kind,count(*) AS n FROM v_beliefs UNION ALL SELECT 'principles',count(*) FROM v_principles UNION ALL SELECT 'patterns',count(*) FROM v_patterns UNION ALL SELECT 'total',(SELECT count(*) FROM v_beliefs)+(SELECT count(*) FROM v_principles)+(SELECT count(*) FROM v_patterns)", MEM)
def _(spark, d):
    return memory.memory_counts(fx.beliefs(spark, d), fx.principles(spark, d), fx.patterns(spark, d))


@query("conviction_bands", "SELECT count(*) FILTER (conv_pct>=80) AS high,count(*) FILTER (conv_pct>=50 AND conv_pct<80) AS medium,count(*) FILTER (conv_pct<50) AS low FROM v_beliefs", B)
def _(spark, d):
    return memory.conviction_bands(fx.beliefs(spark, d))


SEARCHES = ["retry queue", "the regex for error handling", "keyword rules", "un le dans"]


def _search_sql(floor: int, limit: int) -> str:
    parts = []
    for text in SEARCHES:
        words = text.split()
        hits = "+".join(f"CAST(contains(text,'{w}') AS INT)" for w in words)
        parts.append(f"SELECT '{text}' AS query,id,kind,content,category,conv_pct,({hits})/{float(len(words))} AS score FROM mem WHERE kind='pattern' OR conv_pct>={floor}")
    return (f"WITH {_MEM_SQL}, sc AS ({' UNION ALL '.join(parts)}), rk AS (SELECT *,row_number() OVER (PARTITION BY query ORDER BY score DESC,kind,id) AS rn FROM sc WHERE score>0) "
            f"SELECT query,id,kind,content,category,round(score,6) AS score FROM rk WHERE rn<={limit}")


@query("keyword_search", _search_sql(60, 10), MEM)
def _(spark, d):
    return memory.keyword_search(_memory(spark, d), SEARCHES, 10, min_conviction=0.6).select(
        "query", "id", "kind", "content", "category", F.round("score", 6).alias("score"))


@query("query_beliefs", f"SELECT query,id,score FROM ({_search_sql(0, 200)}) WHERE kind='belief' AND category='fr'".replace(f"WITH {_MEM_SQL}, ", f"WITH {_MEM_SQL}, "), MEM)
def _(spark, d):
    return memory.query_beliefs(_memory(spark, d), SEARCHES, 200, category="fr").select("query", "id", F.round("score", 6).alias("score"))


_EXAMPLES = "SELECT 'pattern-'||l_suppkey AS id,l_orderkey*10+l_linenumber AS position,'code '||l_partkey AS example FROM lineitem"


@query("find_examples", f"""
WITH {_MEM_SQL}, ex AS (SELECT id,position,min(example) AS example FROM ({_EXAMPLES}) GROUP BY 1,2), sc AS (SELECT id,kind,(CAST(contains(text,'retry') AS INT)+CAST(contains(text,'supplier#000000003') AS INT))/2.0 AS score FROM mem),
rk AS (SELECT * FROM (SELECT *,row_number() OVER (ORDER BY score DESC,kind,id) AS rn FROM sc WHERE score>0) WHERE rn<=5 AND kind='pattern'),
pe AS (SELECT ex.*,rk.score,row_number() OVER (PARTITION BY ex.id ORDER BY position) AS pn FROM ex JOIN rk ON rk.id=ex.id)
SELECT id,position,example FROM pe WHERE pn<=5 ORDER BY score DESC,id,position LIMIT 5""", MEM)
def _(spark, d):
    everything = _memory(spark, d)
    examples = fx.sql(spark, d, _EXAMPLES).groupBy("id", "position").agg(F.min("example").alias("example"))
    return memory.find_examples(everything, examples, "retry supplier#000000003", 5)


QUERY_VECTORS = [[1.0 / (i + 1) for i in range(64)], [1.0 if i % 2 else -1.0 for i in range(64)], [float(i % 5) + 0.5 for i in range(64)]]


def _vector_sql() -> str:
    parts = [f"SELECT {i} AS query,vec_id AS id,round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),{v}::DOUBLE[]),6) AS score FROM embeddings" for i, v in enumerate(QUERY_VECTORS)]
    return f"SELECT CAST(query AS INT) AS query,id,score FROM (SELECT *,row_number() OVER (PARTITION BY query ORDER BY score DESC,id) AS rn FROM ({' UNION ALL '.join(parts)}) WHERE score>=0) WHERE rn<=10"


@query("vector_search", _vector_sql())
def _(spark, d):
    vectors = fx.sql(spark, d, "SELECT * FROM embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return memory.vector_search(vectors, QUERY_VECTORS, 10, min_score=0.0)


_STOP = ",".join(f"'{w}'" for w in memory.STOP_WORDS)
_STRIP = memory.PUNCTUATION.replace("'", "''")
_ENT = (f"en AS (SELECT id,unnest(list_filter(list_transform(list_slice(list_filter(regexp_split_to_array(lower(content),'[\\s\\p{{Z}}]+'),lambda w: length(w)>4 AND w NOT IN ({_STOP})),1,5),lambda w: trim(w,'{_STRIP}')),lambda w: w<>'')) AS entity FROM v_beliefs)")


@query("belief_entities", f"WITH {_ENT} SELECT id,entity FROM en", B)
def _(spark, d):
    return memory.belief_entities(fx.beliefs(spark, d))


@query("entity_context", f"WITH {_ENT} SELECT DISTINCT en.id,en.entity,b.conv_pct FROM en JOIN v_beliefs b ON b.id=en.id", B)
def _(spark, d):
    return memory.entity_context(fx.beliefs(spark, d)).select("id", "entity", _pct("conviction"))


@query("entity_counts", f"WITH {_ENT} SELECT entity,count(*) AS mentions,count(DISTINCT id) AS beliefs FROM en GROUP BY 1", B)
def _(spark, d):
    return memory.entity_counts(fx.beliefs(spark, d))


@query("belief_pairs", """SELECT a.id,count(b.id) FILTER (b.domain=a.domain AND a.domain<>'') AS same_domain,count(b.id) FILTER (b.category=a.category AND a.category<>'' AND NOT COALESCE(b.domain=a.domain AND a.domain<>'',false)) AS same_category
FROM v_beliefs a LEFT JOIN v_beliefs b ON b.id<>a.id GROUP BY 1""", B)
def _(spark, d):
    return memory.belief_pairs(fx.beliefs(spark, d))


@query("belief_ties_of", """SELECT a.id AS id_a,b.id AS id_b,CASE WHEN a.domain=b.domain THEN 'SAME_DOMAIN' ELSE 'SAME_CATEGORY' END AS type FROM v_beliefs a JOIN v_beliefs b ON a.id<>b.id AND (a.domain=b.domain OR a.category=b.category) WHERE a.id IN ('belief-3','belief-11')""", B)
def _(spark, d):
    return memory.ties_of(fx.beliefs(spark, d), ["belief-3", "belief-11"])


@query("belief_graph_nodes", f"""WITH {_ENT} SELECT id,'belief' AS type,CASE WHEN length(content)>50 THEN substr(content,1,50)||'...' ELSE content END AS label,CASE WHEN conv_pct>=80 THEN '#4CAF50' WHEN conv_pct>=50 THEN '#FFC107' ELSE '#F44336' END AS color,round(30+conv_pct*0.2,6)::DOUBLE AS size FROM v_beliefs
UNION ALL SELECT DISTINCT 'entity-'||entity,'entity',entity,'#9C27B0',15.0::DOUBLE FROM en""", B)
def _(spark, d):
    return memory.belief_graph_nodes(fx.beliefs(spark, d)).withColumn("size", F.round("size", 6))


@query("belief_graph_edges", f"""WITH {_ENT} SELECT id AS source,'entity-'||entity AS target,'MENTIONS' AS type,'#999999' AS color FROM en
UNION ALL SELECT id,'domain:'||domain,'SAME_DOMAIN','#2196F3' FROM v_beliefs WHERE domain<>'' UNION ALL SELECT id,'category:'||category,'SAME_CATEGORY','#FF9800' FROM v_beliefs WHERE category<>''""", B)
def _(spark, d):
    return memory.belief_graph_edges(fx.beliefs(spark, d))


@query("belief_graph_stats", f"""WITH {_ENT}, c AS (SELECT count(*) AS n,count(DISTINCT entity) AS e FROM en), p AS (SELECT count(*) AS n FROM v_beliefs a JOIN v_beliefs b ON a.id<b.id AND (a.domain=b.domain OR a.category=b.category)), b AS (SELECT count(*) AS n,round(avg(conv_pct/100.0),3) AS a FROM v_beliefs)
SELECT b.n+c.e AS node_count,c.n+p.n AS edge_count,b.n AS belief_count,c.e AS entity_count,b.a AS avg_conviction FROM b,c,p""", B)
def _(spark, d):
    return memory.belief_graph_stats(fx.beliefs(spark, d))


@query("shortest_path", f"""
WITH RECURSIVE {_ENT}, ed AS (SELECT id AS a,'entity-'||entity AS b FROM en UNION SELECT 'entity-'||entity,id FROM en),
nb(id,k) AS (SELECT 'belief-0',1 UNION SELECT x.b,x.k FROM (SELECT ed.b,nb.k+1 AS k FROM nb JOIN ed ON ed.a=nb.id WHERE nb.k<4 UNION ALL SELECT t.id,nb.k+1 FROM nb JOIN v_beliefs s ON s.id=nb.id JOIN v_beliefs t ON t.domain=s.domain OR t.category=s.category WHERE nb.k<4) x)
SELECT CAST(min(k) AS BIGINT) AS n_nodes FROM nb WHERE id=(SELECT 'entity-'||max(entity) FROM en)""", B)
def _(spark, d):
    beliefs = fx.beliefs(spark, d)
    target = "entity-" + memory.belief_entities(beliefs).agg(F.max("entity")).first()[0]
    return graph.shortest_path(memory.belief_links(beliefs), "belief-0", target, 4).agg(
        F.max("position").cast("bigint").alias("n_nodes"))


_CONFLICT = """SELECT 'b'||o_orderkey AS id,'Using '||CASE o_orderstatus WHEN 'F' THEN 'a Regex' WHEN 'O' THEN 'plain text' ELSE 'keyword and regex' END||' for '||o_orderpriority AS content FROM orders"""


@query("check_conflicts", f"""
WITH tx AS ({_CONFLICT}), kw(keyword) AS (VALUES ('regex'),('keyword')), av AS (SELECT p.id,kw.keyword FROM v_principles p JOIN kw ON contains(lower(p.content),kw.keyword) WHERE conv_pct>=70 AND (contains(lower(content),'never') OR contains(lower(content),'avoid')))
SELECT tx.id,av.keyword,count(*) AS n_principles FROM tx JOIN av ON contains(lower(tx.content),av.keyword) GROUP BY 1,2""", P)
def _(spark, d):
    principles = fx.principles(spark, d)
    return memory.check_conflicts(fx.sql(spark, d, _CONFLICT), principles).drop("confidence")


@query("avoid_principles", "SELECT p.id,kw.keyword FROM v_principles p JOIN (VALUES ('regex'),('keyword')) kw(keyword) ON contains(lower(p.content),kw.keyword) WHERE conv_pct>=70 AND (contains(lower(content),'never') OR contains(lower(content),'avoid'))", P)
def _(spark, d):
    return memory.avoid_principles(fx.principles(spark, d))


@query("validate_learning", "SELECT id,length(content)>0 AND length(content)<=2000 AND conv_pct BETWEEN 0 AND 100 AS is_valid FROM v_beliefs", B)
def _(spark, d):
    return memory.validate_learning(fx.beliefs(spark, d)).select("id", "is_valid")


# -------------------------------------------------------------------- folds

_FOLD = """
WITH RECURSIVE d AS (SELECT o.belief_id,o.event_id,o.outcome,b.conv_pct AS x0,CASE outcome WHEN 'helpful' THEN 5 WHEN 'not_helpful' THEN -3 WHEN 'misleading' THEN -10 WHEN 'outdated' THEN -5 ELSE 0 END AS dl,row_number() OVER (PARTITION BY o.belief_id ORDER BY ts,event_id) AS rn FROM v_outcomes o JOIN v_beliefs b ON b.id=o.belief_id),
f AS (SELECT belief_id,event_id,outcome,rn,x0 AS before_pct,CAST(greatest(0,least(100,x0+dl)) AS INT) AS after_pct FROM d WHERE rn=1 UNION ALL SELECT d.belief_id,d.event_id,d.outcome,d.rn,f.after_pct,CAST(greatest(0,least(100,f.after_pct+d.dl)) AS INT) FROM f JOIN d ON d.belief_id=f.belief_id AND d.rn=f.rn+1)
"""
FB = ["v_beliefs", "v_outcomes"]


@query("feedback_fold", _FOLD + "SELECT b.id,COALESCE(l.after_pct,b.conv_pct) AS conv_pct,CAST(b.usage_count+COALESCE(l.rn,0) AS BIGINT) AS usage_count FROM v_beliefs b LEFT JOIN (SELECT belief_id,max(rn) AS rn,arg_max(after_pct,rn) AS after_pct FROM f GROUP BY 1) l ON l.belief_id=b.id", FB)
def _(spark, d):
    return folds.feedback_fold(fx.beliefs(spark, d), fx.view(spark, d, "v_outcomes"))


@query("feedback_states", _FOLD + "SELECT belief_id,event_id,CAST(before_pct AS INT) AS before_pct,after_pct FROM f", FB)
def _(spark, d):
    return folds.feedback_states(fx.beliefs(spark, d), fx.view(spark, d, "v_outcomes")).drop("outcome")


@query("flag_reviews", _FOLD + "SELECT event_id,belief_id,after_pct,CASE WHEN outcome='misleading' THEN 'misleading' ELSE 'low_conviction' END AS review_type FROM f WHERE outcome='misleading' OR after_pct<30", FB)
def _(spark, d):
    return folds.flag_reviews(fx.beliefs(spark, d), fx.view(spark, d, "v_outcomes"))


_ADJ = """
WITH RECURSIVE g AS (SELECT belief_id,ts,event_id FROM (SELECT *,row_number() OVER (PARTITION BY belief_id ORDER BY ts,event_id) AS rn FROM v_adjustments WHERE action='delete') WHERE rn=1),
s AS (SELECT a.*,b.conv_pct,CASE WHEN b.id IS NULL OR (a.ts,a.event_id)>(g.ts,g.event_id) THEN 'error' WHEN action='delete' THEN 'deleted' WHEN action IN ('reinforce','weaken') THEN 'updated' WHEN action='modify' AND COALESCE(new_content,'')<>'' THEN 'updated' ELSE 'error' END AS status FROM v_adjustments a LEFT JOIN v_beliefs b ON b.id=a.belief_id LEFT JOIN g ON g.belief_id=a.belief_id)
"""


@query("adjustment_status", _ADJ.replace("RECURSIVE ", "") + "SELECT event_id,belief_id,action,status FROM s", ["v_beliefs", "v_adjustments"])
def _(spark, d):
    return folds.adjustment_status(fx.beliefs(spark, d), fx.view(spark, d, "v_adjustments")).select("event_id", "belief_id", "action", "status")


@query("adjust_beliefs", _ADJ + """, r AS (SELECT belief_id,conv_pct,CASE action WHEN 'reinforce' THEN 10 ELSE -15 END AS dl,row_number() OVER (PARTITION BY belief_id ORDER BY ts,event_id) AS rn FROM s WHERE status='updated' AND action<>'modify'),
f AS (SELECT belief_id,rn,CAST(greatest(0,least(100,conv_pct+dl)) AS INT) AS x FROM r WHERE rn=1 UNION ALL SELECT r.belief_id,r.rn,CAST(greatest(0,least(100,f.x+r.dl)) AS INT) FROM f JOIN r ON r.belief_id=f.belief_id AND r.rn=f.rn+1),
t AS (SELECT belief_id,arg_max(new_content,(ts,event_id)) AS c FROM s WHERE status='updated' AND action='modify' GROUP BY 1)
SELECT b.id,COALESCE(l.x,b.conv_pct) AS conv_pct,md5(COALESCE(t.c,b.content)) AS content_md5 FROM v_beliefs b LEFT JOIN (SELECT belief_id,arg_max(x,rn) AS x FROM f GROUP BY 1) l ON l.belief_id=b.id LEFT JOIN t ON t.belief_id=b.id WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.belief_id=b.id AND s.status='deleted')""", ["v_beliefs", "v_adjustments"])
def _(spark, d):
    return folds.adjust_beliefs(fx.beliefs(spark, d), fx.view(spark, d, "v_adjustments")).select(
        "id", "conv_pct", F.md5("content").alias("content_md5"))


# -------------------------------------------------------------------- trust

_TS = """ts AS (SELECT *,CASE WHEN accuracy>=0.95 AND correction_rate<=0.05 AND total>=100 THEN 'trusted' WHEN accuracy>=0.9 AND correction_rate<=0.1 AND total>=50 THEN 'high' WHEN accuracy>=0.8 AND total>=20 THEN 'medium' ELSE 'low' END AS trust_level FROM
(SELECT schema_id,pattern_name,count(*) AS total,count(*) FILTER (result='verified') AS verified,count(*) FILTER (result='corrected') AS corrected,count(*) FILTER (result='rejected') AS rejected,count(*) FILTER (result='verified')/count(*) AS accuracy,count(*) FILTER (result='corrected')/count(*) AS correction_rate,count(*) FILTER (result='rejected')/count(*) AS rejection_rate FROM v_verifications GROUP BY 1,2))"""
V, VV = ["v_verifications"], ["v_verifications", "v_pattern_versions"]
_RATE = "CASE trust_level WHEN 'trusted' THEN 0.05 WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.5 ELSE 1.0 END::DOUBLE"


def _scores(spark, d):
    return trust.trust_scores(fx.view(spark, d, "v_verifications"))


@query("trust_scores", f"WITH {_TS} SELECT schema_id,pattern_name,total,verified,corrected,rejected,round(accuracy,6) AS accuracy,round(correction_rate,6) AS correction_rate,round(rejection_rate,6) AS rejection_rate,trust_level,{_RATE} AS sample_rate FROM ts", V)
def _(spark, d):
    scores = _scores(spark, d)
    return scores.select(*[F.round(c, 6).alias(c) if c in ("accuracy", "correction_rate", "rejection_rate") else c for c in scores.columns])


@query("trust_summary", f"WITH {_TS} SELECT count(*) AS total_patterns,count(*) FILTER (trust_level='low') AS n_low,count(*) FILTER (trust_level='medium') AS n_medium,count(*) FILTER (trust_level='high') AS n_high,count(*) FILTER (trust_level='trusted') AS n_trusted,round(avg(accuracy),6) AS average_accuracy,CAST(sum(total) AS BIGINT) AS total_extractions,CAST(sum(corrected) AS BIGINT) AS total_corrections,round(sum(verified)/sum(total),6) AS run_accuracy FROM ts", V)
def _(spark, d):
    return trust.trust_summary(_scores(spark, d)).withColumn("average_accuracy", F.round("average_accuracy", 6)).withColumn(
        "run_accuracy", F.round("run_accuracy", 6))


_ST = _TS + ", ac AS (SELECT schema_id,avg(accuracy) AS accuracy,CAST(sum(total) AS BIGINT) AS total FROM ts WHERE EXISTS (SELECT 1 FROM v_pattern_versions v WHERE v.is_active AND v.schema_id=ts.schema_id AND v.name=ts.pattern_name) GROUP BY 1)"


@query("schema_trust", f"WITH {_ST} SELECT schema_id,round(accuracy,6) AS accuracy,total,CASE WHEN accuracy>=0.95 AND total>=100 THEN 'trusted' WHEN accuracy>=0.9 AND total>=50 THEN 'high' WHEN accuracy>=0.8 AND total>=20 THEN 'medium' ELSE 'low' END AS trust_level FROM ac", VV)
def _(spark, d):
    return trust.schema_trust(_scores(spark, d), fx.view(spark, d, "v_pattern_versions")).select(
        "schema_id", F.round("accuracy", 6).alias("accuracy"), "total", "trust_level")


_POOR = _TS + ", po AS (SELECT * FROM ts WHERE total>=20 AND (correction_rate>0.1 OR rejection_rate>0.05) AND EXISTS (SELECT 1 FROM v_pattern_versions v WHERE v.is_active AND v.schema_id=ts.schema_id AND v.name=ts.pattern_name) )"


@query("patterns_needing_evolution", f"WITH {_POOR} SELECT schema_id,pattern_name,total,round(accuracy,6) AS accuracy FROM po", VV)
def _(spark, d):
    return trust.patterns_needing_evolution(_scores(spark, d), fx.view(spark, d, "v_pattern_versions")).select(
        "schema_id", "pattern_name", "total", F.round("accuracy", 6).alias("accuracy"))


@query("evolution_evidence", f"WITH {_POOR} SELECT c.id,c.pattern_id,c.snippet FROM v_corrections c JOIN po ON c.pattern_id=po.schema_id||'/'||po.pattern_name", VV + ["v_corrections"])
def _(spark, d):
    poor = trust.patterns_needing_evolution(_scores(spark, d), fx.view(spark, d, "v_pattern_versions"))
    return trust.evolution_evidence(poor, fx.view(spark, d, "v_corrections")).select("id", "pattern_id", "snippet")


@query("latest_corrections", "SELECT id,pattern_id,snippet FROM (SELECT *,row_number() OVER (PARTITION BY pattern_id ORDER BY created_at DESC,id DESC) AS rn FROM v_corrections) WHERE rn<=5", ["v_corrections"])
def _(spark, d):
    return trust.latest_corrections(fx.view(spark, d, "v_corrections")).drop("created_at")


@query("top_trust", f"WITH {_TS} SELECT schema_id,pattern_name,round(accuracy,6) AS accuracy FROM ts ORDER BY ts.accuracy DESC,schema_id,pattern_name LIMIT 20", V)
def _(spark, d):
    return trust.top_trust(_scores(spark, d)).select("schema_id", "pattern_name", F.round("accuracy", 6).alias("accuracy"))


@query("active_patterns", "SELECT id,schema_id,name,version,regex FROM v_pattern_versions WHERE is_active", ["v_pattern_versions"])
def _(spark, d):
    return trust.active_patterns(fx.view(spark, d, "v_pattern_versions")).drop("is_active")


@query("current_version", "SELECT schema_id,name,max(version) AS version,arg_max(id,version) AS id FROM v_pattern_versions GROUP BY 1,2", ["v_pattern_versions"])
def _(spark, d):
    return trust.current_version(fx.view(spark, d, "v_pattern_versions")).select("schema_id", "name", "version", "id")


_NEW = "SELECT id,regex||'x' AS new_regex FROM v_pattern_versions WHERE is_active AND schema_id IN ('schema1','schema2')"


@query("evolve_patterns", f"""WITH nw AS ({_NEW}) SELECT v.id,schema_id,name,version,regex,is_active AND nw.id IS NULL AS is_active,NULL AS evolved_from FROM v_pattern_versions v LEFT JOIN nw ON nw.id=v.id
UNION ALL SELECT schema_id||'::'||name||'::v'||(version+1),schema_id,name,version+1,nw.new_regex,true,v.id FROM v_pattern_versions v JOIN nw ON nw.id=v.id""", ["v_pattern_versions"])
def _(spark, d):
    versions = fx.view(spark, d, "v_pattern_versions")
    versions.createOrReplaceTempView("v_pattern_versions")
    return trust.evolve_patterns(versions, fx.sql(spark, d, _NEW))


_MATCHED = """SELECT 'o'||o_orderkey AS path,CASE WHEN o_custkey%10=0 THEN NULL ELSE (o_orderkey%12)/10.0 END AS score,CASE WHEN o_custkey%3=0 THEN NULL ELSE (o_custkey%11)/10.0 END AS trust,o_orderstatus='F' AS is_evolved FROM orders"""


@query("route_tier", f"SELECT path,CASE WHEN score IS NULL THEN 3 WHEN trust>=0.9 AND is_evolved AND score>=0.4 THEN 1 WHEN score>=0.5 AND trust<0.7 THEN 2 ELSE 1 END AS tier FROM ({_MATCHED})")
def _(spark, d):
    return trust.route_tier(fx.sql(spark, d, _MATCHED)).select("path", "tier")


@query("enhancement_candidates", """SELECT id,CASE WHEN conf_pct<60 THEN 'low_confidence' ELSE 'missing_property' END AS reason FROM v_nodes WHERE type<>'File' AND (conf_pct<60 OR type IN ('Function','Class','Model') OR (type='ApiEndpoint' AND (method IS NULL OR path IS NULL)))""", ["v_nodes"])
def _(spark, d):
    return trust.enhancement_candidates(fx.nodes(spark, d)).select("id", "reason")


@query("verification_sample", f"WITH {_TS} SELECT v.event_id AS id,v.schema_id,v.pattern_name FROM v_verifications v JOIN ts USING (schema_id,pattern_name) WHERE CAST(('0x'||substr(md5(CAST(v.event_id AS VARCHAR)),1,8)) AS BIGINT)/4294967296.0::DOUBLE<{_RATE}", V)
def _(spark, d):
    log = fx.view(spark, d, "v_verifications")
    return trust.verification_sample(log.select(F.col("event_id").alias("id"), "schema_id", "pattern_name"), trust.trust_scores(log))


@query("flat_sample", "SELECT event_id AS id,schema_id FROM v_verifications WHERE CAST(('0x'||substr(md5(CAST(event_id AS VARCHAR)),1,8)) AS BIGINT)/4294967296.0::DOUBLE<0.2", V)
def _(spark, d):
    return trust.flat_sample(fx.view(spark, d, "v_verifications").select(F.col("event_id").alias("id"), "schema_id"), 0.2)


_SUCC = "rejections=0 AND NOT (expected_nodes>0 AND n_nodes*10<expected_nodes*8) AND corrections*10<greatest(n_nodes,1)"
FR = ["v_file_results"]


@query("extraction_outcomes", f"SELECT language,count(*) AS n,count(*) FILTER ({_SUCC}) AS n_success,round(count(*) FILTER ({_SUCC})/count(*),6) AS success_rate FROM v_file_results GROUP BY 1", FR)
def _(spark, d):
    return trust.success_rates(fx.view(spark, d, "v_file_results")).withColumn("success_rate", F.round("success_rate", 6))


@query("tier_mix", "SELECT language,count(*) AS total,count(*) FILTER (tier=1) AS tier1,count(*) FILTER (tier=2) AS tier2,count(*) FILTER (tier=3) AS tier3,count(*) FILTER (tier=1)/count(*)>0.7 AS healthy FROM v_file_results GROUP BY 1", FR)
def _(spark, d):
    return trust.tier_mix(fx.view(spark, d, "v_file_results"))


@query("schema_health", f"SELECT schema_id,n,n_success,round(r,6) AS success_rate,CASE WHEN r>=0.8 THEN 'high' WHEN r>=0.6 THEN 'medium' ELSE 'low' END AS trust_level,r<0.7 AS needs_evolution FROM (SELECT schema_id,count(*) AS n,count(*) FILTER ({_SUCC}) AS n_success,count(*) FILTER ({_SUCC})/count(*) AS r FROM v_file_results GROUP BY 1)", FR)
def _(spark, d):
    return trust.schema_health(trust.success_rates(fx.view(spark, d, "v_file_results"), "schema_id")).withColumn(
        "success_rate", F.round("success_rate", 6))


@query("suggestion_counts", "WITH p AS (SELECT schema_id AS framework,language||tier AS pattern,count(*) AS n FROM v_file_results GROUP BY 1,2) SELECT framework,pattern,n,CAST((SELECT sum(n) FROM p q WHERE q.framework=p.framework) AS BIGINT) AS framework_total FROM p WHERE n>=3 AND (SELECT sum(n) FROM p q WHERE q.framework=p.framework)>=5", FR)
def _(spark, d):
    rows = fx.view(spark, d, "v_file_results").select(F.col("schema_id").alias("framework"), F.concat("language", F.col("tier").cast("string")).alias("pattern"))
    return trust.suggestion_counts(rows)


@query("discovery_cost", "SELECT count(*) FILTER (size<=50000) AS processable,count(*) FILTER (size>50000) AS skipped,round(sum(least(size/4,8000)+2000) FILTER (size<=50000),2)::DOUBLE AS tokens FROM v_file_results", FR)
def _(spark, d):
    return trust.discovery_cost(fx.view(spark, d, "v_file_results")).withColumn("tokens", F.round("tokens", 2))


@query("discovery_confidence", "SELECT f.file,round(least(1.0,COALESCE(avg(n.conf_pct/100.0),0)+CASE WHEN contains(f.file,'lib') THEN 0.08 ELSE 0 END),6)::DOUBLE AS confidence FROM (SELECT DISTINCT file FROM v_nodes UNION SELECT 'none.py') f LEFT JOIN v_nodes n ON n.file=f.file GROUP BY 1", ["v_nodes"])
def _(spark, d):
    nodes = fx.nodes(spark, d)
    files = nodes.select("file").distinct().unionByName(spark.range(1).select(F.lit("none.py").alias("file")))
    boosts = files.filter(F.col("file").contains("lib")).withColumn("boost", F.lit(0.8))
    return trust.discovery_confidence(files, nodes, boosts).withColumn("confidence", F.round("confidence", 6))
