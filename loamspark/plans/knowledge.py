"""Queries of layered knowledge, effectiveness, snapshots, consolidation and categories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.functions import scoring as sc
from loamspark.functions import text as tx
from loamspark.operators import knowledge as op
from loamspark.plans.registry import query
from loamspark.plans.tables import read

SCOPED = """m AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment || '-' || (c_custkey % 200) AS key,
  CASE c_nationkey % 3 WHEN 2 THEN 'session' WHEN 1 THEN 'project' ELSE 'global' END AS scope, c_nationkey AS priority FROM customer)"""
SCOPE_RANK = "CASE scope WHEN 'session' THEN 2 WHEN 'project' THEN 1 ELSE 0 END"


def _scoped(spark, d):
    n = F.col("c_nationkey")
    scope = F.when(n % 3 == 2, "session").when(n % 3 == 1, "project").otherwise("global")
    key = F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 200).cast("string"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), key.alias("key"), scope.alias("scope"), n.alias("priority"))


def _rank():
    return F.when(F.col("scope") == "session", 2).when(F.col("scope") == "project", 1).otherwise(0)


@query("scoped_override", f"WITH {SCOPED} SELECT key, id, scope, priority FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY {SCOPE_RANK} DESC, priority DESC, id) = 1")
def scoped_override(spark, d):
    return op.override(_scoped(spark, d), ["key"], [F.desc(_rank()), F.desc("priority"), F.asc("id")]).select("key", "id", "scope", "priority")


@query("scope_counts", f"WITH {SCOPED}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {SCOPE_RANK} DESC, priority DESC, id) AS n FROM m) SELECT scope, count(*) AS n, count(*) FILTER (n > 1) AS overridden FROM r GROUP BY scope")
def scope_counts(spark, d):
    w = Window.partitionBy("key").orderBy(F.desc(_rank()), F.desc("priority"), F.asc("id"))
    return _scoped(spark, d).withColumn("r", F.row_number().over(w)).groupBy("scope").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r") > 1, 1).otherwise(0)).alias("overridden"))


@query("grouped_prompt", f"WITH {SCOPED} SELECT scope, priority, id, '- ' || name AS line FROM m")
def grouped_prompt(spark, d):
    """One line for each member of a scope, with what orders it; no scope is gathered into one row."""
    return _scoped(spark, d).select("scope", "priority", "id", F.concat(F.lit("- "), "name").alias("line"))


@query("skill_layering", "SELECT p_brand || ' ' || p_type AS name, p_partkey AS id, p_size % 3 AS layer FROM part QUALIFY row_number() OVER (PARTITION BY p_brand || ' ' || p_type ORDER BY p_size % 3 DESC, p_partkey) = 1")
def skill_layering(spark, d):
    """Parts as skills by name: project over user over base."""
    rows = read(spark, d, "part").select(F.concat("p_brand", F.lit(" "), "p_type").alias("name"), F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("layer"))
    return op.override(rows, ["name"], [F.desc("layer"), F.asc("id")])


@query("keyed_upsert", "SELECT o_custkey AS key, o_orderkey AS version, o_orderstatus AS state FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def keyed_upsert(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("state"))
    return op.merge_keyed(o.where("state = 'O'"), o.where("state <> 'O'"), ["key"], "version")


@query("snapshot_diff", """WITH o AS (SELECT p_partkey, p_name FROM part WHERE p_size < 30), n AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN p_name || ' v2' ELSE p_name END AS p_name FROM part WHERE p_size > 10)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.p_name <> n.p_name THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.p_partkey = n.p_partkey""")
def snapshot_diff(spark, d):
    p = read(spark, d, "part")
    name = F.when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit(" v2"))).otherwise(F.col("p_name"))
    return op.snapshot_diff(p.where("p_size < 30"), p.where("p_size > 10").withColumn("p_name", name), "p_partkey", "p_name")


ITEMS = "it AS (SELECT d.source AS id, d.lang AS section, sum(l.quality) AS helpful, sum(l.toxic) AS harmful FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL)"


def _items(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return rows.groupBy(F.col("source").alias("id"), F.col("lang").alias("section")).agg(F.sum("quality").alias("helpful"), F.sum("toxic").alias("harmful"))


@query("expertise_effectiveness", f"WITH {ITEMS} SELECT id, section, round(CASE WHEN helpful + harmful > 0 THEN helpful / (helpful + harmful) ELSE 0.5 END::double, 6) AS effectiveness, helpful > 5 AND harmful < 2 AS high, harmful >= helpful AND harmful > 0 AS problematic, round(CASE WHEN helpful + harmful >= 3 THEN greatest(-0.3, least(0.3, 0.1 * (helpful - 2 * harmful) / (helpful + harmful + 1))) ELSE 0 END::double, 6) AS boost FROM it")
def expertise_effectiveness(spark, d):
    h, x = F.col("helpful"), F.col("harmful")
    return _items(spark, d).select("id", "section", F.round(sc.effectiveness(h, x), 6).alias("effectiveness"), ((h > 5) & (x < 2)).alias("high"), ((x >= h) & (x > 0)).alias("problematic"), F.round(sc.effectiveness_boost(h, x), 6).alias("boost"))


@query("quality_report", f"""WITH {ITEMS}, e AS (SELECT *, CASE WHEN helpful + harmful > 0 THEN helpful / (helpful + harmful) ELSE 0.5 END AS e FROM it),
r AS (SELECT section, count(*) AS n_items, sum(helpful)::bigint AS helpful, sum(harmful)::bigint AS harmful, round(coalesce(sum(helpful) / nullif(sum(helpful + harmful), 0), 0.5)::double, 6) AS effectiveness,
count(*) FILTER (e >= 0.8 AND helpful + harmful > 0) AS high, count(*) FILTER (e < 0.4 AND helpful + harmful >= 3) AS problematic, count(*) FILTER (helpful + harmful = 0) AS unused FROM e GROUP BY section)
SELECT *, round(coalesce(high / nullif(high + problematic, 0), 0.5)::double, 6) AS health FROM r""")
def quality_report(spark, d):
    return op.quality_report(_items(spark, d), "section")


@query("suggest_removals", f"WITH {ITEMS}, p AS (SELECT id, section, CASE WHEN helpful + harmful > 0 AND helpful / (helpful + harmful) < 0.3 THEN 3 WHEN harmful >= helpful AND harmful > 0 THEN 2 WHEN helpful + harmful = 0 THEN 1 END AS priority FROM it) SELECT * FROM p WHERE priority IS NOT NULL")
def suggest_removals(spark, d):
    return op.suggest_removals(_items(spark, d)).select("id", "section", "priority")


@query("effectiveness_trend", f"WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY id) AS n FROM it WHERE helpful + harmful > 0) SELECT section, round(avg(helpful / (helpful + harmful)) FILTER (n <= 10), 6) AS recent, round(avg(helpful / (helpful + harmful)) FILTER (n > 10), 6) AS earlier FROM n GROUP BY section")
def effectiveness_trend(spark, d):
    rows = _items(spark, d).where("helpful + harmful > 0").withColumn("n", F.row_number().over(Window.partitionBy("section").orderBy("id")))
    e = F.col("helpful") / (F.col("helpful") + F.col("harmful"))
    return rows.groupBy("section").agg(F.round(F.avg(F.when(F.col("n") <= 10, e)), 6).alias("recent"), F.round(F.avg(F.when(F.col("n") > 10, e)), 6).alias("earlier"))


@query("usage_stats", "SELECT d.source, count(*) AS uses, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.quality = 0 AND l.toxic = 0) AS neutral, count(*) FILTER (l.toxic = 1) AS bad, count(DISTINCT d.lang) AS langs FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def usage_stats(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    count = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
    return rows.groupBy("source").agg(F.count("*").alias("uses"), count("quality = 1").alias("good"), count("quality = 0 and toxic = 0").alias("neutral"), count("toxic = 1").alias("bad"), F.countDistinct("lang").alias("langs"))


@query("skill_effectiveness", "SELECT event_type AS skill, count(*) AS usage, round(avg(value), 4) AS confidence, round(count(*) FILTER (value >= 5) / nullif(count(*) FILTER (value >= 5 OR value < 2), 0), 4) AS success_rate, count(DISTINCT user_id) AS sessions FROM events GROUP BY event_type")
def skill_effectiveness(spark, d):
    good = F.sum(F.when(F.col("value") >= 5, 1).otherwise(0))
    decided = F.sum(F.when((F.col("value") >= 5) | (F.col("value") < 2), 1).otherwise(0))
    return read(spark, d, "events").groupBy(F.col("event_type").alias("skill")).agg(F.count("*").alias("usage"), F.round(F.avg("value"), 4).alias("confidence"), F.round(good / F.nullif(decided, F.lit(0)), 4).alias("success_rate"), F.countDistinct("user_id").alias("sessions"))


@query("evaluation_accuracy", "SELECT d.lang, round(avg(l.quality), 6) AS before, round(avg(greatest(l.quality, 1 - l.toxic)), 6) AS after, count(*) FILTER (l.quality = 0 AND l.toxic = 0) AS improved FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def evaluation_accuracy(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("before"), F.round(F.avg(F.greatest(F.col("quality"), 1 - F.col("toxic"))), 6).alias("after"), F.sum(F.when(F.expr("quality = 0 and toxic = 0"), 1).otherwise(0)).alias("improved"))


HASH = r"left(sha256(lang || ':' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 16)"


@query("content_hash_dups", f"SELECT {HASH} AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    rows = read(spark, d, "documents").groupBy(tx.content_hash("text", F.col("lang")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return rows.where("n > 1")


@query("exact_dedup", r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(lower(text))")
def exact_dedup(spark, d):
    return read(spark, d, "documents").groupBy(F.xxhash64(F.trim(F.lower("text"))).alias("h"), F.sha2(F.trim(F.lower("text")), 256).alias("s")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("known_hashes", f"SELECT doc_id FROM documents n WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM (SELECT {HASH} AS h FROM documents WHERE doc_id % 2 = 0) o WHERE o.h = {HASH.replace('lang', 'n.lang').replace('lower(text)', 'lower(n.text)')})")
def known_hashes(spark, d):
    """New documents (odd ids) whose content the stored ones (even ids) lack."""
    rows = read(spark, d, "documents").select("doc_id", tx.content_hash("text", F.col("lang")).alias("h"))
    return rows.where("doc_id % 2 = 1").join(rows.where("doc_id % 2 = 0"), "h", "left_anti").select("doc_id")


@query("similarity_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) >= 0.3")
def similarity_pairs(spark, d):
    return op.similar_pairs(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("group")), 0.3)


@query("category_centroid", "SELECT label AS \"group\", list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, round(avg(x::double), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label")
def category_centroid(spark, d):
    return op.centroids(read(spark, d, "embeddings").select("embedding", F.col("label").alias("group")))


@query("category_assign", """WITH c AS (SELECT label, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, round(avg(x::double), 6) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)
SELECT v.vec_id AS id, c.label AS "group", round(list_cosine_similarity(v.embedding::double[], c.centroid), 6) AS similarity FROM embeddings v, c WHERE round(list_cosine_similarity(v.embedding::double[], c.centroid), 6) >= 0.3""")
def category_assign(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("group"))
    return op.assign_categories(v.select("id", "embedding"), op.centroids(v), 0.3)


@query("decay_prune", "WITH m AS (SELECT event_id AS id, value / 100 AS importance, ts, (SELECT max(ts) FROM events) AS as_of FROM events), v AS (SELECT id, (epoch_us(as_of) - epoch_us(ts)) / 86400000000.0 > 7 AS old, importance FROM m), x AS (SELECT id, old, round(CASE WHEN old THEN importance * 0.95 ELSE importance END::double, 6) AS importance FROM v) SELECT id, importance, CASE WHEN importance < 0.1 THEN 'pruned' WHEN old THEN 'decayed' ELSE 'kept' END AS state FROM x")
def decay_prune(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("importance"), F.col("ts").cast("timestamp").alias("ts"))
    as_of = F.broadcast(e.agg(F.max("ts").alias("as_of")))  # one row
    return op.consolidate(e.crossJoin(as_of), F.col("as_of"), after_days=7).select("id", "importance", "state")


@query("dedup_greedy")
def dedup_greedy(spark, d):
    return op.greedy_groups(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("group")), 0.3)


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    c, s = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read(spark, d, "supplier").select("s_nationkey")
    return c.intersect(s).exceptAll(read(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey")).distinct()
