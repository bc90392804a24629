"""Queries of retrieval: search, scoring, fusion, merging and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions import scoring as sc
from loamspark.functions import text as tx
from loamspark.functions import vectors as vf
from loamspark.operators import retrieval as op
from loamspark.plans.registry import query
from loamspark.plans.tables import MEMORIES, memories, read

TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
#: Vector searches ask with every vector whose id is divisible by 20, against all.
ASK = "vec_id % 20 = 0"

KEYWORD = f"""q AS (SELECT item_id AS query_id, {TOKENS.format("text")} AS t FROM benchmark),
qt AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM q),
dt AS (SELECT doc_id AS id, unnest({TOKENS.format("text")}) AS token FROM documents),
kw AS (SELECT query_id, id, count(*) AS hits, count(*)::double / any_value(n) AS score FROM dt JOIN qt USING (token) GROUP BY query_id, id),
kr AS (SELECT query_id, id, hits, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM kw QUALIFY rank <= 10)"""
COSINE = """cs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS q_label, v.label AS label, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)"""


def _keyword(spark, d) -> DataFrame:
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    scored = op.keyword_scores(queries, docs).withColumn("score", F.round("score", 6))
    return op.topk(scored, ["query_id"], [F.desc("score"), F.asc("id")], 10)


def _vectors(spark, d, asked: bool = False) -> DataFrame:
    v = read(spark, d, "embeddings")
    return (v.where(ASK) if asked else v).select(F.col("vec_id").alias("query_id" if asked else "id"), "embedding", F.col("label").alias("group"))


@query(
    "hybrid_rrf",
    f"""WITH {KEYWORD},
vec AS (SELECT b.item_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v),
vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vec QUALIFY rank <= 10),
f AS (SELECT query_id, id, round(sum(1.0::double / (60 + rank)), 9) AS rrf FROM (SELECT query_id, id, rank FROM kr UNION ALL SELECT * FROM vr) GROUP BY query_id, id)
SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM f QUALIFY rank <= 10""",
)
def hybrid_rrf(spark, d):
    """Keyword and vector top-10 of every benchmark item over all documents and vectors, fused by reciprocal ranks."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    asked = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding").join(items, "query_id", "left_semi")
    return op.reciprocal_rank_fusion([_keyword(spark, d), op.similar_topk(asked, _vectors(spark, d), 10)], limit=10)


@query("keyword_search_topk", f"WITH {KEYWORD} SELECT query_id, id, hits, score, rank FROM kr")
def keyword_search_topk(spark, d):
    return _keyword(spark, d)


@query(
    "memory_search_text",
    rf"""WITH {MEMORIES}, q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS t FROM benchmark),
m AS (SELECT id, user_id, confidence, unnest(list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> ''))) AS token FROM memories WHERE is_active AND confidence >= 0.5),
h AS (SELECT query_id, id, user_id, count(*) AS hits FROM m JOIN (SELECT query_id, unnest(t) AS token FROM q) USING (token) GROUP BY ALL)
SELECT query_id, id, user_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM h QUALIFY rank <= 5""",
)
def memory_search_text(spark, d):
    """Active memories of enough confidence by the number of shared words."""
    m = memories(spark, d).where(F.col("is_active") & (F.col("confidence") >= 0.5))
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = op.keyword_scores(queries, m.select("id", F.col("content").alias("text")), tx.words)
    best = op.topk(hits, ["query_id"], [F.desc("hits"), F.asc("id")], 5)
    return best.join(m.select("id", "user_id"), "id").select("query_id", "id", "user_id", "hits", "rank")


@query("cosine_topk", f"WITH {COSINE} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 10")
def cosine_topk(spark, d):
    return op.similar_topk(_vectors(spark, d, True), _vectors(spark, d), 10)


@query("cosine_filtered_topk", f"WITH {COSINE} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs WHERE label = q_label AND score >= 0.1 QUALIFY rank <= 10")
def cosine_filtered_topk(spark, d):
    return op.similar_topk(_vectors(spark, d, True), _vectors(spark, d), 10, least=0.1, same_group=True)


@query("vector_query_by_id", f"WITH {COSINE} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs WHERE id <> query_id QUALIFY rank <= 5")
def vector_query_by_id(spark, d):
    return op.similar_topk(_vectors(spark, d, True), _vectors(spark, d), 5, drop_self=True)


@query(
    "dot_topk",
    """SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_inner_product(q.embedding::double[], v.embedding::double[]), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::double[], v.embedding::double[]), 6) DESC, v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10""",
)
def dot_topk(spark, d):
    return op.similar_topk(_vectors(spark, d, True), _vectors(spark, d), 10, "dot")


@query(
    "l2_topk",
    """SELECT q.vec_id AS query_id, v.vec_id AS id, round(1 / (1 + round(list_distance(q.embedding::double[], v.embedding::double[]), 6)), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::double[], v.embedding::double[]), 6), v.vec_id) AS rank
FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 10""",
)
def l2_topk(spark, d):
    found = op.similar_topk(_vectors(spark, d, True), _vectors(spark, d), 10, "l2", drop_self=True)
    return found.withColumn("score", F.round(1 / (1 - F.col("score")), 6))


@query("vector_namespace_count", "SELECT label AS namespace, count(*) AS n, count(DISTINCT len(embedding)) AS dimensions FROM embeddings GROUP BY label")
def vector_namespace_count(spark, d):
    return read(spark, d, "embeddings").groupBy(F.col("label").alias("namespace")).agg(F.count("*").alias("n"), F.countDistinct(F.size("embedding")).alias("dimensions"))


@query(
    "vector_norms",
    """SELECT vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) AS norm, round(list_sum(list_transform(embedding::double[], lambda x: x)), 6) AS total FROM embeddings""",
)
def vector_norms(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vf.norm("embedding"), 6).alias("norm"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


STAMPED = """st AS (SELECT v.vec_id AS id, v.embedding, v.label, e.ts, e.value, (SELECT max(ts) FROM events) AS as_of FROM embeddings v JOIN events e ON e.event_id = v.vec_id),
pr AS (SELECT q.id AS query_id, v.id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS sim, v.ts, v.as_of, v.value, v.label
  FROM st q JOIN st v ON q.label = v.label WHERE q.id % 20 = 0 AND q.id <> v.id)"""
AGE = "(epoch_us(as_of) - epoch_us(ts)) / 86400000000.0::double"


def _stamped_pairs(spark, d) -> DataFrame:
    """Vectors of one label with their event's time: each asked one against the others of its label."""
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").join(e, "id")
    v = v.withColumn("norm", vf.norm("embedding"))
    as_of = read(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("as_of"))
    q = v.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("q_norm"), "label")
    pairs = v.join(q, "label").where("id != query_id").withColumn("sim", vf.cosine("q", "embedding", F.col("q_norm"), F.col("norm")))
    return pairs.crossJoin(F.broadcast(as_of)).drop("q", "embedding")  # as_of is one row


def _scored(spark, d, score) -> DataFrame:
    found = _stamped_pairs(spark, d).withColumn("score", F.round(score, 6)).select("query_id", "id", "score")
    return op.topk(found, ["query_id"], [F.desc("score"), F.asc("id")], 5)


RANKED = "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5"


@query("temporal_topk", f"WITH {STAMPED}, s AS (SELECT query_id, id, round(greatest(0, least(1, 0.7 * sim + 0.3 * greatest(0, least(1, exp(-ln(2) / 7 * ({AGE})))))), 6) AS score FROM pr) {RANKED}")
def temporal_topk(spark, d):
    """0.7 similarity and 0.3 recency of a seven-day half-life."""
    return _scored(spark, d, sc.blend(F.col("sim"), sc.recency("ts", "as_of")))


@query("salience_topk", f"WITH {STAMPED}, s AS (SELECT query_id, id, round(sim * ln(floor(value) + 1) * exp(-0.693 * ({AGE}) / 30), 6) AS score FROM pr) {RANKED}")
def salience_topk(spark, d):
    """Similarity, log accesses (the event's value) and decay since the last one."""
    return _scored(spark, d, sc.salience(F.col("sim"), F.floor("value"), F.col("ts"), F.col("as_of")))


@query(
    "recency_rerank",
    f"WITH {STAMPED}, s AS (SELECT query_id, id, round(greatest(0, least(1, sim + greatest(0, 0.2 * (1 - ({AGE}) / 30)))), 6) AS score FROM pr WHERE sim >= 0.1) {RANKED}",
)
def recency_rerank(spark, d):
    pairs = _stamped_pairs(spark, d).where("sim >= 0.1").withColumn("score", F.col("sim"))
    return op.rerank(pairs.select("query_id", "id", "score", "ts", "as_of"), sc.recency_boost("ts", "as_of"), 5).select("query_id", "id", "score", "rank")


@query(
    "hybrid_topk",
    f"""WITH {KEYWORD}, s AS (SELECT k.query_id, k.id, round(greatest(0, least(1, 0.7 * list_cosine_similarity(q.embedding::double[], v.embedding::double[]) + 0.3 * k.score)), 6) AS score
FROM kw k JOIN embeddings q ON q.vec_id = k.query_id JOIN embeddings v ON v.vec_id = k.id) {RANKED}""",
)
def hybrid_topk(spark, d):
    """0.7 vector and 0.3 keyword score where both exist."""
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    v = read(spark, d, "embeddings").select("vec_id", "embedding").withColumn("norm", vf.norm("embedding"))
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("q_norm"))
    both = op.keyword_scores(queries, docs.join(v.select(F.col("vec_id").alias("id")), "id", "left_semi")).join(q, "query_id").join(v.withColumnRenamed("vec_id", "id"), "id")
    score = F.round(sc.blend(vf.cosine("q", "embedding", F.col("q_norm"), F.col("norm")), F.col("score")), 6)
    return op.topk(both.select("query_id", "id", score.alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], 5)


MERGED = f"""WITH q AS (SELECT item_id AS query_id, {TOKENS.format("text")} AS t FROM benchmark),
qt AS (SELECT query_id, len(t) AS n, unnest(t) AS token FROM q),
src AS (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, url FROM pages UNION ALL SELECT 'turns', conv_id * 1000 + turn, text FROM conversations),
tk AS (SELECT source, id, unnest({TOKENS.format("text")}) AS token FROM src),
kw AS (SELECT query_id, source, id, round(count(*)::double / any_value(n), 6) AS score FROM tk JOIN qt USING (token) GROUP BY query_id, source, id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS r FROM kw QUALIFY r <= 5)"""


def _sources(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    pages = read(spark, d, "pages").select(F.lit("pages"), "page_id", "url")
    turns = read(spark, d, "conversations").select(F.lit("turns"), F.col("conv_id") * 1000 + F.col("turn"), "text")
    every = docs.union(pages).union(turns).select(F.struct("source", "id").alias("id"), "text")
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = op.keyword_scores(queries, every).select("query_id", F.col("id.source").alias("source"), F.col("id.id").alias("id"), F.round("score", 6).alias("score"))
    return op.topk(found, ["query_id", "source"], [F.desc("score"), F.asc("id")], 5, "r").drop("r")


@query("interleave_merge", MERGED + " SELECT query_id, source, id, score, row_number() OVER (PARTITION BY query_id ORDER BY r, source) AS position FROM top")
def interleave_merge(spark, d):
    return op.merge_sources(_sources(spark, d), "interleave")


@query("source_first_merge", MERGED + " SELECT query_id, source, id, score, row_number() OVER (PARTITION BY query_id ORDER BY source, r) AS position FROM top")
def source_first_merge(spark, d):
    return op.merge_sources(_sources(spark, d), "source_first")


@query("score_only_merge", MERGED + " SELECT query_id, source, id, score * CASE source WHEN 'pages' THEN 0.5::double ELSE 1 END AS score, row_number() OVER (PARTITION BY query_id ORDER BY score * CASE source WHEN 'pages' THEN 0.5::double ELSE 1 END DESC, source, id) AS position FROM top")
def score_only_merge(spark, d):
    return op.merge_sources(_sources(spark, d), "score_only", {"pages": 0.5})


@query(
    "global_user_merge",
    f"""WITH {COSINE}, o AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM cs WHERE label = q_label QUALIFY r <= 5),
g AS (SELECT query_id, id, score * 0.8 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM cs QUALIFY r <= 5),
u AS (SELECT *, 0 AS p FROM o UNION ALL SELECT *, 1 FROM g)
SELECT query_id, id, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY p) = 1""",
)
def global_user_merge(spark, d):
    """Results of the query's own label, and the best of all at 0.8 of their score."""
    asked, every = _vectors(spark, d, True), _vectors(spark, d)
    own = op.similar_topk(asked, every, 5, same_group=True).drop("rank")
    return op.prefer_own(own, op.similar_topk(asked, every, 5).drop("rank")).withColumn("score", F.round("score", 6))


@query("novelty_mask", f"WITH {COSINE}, r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 10) SELECT query_id, id, score, rank FROM r WHERE NOT EXISTS (SELECT 1 FROM (SELECT query_id, id FROM r WHERE rank <= 3) s WHERE s.query_id = r.query_id AND s.id = r.id)")
def novelty_mask(spark, d):
    """Top-10 without what the first step (top-3) has returned."""
    found = op.similar_topk(_vectors(spark, d, True), _vectors(spark, d), 10)
    return op.mask_seen(found, found.where("rank <= 3").select("query_id", "id"))


@query(
    "rank_limit_nodes",
    f"""WITH {KEYWORD}, t AS (SELECT query_id, id, 10 * hits AS score, row_number() OVER (PARTITION BY query_id ORDER BY 10 * hits DESC, id) AS rank FROM kw QUALIFY rank <= 25)
SELECT query_id, id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM t) WHERE score >= top * 0.8 OR rank <= 8""",
)
def rank_limit_nodes(spark, d):
    """Nodes scored 10 a shared word, those near the best, between 8 and 25."""
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    scored = op.keyword_scores(queries, docs).select("query_id", "id", (F.col("hits") * 10).alias("score"))
    return op.limit_by_share(scored, share=0.8)


@query("headline_index", f"WITH {KEYWORD} SELECT k.query_id, k.id, k.rank, CASE WHEN k.rank <= 3 THEN d.text WHEN length(d.text) > 80 THEN substring(d.text, 1, 77) || '...' ELSE d.text END AS line FROM kr k JOIN documents d ON d.doc_id = k.id")
def headline_index(spark, d):
    """The first three hits in full, the others by headline."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return _keyword(spark, d).join(docs, "id").select("query_id", "id", "rank", F.when(F.col("rank") <= 3, F.col("text")).otherwise(tx.headline("text")).alias("line"))


@query("mmr_diversity")
def mmr_diversity(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return op.diversify(_keyword(spark, d).join(docs, "id").select("query_id", "id", "score", "content"), 5)
