"""Queries of skills, merged memories, evolving preferences, spans and adjacent events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.functions import scoring as sc
from loamspark.functions import skills as sk
from loamspark.plans.registry import query
from loamspark.plans.tables import ASKED, asked, read

CATALOG = {"billing": "the price of", "review": "look again", "search": "find the", "summary": "in short"}
_SCORES = ", ".join(
    f"""struct_pack(score := round(CASE WHEN contains(low, '{t}') THEN least(0.9, 0.6 + 0.3 * {len(t)} / length(low))
  WHEN len(list_intersect(words, {sorted(set(t.split()))})) / {len(set(t.split()))} >= 0.5 THEN 0.5 + 0.2 * (len(list_intersect(words, {sorted(set(t.split()))})) / {len(set(t.split()))}) ELSE 0 END, 6), skill := '{s}')"""
    for s, t in CATALOG.items()
)


@query("skill_trigger_score", f"""WITH q AS (SELECT conv_id, turn, lower(text) AS low, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS words FROM conversations WHERE role = 'user' AND text <> ''),
  b AS (SELECT conv_id, turn, list_max([{_SCORES}]) AS best FROM q) SELECT conv_id, turn, best.skill AS skill, best.score AS score FROM b WHERE best.score > 0""")
def skill_trigger_score(spark, d):
    turns = read(spark, d, "conversations").where("role = 'user' AND text <> ''")
    return turns.select("conv_id", "turn", sk.best_trigger(F.col("text"), CATALOG).alias("b")).where("b.score > 0").select("conv_id", "turn", "b.skill", "b.score")


@query("trigger_confidence", "SELECT p_partkey, CASE WHEN lower(p_type) = 'brass' THEN 1.0 WHEN starts_with(lower(p_type), 'brass') OR ends_with(lower(p_type), 'brass') THEN 0.9 ELSE 0.7 END::double AS confidence FROM part")
def trigger_confidence(spark, d):
    return read(spark, d, "part").select("p_partkey", sk.trigger_confidence(F.col("p_type"), F.lit("brass")).alias("confidence"))


@query("skill_evaluation_score", "SELECT p_partkey, round(" + " + ".join(f"list_extract([1.0, 0.5, 0.0], (1 + (p_size + {i}) % 3)::bigint)::double * {w}::double" for i, w in enumerate(sk.WEIGHTS)) + ", 4) AS score FROM part")
def skill_evaluation_score(spark, d):
    """Parts as skills, graded in five dimensions by their size."""
    grade = lambda i: F.element_at(F.array(*[F.lit(g) for g in sk.GRADES]), ((F.col("p_size") + i) % 3 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", sk.evaluation_score(*[grade(i) for i in range(5)]).alias("score"))


@query("skill_lint", """WITH s AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(lower(p_brand), '#', '-') ELSE p_brand END AS name, p_name AS description FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN NOT regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)*$') THEN 'name-format' END, CASE WHEN trim(description) = '' THEN 'no-description' END, CASE WHEN length(description) < 20 THEN 'short-description' END) AS findings FROM s""")
def skill_lint(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))).otherwise(F.col("p_brand"))
    return read(spark, d, "part").select("p_partkey", F.array_join(sk.lint(name, F.col("p_name")), ",").alias("findings"))


@query("skill_relationships", """WITH r AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem)
SELECT DISTINCT skill, other FROM (SELECT a AS skill, b AS other FROM r UNION ALL SELECT b, a FROM r) WHERE other NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def skill_relationships(spark, d):
    """The other end of every relation, from either side, unless it is active."""
    r = read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    ends = r.select(F.explode(F.array(F.struct(F.col("a").alias("skill"), F.col("b").alias("other")), F.struct(F.col("b").alias("skill"), F.col("a").alias("other")))).alias("e")).select("e.*")
    active = read(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("other"))
    return ends.distinct().join(active, "other", "left_anti").select("skill", "other")


@query("merged_memories", """SELECT o_custkey AS key, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS base, string_agg(DISTINCT lower(o_orderpriority), ',' ORDER BY lower(o_orderpriority)) AS tags, count(*) AS accesses FROM orders GROUP BY o_custkey""")
def merged_memories(spark, d):
    """Orders of one customer as one memory: the base is the most confident, tags are united, accesses added."""
    tags = F.array_join(F.array_sort(F.collect_set(F.lower("o_orderpriority"))), ",").alias("tags")
    base = F.max(F.struct("o_totalprice", "o_orderkey"))["o_orderkey"].alias("base")
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(base, tags, F.count("*").alias("accesses"))


@query("preference_history", """SELECT o_custkey AS key, o_orderkey AS id, row_number() OVER w AS version, lead(o_orderkey) OVER w AS superseded_by, round(power(0.9, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER w), 6) AS importance
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def preference_history(spark, d):
    """Every version of a preference, what superseded it, and its importance after that many decays."""
    o, w = read(spark, d, "orders"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    version = F.row_number().over(w)
    decayed = F.round(F.pow(F.lit(0.9), F.count("*").over(Window.partitionBy("o_custkey")) - version), 6)
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), version.cast("long").alias("version"), F.lead("o_orderkey").over(w).alias("superseded_by"), decayed.alias("importance"))


@query("contradicted_edges", """SELECT l_orderkey, l_linenumber, l_suppkey AS source, l_partkey AS target, l_shipdate AS valid_at, lead(l_shipdate) OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS invalid_at FROM lineitem""")
def contradicted_edges(spark, d):
    """An edge is valid until the next one of its type and ends begins."""
    w = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_shipdate").alias("valid_at"), F.lead("l_shipdate").over(w).alias("invalid_at"))


@query("span_overlaps", """WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS id, date_diff('day', DATE '1990-01-01', l_shipdate::date) AS a, date_diff('day', DATE '1990-01-01', l_shipdate::date) + l_quantity::int AS b FROM lineitem)
SELECT x.doc, x.id AS first_id, y.id AS second_id, least(x.b, y.b) - greatest(x.a, y.a) AS shared FROM s x JOIN s y ON x.doc = y.doc AND x.id < y.id AND x.a < y.b AND y.a < x.b""")
def span_overlaps(spark, d):
    """Pairs of half-open spans of one document that overlap; the document is the join key, so only its own spans meet."""
    a = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    s = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), a.alias("a"), (a + F.col("l_quantity").cast("int")).alias("b"))
    x, y = s.alias("x"), s.alias("y")
    met = x.join(y, (F.col("x.doc") == F.col("y.doc")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b")))
    return met.select("x.doc", F.col("x.id").alias("first_id"), F.col("y.id").alias("second_id"), (F.least("x.b", "y.b") - F.greatest("x.a", "y.a")).alias("shared"))


@query("adjacent_events", """SELECT user_id, event_id, lead(event_id) OVER w AS next_id, date_diff('microsecond', ts, lead(ts) OVER w) AS gap_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lead(event_id) OVER w IS NOT NULL""")
def adjacent_events(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', {c})")
    e = read(spark, d, "events").select("user_id", "event_id", F.lead("event_id").over(w).alias("next_id"), (F.lead(us("ts")).over(w) - us("ts")).alias("gap_us"))
    return e.where("next_id IS NOT NULL")


@query("effectiveness_boost", """WITH s AS (SELECT source, lang, sum(quality) AS h, sum(toxic) AS b FROM documents JOIN labels USING (doc_id) GROUP BY source, lang)
SELECT source, lang, CASE WHEN h + b >= 3 THEN round(greatest(-0.3, least(0.3, 0.1 * (h - 2 * b) / (h + b + 1))), 6) ELSE 0 END::double AS boost FROM s""")
def effectiveness_boost(spark, d):
    s = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").groupBy("source", "lang").agg(F.sum("quality").alias("h"), F.sum("toxic").alias("b"))
    return s.select("source", "lang", F.round(sc.effectiveness_boost(F.col("h"), F.col("b")), 6).alias("boost"))


@query("section_stats", """SELECT lang AS section, count(*) AS items, sum(quality)::bigint AS helpful, sum(toxic)::bigint AS harmful, round(CASE WHEN sum(quality) + sum(toxic) = 0 THEN 0.5 ELSE sum(quality) / (sum(quality) + sum(toxic)) END, 6) AS effectiveness
FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def section_stats(spark, d):
    s = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy(F.col("lang").alias("section"))
    s = s.agg(F.count("*").alias("items"), F.sum("quality").alias("helpful"), F.sum("toxic").alias("harmful"))
    used = F.col("helpful") + F.col("harmful")
    return s.withColumn("effectiveness", F.round(F.when(used == 0, 0.5).otherwise(F.try_divide("helpful", used)), 6))


@query("sentence_counts", "SELECT doc_id, len(regexp_extract_all(text, '[.!?][ \\t\\n\\r]+')) + 1 AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark, d):
    return read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(F.split("text", r"(?<=[.!?])[ \t\n\r]+")).cast("long").alias("sentences"))


@query("search_directive", f"""WITH {ASKED} SELECT conv_id, turn FROM asked WHERE role = 'user' AND regexp_matches(lower(text), '\\?|^(who|what|when|where|why|how|which)\\b') AND NOT regexp_matches(lower(text), '^(hi|hello|hey|thanks|thank you)\\b')""")
def search_directive(spark, d):
    """User turns that ask something and are no greeting."""
    low = F.lower("text")
    asks = F.rlike(low, F.lit(r"\?|^(who|what|when|where|why|how|which)\b")) & ~F.rlike(low, F.lit(r"^(hi|hello|hey|thanks|thank you)\b"))
    return asked(spark, d).where((F.col("role") == "user") & asks).select("conv_id", "turn")
