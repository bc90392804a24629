"""Queries of life cycles, names, time bounds and small measures: one plan and its SQL each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.plans.registry import query
from loamspark.plans.tables import read

MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
STOP_WORDS = ("the", "and", "for", "that", "with", "this", "are", "was", "you", "not")


@query("levenshtein_similarity", "SELECT p_partkey AS id, round(1 - levenshtein(lower(p_name), lower(p_type))::double / greatest(length(p_name), length(p_type), 1), 6) AS similarity FROM part")
def levenshtein_similarity(spark, d):
    """One less the edits between two texts over the length of the longer."""
    edits = F.levenshtein(F.lower("p_name"), F.lower("p_type")) / F.greatest(F.length("p_name"), F.length("p_type"), F.lit(1))
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(1 - edits, 6).alias("similarity"))


@query("skill_promotion", """SELECT l_suppkey AS skill, count(*) AS uses, round(avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END), 6)::double AS success,
CASE WHEN count(*) >= 10 AND avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) >= 0.75 THEN 'graduate' WHEN count(*) >= 10 AND avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) < 0.65 THEN 'retire' ELSE 'keep' END AS decision FROM lineitem GROUP BY l_suppkey""")
def skill_promotion(spark, d):
    """Skills used often enough graduate to a wider scope if they succeed, and retire if they do not."""
    s = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("skill")).agg(F.count("*").alias("uses"), F.avg(F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0)).alias("rate"))
    often = F.col("uses") >= 10
    decision = F.when(often & (F.col("rate") >= 0.75), "graduate").when(often & (F.col("rate") < 0.65), "retire").otherwise("keep")
    return s.select("skill", "uses", F.round("rate", 6).alias("success"), decision.alias("decision"))


@query("skill_graduation", "SELECT p_partkey AS id, p_name AS name, 'base' AS scope, NULL::varchar AS graduated_from, NULL::bigint AS origin FROM part UNION ALL SELECT -p_partkey, p_name, 'user', 'base', p_partkey FROM part WHERE p_size >= 40")
def skill_graduation(spark, d):
    """Skills, and copies of the graduated ones in the wider scope with where they come from."""
    p = read(spark, d, "part")
    base = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("base").alias("scope"), F.lit(None).cast("string").alias("graduated_from"), F.lit(None).cast("long").alias("origin"))
    return base.unionByName(p.where("p_size >= 40").select((-F.col("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.lit("user").alias("scope"), F.lit("base").alias("graduated_from"), F.col("p_partkey").alias("origin")))


@query("node_names", "SELECT o_orderkey AS edge, coalesce(c_name, 'customer:' || o_custkey) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey")
def node_names(spark, d):
    """The name of each edge's node; a node that is missing goes by its id."""
    c = read(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_name")
    rows = read(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("o_orderkey").alias("edge"), F.coalesce("c_name", F.concat(F.lit("customer:"), F.col("o_custkey").cast("string"))).alias("name"))


@query("minimal_context", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def minimal_context(spark, d):
    """The last five events of every session."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(last)).where("n <= 5").drop("n")


BOUNDS = {"last_hour": "INTERVAL 1 HOUR", "last_24h": "INTERVAL 24 HOUR", "last_7d": "INTERVAL 7 DAY"}


@query("time_bounds", "WITH r AS (SELECT max(ts) AS latest FROM events), b AS (" + " UNION ALL ".join(f"SELECT '{k}' AS bound, latest - {v} AS begins, latest AS ends FROM r" for k, v in BOUNDS.items()) + " UNION ALL SELECT 'today', date_trunc('day', latest)::timestamp, latest FROM r) SELECT bound, begins, ends, count(event_id) AS events FROM b LEFT JOIN events ON ts BETWEEN begins AND ends GROUP BY ALL")
def time_bounds(spark, d):
    """The named spans of time before the latest event, and how many events lie in each; all in one pass."""
    e = read(spark, d, "events")
    at = e.agg(F.max("ts").alias("at"))
    begins = [F.struct(F.lit(k).alias("bound"), (F.col("at") - F.expr(v)).alias("begins")) for k, v in BOUNDS.items()]
    day = F.struct(F.lit("today").alias("bound"), F.date_trunc("day", "at").cast("timestamp_ntz").alias("begins"))
    bounds = at.select("at", F.explode(F.array(*begins, day)).alias("b")).select("b.bound", "b.begins", F.col("at").alias("ends"))
    joined = bounds.join(e.select("event_id", "ts"), F.col("ts").between(F.col("begins"), F.col("ends")), "left")
    return joined.groupBy("bound", "begins", "ends").agg(F.count("event_id").alias("events"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("keyword_overlap", rf"""WITH k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2 AND NOT list_contains([{_STOP}], x))) AS kw FROM conversations),
p AS (SELECT *, lag(kw) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM k)
SELECT conv_id, turn, len(kw) AS keywords, CASE WHEN len(kw) = 0 OR earlier IS NULL THEN 0 ELSE round(len(list_intersect(kw, earlier))::double / len(kw), 6) END::double AS overlap FROM p""")
def keyword_overlap(spark, d):
    """Words of a turn longer than two characters, stop words aside, and the part of them that the turn before had."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS))
    k = read(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(words).alias("kw"))
    k = k.withColumn("earlier", F.lag("kw").over(Window.partitionBy("conv_id").orderBy("turn")))
    share = F.round(F.try_divide(F.size(F.array_intersect("kw", "earlier")), F.size("kw")), 6)
    return k.select("conv_id", "turn", F.size("kw").cast("long").alias("keywords"), F.when((F.size("kw") == 0) | F.col("earlier").isNull(), 0.0).otherwise(share).alias("overlap"))


DATE = rf"([0-9]{{1,2}})(?:st|nd|rd|th)? ({MONTHS}) ([0-9]{{4}})"


@query("date_in_query", f"WITH q AS (SELECT o_orderkey AS id, lower('What was ordered on the ' || strftime(o_orderdate, '%-d') || 'th ' || strftime(o_orderdate, '%B %Y') || '?') AS text FROM orders) SELECT id, regexp_extract(text, '{DATE}', 1)::int AS day, regexp_extract(text, '{DATE}', 2) AS month, regexp_extract(text, '{DATE}', 3)::int AS year FROM q")
def date_in_query(spark, d):
    """Day, month and year that a question names in words."""
    text = F.lower(F.concat(F.lit("What was ordered on the "), F.date_format("o_orderdate", "d"), F.lit("th "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit("?")))
    q = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))
    part = lambda k: F.regexp_extract("text", DATE, k)
    return q.select("id", part(1).cast("int").alias("day"), part(2).alias("month"), part(3).cast("int").alias("year"))


@query("stable_ids", "SELECT p_partkey AS id, left(sha256(lower(p_brand || '|' || p_type || '|' || p_name)), 32) AS stable_id FROM part")
def stable_ids(spark, d):
    """Ids that follow from what a row says, whatever its case."""
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.left(F.sha2(F.lower(F.concat_ws("|", "p_brand", "p_type", "p_name")), 256), F.lit(32)).alias("stable_id"))


@query("session_expiry", "SELECT user_id AS session_id, max(ts) AS last_at, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS expired FROM events GROUP BY user_id")
def session_expiry(spark, d):
    """Sessions idle for more than a day before the latest event."""
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_at"))
    now = s.agg(F.max("last_at").alias("now"))  # one row
    return s.join(F.broadcast(now)).select("session_id", "last_at", (F.col("last_at") < F.col("now") - F.expr("INTERVAL 24 HOUR")).alias("expired"))


@query("reset_weights", """WITH n AS (SELECT c_custkey AS node, c_acctbal AS score FROM customer WHERE c_acctbal > 100 ORDER BY c_acctbal DESC, c_custkey LIMIT 50)
SELECT node, round(score / sum(score) OVER (), 6) AS by_score, round(1.0::double / count(*) OVER (), 6) AS uniform FROM n""")
def reset_weights(spark, d):
    """Restart weights of the fifty best nodes over a least score: in proportion, and uniform."""
    n = read(spark, d, "customer").where("c_acctbal > 100").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("score")).orderBy(F.desc("score"), "node").limit(50)
    total = Window.partitionBy()  # fifty rows at most
    return n.select("node", F.round(F.col("score") / F.sum("score").over(total), 6).alias("by_score"), F.round(F.lit(1.0) / F.count("*").over(total), 6).alias("uniform"))


@query("rewrite_counters", """WITH t AS (SELECT lang, length(text) AS before, length(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS after FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (after < before) AS changed, sum(before)::bigint AS chars_before, sum(after)::bigint AS chars_after, round(sum(after)::double / sum(before), 6) AS ratio FROM t GROUP BY lang""")
def rewrite_counters(spark, d):
    """How many texts a clean-up of white space changes, and the share of characters it keeps."""
    t = read(spark, d, "documents").select("lang", F.length("text").alias("before"), F.length(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))).alias("after"))
    g = t.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("after") < F.col("before")).alias("changed"), F.sum("before").alias("chars_before"), F.sum("after").alias("chars_after"))
    return g.withColumn("ratio", F.round(F.try_divide(F.col("chars_after").cast("double"), F.col("chars_before")), 6))


@query("value_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def value_quantiles(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.percentile("value", 0.9), 6).alias("p90"), F.count_distinct("user_id").alias("users"))
