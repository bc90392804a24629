"""Queries over sessions and events: timelines, turns, compaction, metrics, packing, governance windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.functions import text as tx
from loamspark.operators import timeline as op
from loamspark.plans.registry import query
from loamspark.plans.tables import EVENTS, conversation_events, read

TURNS = f"""WITH {EVENTS}, tn AS (SELECT *, sum(CASE WHEN type = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)
  - CASE WHEN first_value(type) OVER (PARTITION BY session_id ORDER BY seq) = 'user' THEN 1 ELSE 0 END AS turn,
  sum(CASE WHEN type = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS users FROM ev)"""


@query("turn_segmentation", TURNS + " SELECT session_id, seq, type, turn::bigint AS turn FROM tn")
def turn_segmentation(spark, d):
    return op.number_turns(conversation_events(spark, d)).select("session_id", "seq", "type", "turn")


@query("last_n_turns", TURNS + " SELECT session_id, seq, turn::bigint AS turn FROM tn WHERE turn >= greatest(users - 2, 0)")
def last_n_turns(spark, d):
    return op.last_turns(conversation_events(spark, d), 2).select("session_id", "seq", "turn")


@query("recent_events", f"WITH {EVENTS} SELECT session_id, seq, type FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) <= 3")
def recent_events(spark, d):
    return op.tail(conversation_events(spark, d), 3).select("session_id", "seq", "type")


@query("activity_summary", f"WITH {EVENTS} SELECT session_id, count(*) AS n_events, count(*) FILTER (type = 'user') AS turns, count(*) FILTER (type = 'agent') AS agent, count(*) FILTER (type = 'system') AS system, min(seq) AS first_seq, max(seq) AS last_seq FROM ev GROUP BY session_id")
def activity_summary(spark, d):
    count = lambda k: F.sum(F.when(F.col("type") == k, 1).otherwise(0))
    return conversation_events(spark, d).groupBy("session_id").agg(F.count("*").alias("n_events"), count("user").alias("turns"), count("agent").alias("agent"), count("system").alias("system"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("timeline_range_counts", "SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double AS seconds FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-09' GROUP BY user_id, event_type")
def timeline_range_counts(spark, d):
    ts = F.col("ts")
    rows = read(spark, d, "events").where(ts.between(F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-09").cast("timestamp_ntz")))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), ((micros(F.max(ts)) - micros(F.min(ts))) / 1e6).alias("seconds"))


@query("sliding_window_compaction", f"WITH {EVENTS} SELECT session_id, seq, type FROM ev QUALIFY type = 'system' OR row_number() OVER (PARTITION BY session_id, type = 'system' ORDER BY seq DESC) <= 4")
def sliding_window_compaction(spark, d):
    return op.keep_recent(conversation_events(spark, d), 4).select("session_id", "seq", "type")


IMPORTANCE = r"""round(greatest(0, least(1, 0.5 + CASE type WHEN 'system' THEN 0.3 WHEN 'user' THEN 0.1 ELSE 0 END
 + CASE WHEN contains(lower(content), '?') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(content), 'decided|chose|will|going to|plan to|want to') THEN 0.1 ELSE 0 END
 + CASE WHEN regexp_matches(lower(content), '\b[0-9]{4}\b') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(lower(content), '\b[0-9]+\s*(dollars?|usd|\$|euros?|pounds?)\b') THEN 0.05 ELSE 0 END
 + CASE WHEN regexp_matches(lower(content), '\b[0-9]+\s*(percent|%)\b') THEN 0.05 ELSE 0 END + least(0.1, 0.02 * len(list_filter(regexp_extract_all(content, '[\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$'))))
 + CASE WHEN length(content) > 100 AND length(content) < 500 THEN 0.05 WHEN length(content) >= 500 THEN 0.02 ELSE 0 END))::double, 6)"""


@query("importance_score", f"WITH {EVENTS} SELECT session_id, seq, {IMPORTANCE} AS importance FROM ev")
def importance_score(spark, d):
    return conversation_events(spark, d).select("session_id", "seq", F.round(tx.event_importance("type", "content"), 6).alias("importance"))


@query(
    "importance_compaction",
    f"""WITH {EVENTS}, s AS (SELECT *, {IMPORTANCE} AS importance, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, n > 2 ORDER BY importance DESC, seq) AS i FROM s)
SELECT session_id, seq, importance FROM r WHERE n <= 2 OR (i <= 3 AND importance >= 0.3)""",
)
def importance_compaction(spark, d):
    return op.keep_important(conversation_events(spark, d), 5, tx.event_importance("type", "content")).select("session_id", "seq", "importance")


@query(
    "summary_fallback",
    f"""WITH {EVENTS}, s AS (SELECT session_id, seq, trim(regexp_split_to_array(content, '[.!?]')[1]) AS s FROM ev WHERE type = 'user'),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM s WHERE length(s) > 0 AND length(s) < 200 QUALIFY n <= 5)
SELECT session_id, string_agg(s, '; ' ORDER BY seq) AS summary FROM k GROUP BY session_id""",
)
def summary_fallback(spark, d):
    return op.summary_fallback(conversation_events(spark, d))


NWORDS = r"len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> ''))"


@query("token_estimates", f"WITH {EVENTS} SELECT session_id, seq, length(content) // 4 + 1 AS by_quarter, length(content) // 4 AS by_section, {NWORDS} AS by_words, ({NWORDS} * 13) // 10 AS by_weighted_words FROM ev")
def token_estimates(spark, d):
    return conversation_events(spark, d).select("session_id", "seq", tx.estimate_quarter("content").alias("by_quarter"), tx.estimate_section("content").alias("by_section"), tx.n_words("content").alias("by_words"), tx.estimate_words("content").alias("by_weighted_words"))


@query("should_condense", f"WITH {EVENTS} SELECT session_id, count(*) AS n_events, sum(length(content) // 4 + 1)::bigint AS tokens, count(*) > 10 OR sum(length(content) // 4 + 1) > 4000 AS condense FROM ev GROUP BY session_id")
def should_condense(spark, d):
    rows = conversation_events(spark, d).groupBy("session_id").agg(F.count("*").alias("n_events"), F.sum(tx.estimate_quarter("content")).alias("tokens"))
    return rows.withColumn("condense", (F.col("n_events") > 10) | (F.col("tokens") > 4000))


@query("context_health", f"WITH {EVENTS}, t AS (SELECT session_id, sum(length(content) // 4 + 1)::bigint AS tokens FROM ev GROUP BY session_id) SELECT session_id, tokens, round(tokens / 4000.0::double, 6) AS share, CASE WHEN tokens >= 3400 THEN 'critical' WHEN tokens >= 2800 THEN 'warning' WHEN tokens >= 2000 THEN 'elevated' ELSE 'healthy' END AS state FROM t")
def context_health(spark, d):
    """Token use of each session against a budget of 4000, by the thresholds 50, 70 and 85 %."""
    rows = conversation_events(spark, d).groupBy("session_id").agg(F.sum(tx.estimate_quarter("content")).alias("tokens"))
    share = F.col("tokens") / 4000
    return rows.select("session_id", "tokens", F.round(share, 6).alias("share"), F.when(share >= 0.85, "critical").when(share >= 0.7, "warning").when(share >= 0.5, "elevated").otherwise("healthy").alias("state"))


@query(
    "sliding_event_windows",
    f"""WITH {EVENTS}, p AS (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS p FROM ev),
s AS (SELECT session_id, unnest(range(0, count(*), 2)) AS start FROM ev GROUP BY session_id)
SELECT s.session_id, s.start, list(p.seq ORDER BY p.seq) AS members FROM s JOIN p ON p.session_id = s.session_id AND p.p >= s.start AND p.p < s.start + 3 GROUP BY ALL""",
)
def sliding_event_windows(spark, d):
    return op.sliding(conversation_events(spark, d), 3, 2)


@query("event_batches", f"WITH {EVENTS} SELECT session_id, seq, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // 4 AS batch FROM ev")
def event_batches(spark, d):
    return op.batches(conversation_events(spark, d), 4).select("session_id", "seq", "batch")


@query("token_budget_prefix", f"WITH {EVENTS}, c AS (SELECT session_id, seq, sum(length(content) // 4 + 1) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::bigint AS used, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ev) SELECT session_id, seq, used FROM c WHERE used <= 300 OR n = 1")
def token_budget_prefix(spark, d):
    rows = conversation_events(spark, d).withColumn("cost", tx.estimate_quarter("content"))
    return op.budget_prefix(rows, "session_id", [F.asc("seq")], "cost", 300).select("session_id", "seq", "used")


@query(
    "budget_pack",
    f"""WITH RECURSIVE {EVENTS}, c AS (SELECT session_id, seq, length(content) // 4 + 1 AS cost, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ev),
f AS (SELECT session_id, 0::bigint AS n, 300::bigint AS left_over, []::bigint[] AS kept FROM c GROUP BY session_id
UNION ALL SELECT c.session_id, c.n, CASE WHEN c.cost <= f.left_over THEN f.left_over - c.cost ELSE f.left_over END, CASE WHEN c.cost <= f.left_over THEN list_append(f.kept, c.seq) ELSE f.kept END FROM f JOIN c ON c.session_id = f.session_id AND c.n = f.n + 1)
SELECT session_id, left_over AS "left", kept FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1""",
)
def budget_pack(spark, d):
    rows = conversation_events(spark, d).withColumn("cost", tx.estimate_quarter("content"))
    return op.budget_pack(rows, "session_id", "seq", "cost", 300)


@query("render_messages", f"WITH {EVENTS} SELECT session_id, list({{'role': CASE WHEN type = 'agent' THEN 'assistant' ELSE type END, 'content': content}} ORDER BY seq) AS messages FROM ev GROUP BY session_id")
def render_messages(spark, d):
    return op.render(conversation_events(spark, d))


@query("session_metrics", "SELECT user_id, count(*) AS turns, round(avg(CASE WHEN value >= 5 THEN 1.0::double ELSE 0 END), 6) AS hit_rate, round(coalesce(avg(value) FILTER (event_type <> 'error'), 0), 6) AS relevance, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS feedback FROM events GROUP BY user_id")
def session_metrics(spark, d):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    relevance = F.round(F.coalesce(F.avg(F.when(F.col("event_type") != "error", F.col("value"))), F.lit(0.0)), 6)
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("turns"), share(F.col("value") >= 5).alias("hit_rate"), relevance.alias("relevance"), share(F.col("event_type") == "purchase").alias("feedback"))


@query("cumulative_hit_rate", "SELECT event_id, user_id, round(avg(CASE WHEN value >= 5 THEN 1.0::double ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS hit_rate FROM events")
def cumulative_hit_rate(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return read(spark, d, "events").select("event_id", "user_id", F.round(F.avg(F.when(F.col("value") >= 5, 1.0).otherwise(0.0)).over(w), 6).alias("hit_rate"))


@query("rolling_accuracy", "SELECT event_id, user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::double ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING), 6) AS accuracy FROM events")
def rolling_accuracy(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, Window.currentRow)
    return read(spark, d, "events").select("event_id", "user_id", F.round(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).over(w), 6).alias("accuracy"))


@query("tool_stats", "SELECT event_type AS tool, count(*) AS uses, round(avg(CASE WHEN value > 1 THEN 1.0::double ELSE 0 END), 6) AS success_rate, round(avg(value), 6) AS avg_time, max(json_extract(props, '$.k')::int) AS max_k FROM events GROUP BY event_type")
def tool_stats(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("uses"), F.round(F.avg(F.when(F.col("value") > 1, 1.0).otherwise(0.0)), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("avg_time"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("max_k"))


@query("audit_query", "SELECT user_id, event_id, ts, event_type FROM events WHERE event_type IN ('error', 'purchase') AND value > 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def audit_query(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = read(spark, d, "events").where(F.col("event_type").isin("error", "purchase") & (F.col("value") > 1))
    return rows.withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id", "ts", "event_type")


@query("audit_retention", "SELECT user_id, count(*) AS kept, min(ts) AS oldest FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY user_id")
def audit_retention(spark, d):
    """A log of 20 events a user: the newest stay."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 20").groupBy("user_id").agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


@query("fixed_window_rate", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) <= 2 AS allowed FROM events GROUP BY ALL")
def fixed_window_rate(spark, d):
    rows = read(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start")).agg(F.count("*").alias("n"))
    return rows.withColumn("allowed", F.col("n") <= 2)


@query("range_window_rate", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS n FROM events")
def range_window_rate(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, Window.currentRow)
    return read(spark, d, "events").select("event_id", "user_id", F.count("*").over(w).alias("n"))


@query("approval_expired", "SELECT event_id, CASE WHEN event_type = 'click' AND ts + INTERVAL 1 DAY < (SELECT max(ts) FROM events) THEN 'expired' WHEN event_type = 'click' THEN 'pending' ELSE 'decided' END AS state FROM events")
def approval_expired(spark, d):
    """Clicks as requests that stay open a day."""
    e = read(spark, d, "events")
    as_of = F.broadcast(e.agg(F.max("ts").alias("as_of")))  # one row
    late = F.col("ts") + F.expr("interval 1 day") < F.col("as_of")
    return e.crossJoin(as_of).select("event_id", F.when(F.col("event_type") != "click", "decided").when(late, "expired").otherwise("pending").alias("state"))


@query("temporal_proximity", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 6 * 3600000000")
def temporal_proximity(spark, d):
    """Events of a user less than six hours apart: a range join over six-hour buckets, each row in its own and the next."""
    e = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("bucket", F.floor(F.col("t") / 21_600_000_000))
    a = e.select(F.col("event_id").alias("a"), "user_id", F.col("t").alias("ta"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = e.select(F.col("event_id").alias("b"), "user_id", F.col("t").alias("tb"), "bucket")
    return a.join(b, ["user_id", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) < 21_600_000_000)).select("a", "b")


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 24 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 24 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    """Idle expiry: a user's session ends after 24 hours without an event."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "24 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")
