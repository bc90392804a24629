"""Queries of context assembly, redaction modes, conflicts, dependency order, entity kinds and retrieval limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamspark.functions import text as tx
from loamspark.operators import assembly as op
from loamspark.plans.registry import query
from loamspark.plans.tables import EVENTS, conversation_events, read


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _mode_sql(mode: str, kind: str) -> str:
    stars = lambda x: f"left({x}, 1) || repeat('*', length({x}) - 1)"
    if mode == "mask":
        return "regexp_replace(m, '[A-Za-z0-9]', '*', 'g')"
    if mode == "hash":
        return "left(sha256(m), 8)"
    if mode == "remove":
        return "''"
    if kind == "email":
        part = lambda p: f"regexp_extract(m, '{p}', 1)"
        return stars(part("^(.*)@")) + " || '@' || " + stars(part(r"@([^@]*)\.[^.@]*$")) + " || '.' || " + part(r"\.([^.@]*)$")
    if kind in ("phone", "card"):
        ends = "(?s)^(.*)((?:[0-9][^0-9]*){4})$"
        return f"regexp_replace(regexp_extract(m, '{ends}', 1), '[0-9]', '*', 'g') || regexp_extract(m, '{ends}', 2)"
    return "left(m, 1) || repeat('*', length(m) - 2) || right(m, 1)"


def _redacted_sql() -> str:
    steps, before = ["r0 AS (SELECT doc_id AS id, " + ", ".join(f"text AS {m}" for m in op.MODES) + " FROM documents)"], "r0"
    for i, kind in enumerate(op.KINDS, 1):
        p = _quoted(op.ALL_PII[kind])
        columns = [f"array_to_string(flatten(list_transform(list_zip(regexp_split_to_array({m}, '{p}'), list_transform(regexp_extract_all({m}, '{p}'), lambda m: {_mode_sql(m, kind)})), lambda z: [z[1], coalesce(z[2], '')])), '') AS {m}" for m in op.MODES]
        steps.append(f"r{i} AS (SELECT id, {', '.join(columns)} FROM {before})")
        before = f"r{i}"
    return "WITH " + ", ".join(steps) + " SELECT id, " + ", ".join(f"sha256({m}) AS {m}" for m in op.MODES) + f" FROM {before}"


@query("pii_redact_modes", _redacted_sql())
def pii_redact_modes(spark, d):
    """Digests of each text redacted by masks, hashes, partial masks and removal."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), *[F.sha2(op.redact("text", m), 256).alias(m) for m in op.MODES])


def _sections(spark, d):
    """Events as sections: the session's first is required, length decides the priority."""
    e = conversation_events(spark, d)
    return e.select("session_id", "seq", (F.length("content") % 7).alias("priority"), (F.col("seq") == 0).alias("required"), tx.n_words("content").cast("long").alias("cost"))


SECTIONS = rf"sc AS (SELECT session_id, seq, length(content) % 7 AS priority, seq = 0 AS required, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS cost FROM ev)"


@query("priority_pack", f"""WITH RECURSIVE {EVENTS}, {SECTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, seq) AS n FROM sc WHERE NOT required),
f AS (SELECT session_id, 0::bigint AS n, greatest(60 - coalesce(sum(cost) FILTER (required), 0), 0)::bigint AS rest, coalesce(list(seq ORDER BY seq) FILTER (required), []) AS kept FROM sc GROUP BY session_id
UNION ALL SELECT f.session_id, o.n, CASE WHEN o.cost <= f.rest THEN f.rest - o.cost ELSE f.rest END, CASE WHEN o.cost <= f.rest THEN list_append(f.kept, o.seq) ELSE f.kept END FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1)
SELECT session_id, rest AS "left", kept FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1""")
def priority_pack(spark, d):
    return op.priority_pack(_sections(spark, d), "session_id", 60)


@query("fit_to_budget", f"""WITH RECURSIVE {EVENTS}, {SECTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority, seq) AS n FROM sc),
f AS (SELECT session_id, 0::bigint AS n, sum(cost)::bigint AS now, []::bigint[] AS gone FROM sc GROUP BY session_id
UNION ALL SELECT f.session_id, o.n, CASE WHEN f.now > CASE WHEN o.required THEN 90 ELSE 60 END THEN f.now - o.cost ELSE f.now END, CASE WHEN f.now > CASE WHEN o.required THEN 90 ELSE 60 END THEN list_append(f.gone, o.seq) ELSE f.gone END FROM f JOIN o ON o.session_id = f.session_id AND o.n = f.n + 1),
g AS (SELECT session_id, gone FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1)
SELECT sc.session_id, sc.seq, sc.required FROM sc JOIN g ON g.session_id = sc.session_id WHERE NOT list_contains(g.gone, sc.seq)""")
def fit_to_budget(spark, d):
    return op.fit_sections(_sections(spark, d), "session_id", 60)


@query("render_prompt", f"WITH {EVENTS} SELECT session_id, string_agg(upper(type) || ': ' || content, chr(10) ORDER BY seq) AS prompt FROM ev GROUP BY session_id")
def render_prompt(spark, d):
    """A session's events as one prompt, a line each."""
    line = F.concat(F.upper("type"), F.lit(": "), F.col("content"))
    rows = conversation_events(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("m"))
    return rows.select("session_id", F.array_join(F.col("m.line"), "\n").alias("prompt"))


@query("render_system_apart", f"WITH {EVENTS} SELECT session_id, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY seq) FILTER (type = 'system'), '') AS system, coalesce(list({{'role': CASE type WHEN 'agent' THEN 'assistant' ELSE 'user' END, 'content': content}} ORDER BY seq) FILTER (type IN ('user', 'agent')), []) AS messages FROM ev GROUP BY session_id")
def render_system_apart(spark, d):
    """The system's part as one text, and the messages of user and agent."""
    rows = conversation_events(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "content"))).alias("m"))
    said = F.filter("m", lambda x: x["type"].isin("user", "agent"))
    message = lambda x: F.struct(F.when(x["type"] == "agent", "assistant").otherwise("user").alias("role"), x["content"].alias("content"))
    system = F.array_join(F.transform(F.filter("m", lambda x: x["type"] == "system"), lambda x: x["content"]), "\n\n")
    return rows.select("session_id", system.alias("system"), F.transform(said, message).alias("messages"))


def _any(column: str, words) -> str:
    return f"regexp_matches({column}, '{_quoted('|'.join(words))}')"


def _opposite(a, b) -> str:
    return f"(({_any('new', a)} AND {_any('old', b)}) OR ({_any('new', b)} AND {_any('old', a)}))"


_NUMBERS = r"list_sort(list_distinct(regexp_extract_all({}, '\b[0-9]+\b')))"
_OVERLAP = "CASE WHEN len(k) = 0 THEN 0 ELSE len(list_intersect(k, j))::double / len(k) END"


@query("conflict_actions", rf"""WITH t AS (SELECT conv_id, turn, lower(text) AS new, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(new, '[a-z]+'), lambda x: length(x) > 2)) AS k, list_distinct(list_filter(regexp_extract_all(old, '[a-z]+'), lambda x: length(x) > 2)) AS j FROM t WHERE old IS NOT NULL),
s AS (SELECT conv_id, turn, new, old, {_OVERLAP} AS overlap, CASE WHEN new = old THEN 1 WHEN len(k) + len(j) = 0 THEN 0 ELSE 2.0::double * len(list_intersect(k, j)) / (len(k) + len(j)) END::double AS similarity FROM w),
c AS (SELECT *, ({_opposite(op.POSITIVE, op.NEGATIVE)} AND overlap > 0.3) OR ({_opposite(op.AFFIRMATIVE, op.NEGATIONS)} AND overlap > 0.4) OR (len({_NUMBERS.format('new')}) > 0 AND len({_NUMBERS.format('old')}) > 0 AND {_NUMBERS.format('new')} <> {_NUMBERS.format('old')} AND overlap > 0.5) AS conflict FROM s)
SELECT conv_id, turn, round(overlap, 6) AS overlap, conflict, CASE WHEN similarity >= 0.98 THEN 'IGNORE' WHEN similarity >= 0.5 AND overlap >= 0.5 AND conflict THEN 'CONFLICT' WHEN similarity >= 0.5 AND overlap >= 0.5 THEN 'MERGE' ELSE 'ADD' END AS action FROM c""")
def conflict_actions(spark, d):
    """Each turn against the one before it: shared words decide what becomes of it (limits lowered to 0.5 for these texts)."""
    t = read(spark, d, "conversations").select("conv_id", "turn", F.lower("text").alias("new"))
    t = t.withColumn("old", F.lag("new").over(Window.partitionBy("conv_id").orderBy("turn"))).where("old is not null")
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 2))
    t = t.withColumn("k", words("new")).withColumn("j", words("old")).withColumn("both", F.size(F.array_intersect("k", "j")))
    t = t.withColumn("overlap", F.coalesce(F.try_divide("both", F.size("k")), F.lit(0.0)))
    t = t.withColumn("similarity", F.when(F.col("new") == F.col("old"), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.col("both"), F.size("k") + F.size("j")), F.lit(0.0))))
    t = t.withColumn("conflict", op.conflicting("new", "old", F.col("overlap")))
    return t.select("conv_id", "turn", F.round("overlap", 6).alias("overlap"), "conflict", op.consolidation_action(F.col("similarity"), F.col("overlap"), F.col("conflict"), merge=0.5, keywords=0.5).alias("action"))


@query("skill_dependency_levels", """WITH RECURSIVE e AS (SELECT s_suppkey AS node, s_suppkey // 2 AS needs FROM supplier WHERE s_suppkey >= 2 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey >= 3),
p AS (SELECT n AS node, 0 AS level FROM (SELECT node AS n FROM e UNION SELECT needs FROM e) WHERE n NOT IN (SELECT node FROM e) UNION SELECT e.node, p.level + 1 FROM p JOIN e ON e.needs = p.node)
SELECT node, max(level) AS level FROM p GROUP BY node""")
def skill_dependency_levels(spark, d):
    """Skills by the level at which all they depend on is there; each depends on those at half and a third of its number."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    needs = lambda k: s.where(F.col("node") >= k).select("node", F.expr(f"node div {k}").alias("needs"))
    return op.dependency_levels(needs(2).union(needs(3)).distinct())


@query("progressive_retrieval", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
c AS (SELECT user_id, """ + ", ".join(f"count(*) FILTER (n <= {k} AND value >= 5) AS c{k}" for k in (5, 10, 20, 40)) + """ FROM r GROUP BY user_id)
SELECT user_id, CASE WHEN c5 >= 3 THEN 5 WHEN c10 >= 3 THEN 10 WHEN c20 >= 3 THEN 20 ELSE 40 END AS "limit", c40 >= 3 AS enough FROM c""")
def progressive_retrieval(spark, d):
    return op.progressive_limit(read(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("value") >= 5, 3)


# Patterns of the kinds of entities.
ENTITY_KINDS = {
    "DATE": r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b",
    "TIME": r"\b([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:AM|PM|am|pm)?)\b",
    "EMAIL": r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b",
    "PHONE": r"\b([0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4})\b",
    "MONEY": r"\$([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?)\b",
    "PERCENTAGE": r"\b([0-9]+(?:\.[0-9]+)?)\s*%",
    "ORGANIZATION": r"\bwork(?:s|ing|ed)?\s+(?:at|for)\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b",
    "PERSON": r"\b(?:called|named)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b",
}


@query("entity_kinds", "SELECT doc_id AS id, " + ", ".join(f"len(regexp_extract_all(text, '{_quoted(p)}'))::bigint AS {k.lower()}" for k, p in ENTITY_KINDS.items()) + " FROM documents")
def entity_kinds(spark, d):
    """How many entities of each kind a text names."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), *[F.regexp_count("text", F.lit(p)).cast("long").alias(k.lower()) for k, p in ENTITY_KINDS.items()])


@query("scope_merge", "SELECT o_custkey AS node, o_orderkey AS edge, CASE o_orderstatus WHEN 'F' THEN 'user' WHEN 'O' THEN 'project' ELSE 'global' END AS scope FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) = 1")
def scope_merge(spark, d):
    """Of the graphs of three scopes, each node's edge from the narrowest."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("node"), F.struct(rank.alias("r"), F.col("o_orderkey").alias("edge")).alias("k")).groupBy("node").agg(F.min("k").alias("k"))
    scope = F.element_at(F.array(F.lit("user"), F.lit("project"), F.lit("global")), F.col("k.r") + 1)
    return rows.select("node", "k.edge", scope.alias("scope"))
