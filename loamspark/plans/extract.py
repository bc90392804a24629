"""Queries of text extraction, classification, filtering and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamspark.functions import text as tx
from loamspark.operators import extract as op
from loamspark.plans.registry import query
from loamspark.plans.tables import ASKED, MEMORIES, asked, memories, read


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _docs(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("pii_counts", "SELECT doc_id AS id, " + ", ".join(f"len(regexp_extract_all(text, '{_sql(p)}')) AS {k}" for k, p in op.ALL_PII.items()) + " FROM documents")
def pii_counts(spark, d):
    return _docs(spark, d).select("id", *op.pii_counts("text"))


def _redact_sql() -> str:
    out = "text"
    for k in ("email", "card", "ip", "ssn", "phone", "date_of_birth"):
        out = f"regexp_replace({out}, '{_sql(op.ALL_PII[k])}', '[{k.upper()}]', 'g')"
    return out


@query("pii_redact_replace", f"SELECT doc_id AS id, sha256({_redact_sql()}) AS redacted FROM documents")
def pii_redact_replace(spark, d):
    return _docs(spark, d).select("id", F.sha2(op.pii_redact("text"), 256).alias("redacted"))


CATEGORIES = {"insult": (("stupid", "worthless"), "block"), "taste": (("disgusting", "awful"), "redact"), "legal": (("rights reserved", "license"), "warn")}


def _category(words) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


@query("content_filter_action", "SELECT doc_id AS id, CASE " + " ".join(f"WHEN regexp_matches(text, '{_category(w)}') THEN '{a}'" for w, a in CATEGORIES.values()) + " ELSE 'allow' END AS action FROM documents")
def content_filter_action(spark, d):
    return _docs(spark, d).select("id", op.content_action("text", CATEGORIES).alias("action"))


def _greatest(rules, flags: str, column: str) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN regexp_matches({column}, '{flags}{_sql(p)}') THEN {w}::double ELSE 0 END" for p, w in rules) + ")"


@query("intent_pattern", f"WITH {ASKED}, t AS (SELECT conv_id, turn, text FROM asked), s AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS intent, {_greatest(r, '(?i)', 'text')} AS score FROM t" for k, r in tx.INTENTS.items()) + ") SELECT * FROM s WHERE score > 0")
def intent_pattern(spark, d):
    rows = asked(spark, d).select("conv_id", "turn", F.explode(tx.intents("text")).alias("i"))
    return rows.select("conv_id", "turn", "i.intent", "i.score")


def _knowledge_sql() -> str:
    parts = []
    for i, (k, rules) in enumerate(tx.KNOWLEDGE.items()):
        n = " + ".join(f"regexp_matches(text, '(?im){_sql(p)}')::int" for p, _ in rules)
        parts.append(f"SELECT doc_id, '{k}' AS type, {i} AS o, round(least(1, {_greatest(rules, '(?im)', 'text')} + ({n} - 1) * 0.15::double), 6) AS confidence FROM documents WHERE {n} > 0")
    return f"""WITH s AS ({" UNION ALL ".join(parts)}), b AS (SELECT * FROM s WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, o) = 1)
SELECT d.doc_id AS id, coalesce(b.type, 'insight') AS type, coalesce(b.confidence, 0.5) AS confidence FROM documents d LEFT JOIN b USING (doc_id)"""


@query("knowledge_type", _knowledge_sql())
def knowledge_type(spark, d):
    return _docs(spark, d).select("id", tx.knowledge_type("text").alias("k")).select("id", "k.type", "k.confidence")


@query(
    "query_ambiguity",
    rf"""WITH t AS (SELECT conv_id, turn, text, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, ' ({tx.PRONOUN}) ') THEN 'pronoun' WHEN regexp_matches(t, ' ({tx.REFERENCE}) ') THEN 'reference' WHEN regexp_matches(t, '^ ({tx.IMPLICIT}) ') THEN 'implicit'
WHEN regexp_matches(t, '^ ({tx.ELLIPSIS}) ') THEN 'ellipsis' WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 3 THEN 'implicit' END AS reason FROM t""",
)
def query_ambiguity(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.ambiguity("text").alias("reason"))


REFERRED = "t AS (SELECT doc_id AS id, text || ' [ref:' || source || ',' || lang || '] and [ref:' || lang || '] .' AS text FROM documents)"


def _referred(spark, d):
    text = F.concat("text", F.lit(" [ref:"), "source", F.lit(","), "lang", F.lit("] and [ref:"), "lang", F.lit("] ."))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))


@query("references_extract", rf"""WITH {REFERRED}, r AS (SELECT id, text, flatten(list_transform(regexp_extract_all(text, '\[ref:([a-zA-Z0-9_,-]+)\]', 1), lambda x: string_split(x, ','))) AS ids FROM t)
SELECT id, list_filter(ids, lambda x, i: x <> '' AND list_position(ids, x) = i) AS ids, trim(regexp_replace(regexp_replace(regexp_replace(text, '\[ref:[a-zA-Z0-9_,-]+\]', '', 'g'), '  +', ' ', 'g'), ' ([.,;:!?])', '\1', 'g')) AS stripped FROM r""")
def references_extract(spark, d):
    return _referred(spark, d).select("id", tx.references("text").alias("ids"), tx.strip_references("text").alias("stripped"))


PERSONAL = "t AS (SELECT doc_id AS id, 'I love ' || source || '. I work at ' || lang || ', and I live in ' || text || '.' AS text FROM documents)"


def _personal(spark, d):
    text = F.concat(F.lit("I love "), "source", F.lit(". I work at "), "lang", F.lit(", and I live in "), "text", F.lit("."))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))


def _rules_sql() -> str:
    rows = []
    for p, t, c, g in op.ALL_RULES:
        template = "'" + _sql(t) + "'"
        for k in range(2):
            template = template.replace(f"{{{k}}}", f"' || trim(unnest(regexp_extract_all(text, '(?i){_sql(p)}', {k + 1}))) || '")
        rows.append(f"SELECT id, {template} AS content, {c}::double AS confidence, '{g}' AS tags FROM t")
    return f"WITH {PERSONAL} " + " UNION ALL ".join(rows)


@query("pattern_extract", _rules_sql())
def pattern_extract(spark, d):
    return op.apply_rules(_personal(spark, d))


@query("candidate_filter", f"WITH c AS ({_rules_sql()}), o AS (SELECT * FROM c WHERE confidence >= 0.8 QUALIFY row_number() OVER (PARTITION BY id, lower(trim(content)) ORDER BY confidence DESC, content) = 1) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, content) <= 2")
def candidate_filter(spark, d):
    return op.filter_candidates(op.apply_rules(_personal(spark, d)), 0.8, 2)


@query("entity_counts", r"SELECT lang, e AS entity, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) AS e FROM documents) GROUP BY ALL")
def entity_counts(spark, d):
    """Two capitalised words in a row, by language."""
    rows = read(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0))).alias("entity"))
    return rows.groupBy("lang", "entity").agg(F.count("*").alias("n"))


@query("entity_action_counts", "SELECT user_id AS entity, event_type AS action, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, list_sort(list(DISTINCT json_extract(props, '$.k')::int))[1] AS least_k FROM events GROUP BY ALL")
def entity_action_counts(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min(F.get_json_object("props", "$.k").cast("int")).alias("least_k"))


@query("temporal_index", "SELECT ts::date AS day, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY 1")
def temporal_index(spark, d):
    return read(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))


@query("index_merge", "SELECT user_id AS entity, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def index_merge(spark, d):
    """Aggregates of old and new events merged: counts added, sets united."""
    e = read(spark, d, "events")
    part = lambda rows: rows.groupBy(F.col("user_id").alias("entity")).agg(F.count("*").alias("n"), F.collect_set("event_type").alias("kinds"))
    both = part(e.where("event_id < 5000")).unionByName(part(e.where("event_id >= 5000")))
    return both.groupBy("entity").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


@query("html_text", r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS text_sha256, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages""")
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(tx.strip_html("html"), 256).alias("text_sha256"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("memory_projection", rf"""WITH {MEMORIES} SELECT id, CASE WHEN length(content) > 80 THEN substring(content, 1, 77) || '...' ELSE content END || CASE WHEN confidence < 0.7 THEN ' (uncertain)' WHEN confidence < 0.9 THEN ' (likely)' ELSE '' END AS line, content || ' | Type: ' || kind || ' | Tags: ' || user_id || ', ' || kind AS indexed,
round(least(1, 0.5 + CASE WHEN len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) > 5 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(content), 'love|hate|always|never|favorite|best|worst') THEN 0.1 ELSE 0 END
+ CASE WHEN list_has_any(regexp_split_to_array(lower(content), '\s+'), ['i', 'my', 'me', 'myself']) THEN 0.1 ELSE 0 END)::double, 6) AS importance FROM memories""")
def memory_projection(spark, d):
    label = F.when(F.col("confidence") < 0.7, " (uncertain)").when(F.col("confidence") < 0.9, " (likely)").otherwise("")
    indexed = F.concat("content", F.lit(" | Type: "), "kind", F.lit(" | Tags: "), "user_id", F.lit(", "), "kind")
    return memories(spark, d).select("id", F.concat(tx.headline("content"), label).alias("line"), indexed.alias("indexed"), F.round(tx.memory_importance("content", "content"), 6).alias("importance"))


@query("memory_filters", f"WITH {MEMORIES} SELECT id, user_id, confidence FROM memories WHERE is_active AND kind IN ('en', 'fr') AND confidence >= 0.5")
def memory_filters(spark, d):
    return memories(spark, d).where(F.col("is_active") & F.col("kind").isin("en", "fr") & (F.col("confidence") >= 0.5)).select("id", "user_id", "confidence")


@query("compressed_output", r"""WITH l AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS lines FROM documents), k AS (SELECT id, text, lines, list_transform(lines, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS keys FROM l),
u AS (SELECT *, list_filter(keys, lambda x, i: list_position(keys, x) = i) AS uniq FROM k)
SELECT id, sha256(CASE WHEN length(text) <= 500 THEN text WHEN len(lines) > 20 AND len(uniq) < 0.7 * len(lines) THEN array_to_string(uniq, chr(10)) ELSE substring(text, 1, 350) || chr(10) || '...' || chr(10) || right(text, 125) END) AS output FROM u""")
def compressed_output(spark, d):
    return _docs(spark, d).select("id", F.sha2(op.compress_output("text"), 256).alias("output"))


@query("knowledge_priority", "WITH t AS (SELECT doc_id AS id, lang AS type, n_chars FROM documents) SELECT id, type, CASE type WHEN 'en' THEN 0.2 WHEN 'fr' THEN 0.15 WHEN 'de' THEN 0.1 ELSE 0 END::double AS boost FROM t WHERE type <> 'es'")
def knowledge_priority(spark, d):
    """Types in a priority list gain 0.2 less 0.05 a place; excluded types go."""
    boost = F.lit(0.0)
    for i, kind in enumerate(("en", "fr", "de")):
        boost = F.when(F.col("lang") == kind, round(0.2 - 0.05 * i, 6)).otherwise(boost)
    return read(spark, d, "documents").where("lang <> 'es'").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), boost.alias("boost"))


@query("chunking")
def chunking(spark, d):
    return op.chunk(_docs(spark, d), 2000)


@query("word_align")
def word_align(spark, d):
    rows = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.regexp_extract("text", r"^(?:\S+\s+){3}((?:\S+\s+){4}\S+)", 1).alias("extraction"))
    return op.align(rows)
