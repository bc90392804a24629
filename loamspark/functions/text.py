"""Column functions over text: tokens, overlaps, hashes, token estimates, references, classification and importance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# Cue words and patterns of the classifiers and scorers.
DECISIONS = "decided|chose|will|going to|plan to|want to"
FACTS = (r"\b[0-9]{4}\b", r"\b[0-9]+\s*(dollars?|usd|\$|euros?|pounds?)\b", r"\b[0-9]+\s*(percent|%)\b")
PRONOUN = "they|them|their|theirs|it|its|he|him|his|she|her|hers|we|us|our|ours"
REFERENCE = "that|those|this|these|the same|such|said|mentioned|above|previous"
IMPLICIT = "and|also|what about|how about|same for|likewise|plus|too"
ELLIPSIS = "yes|no|maybe|sure|ok|okay|right|exactly|correct"
EVENT_WEIGHTS = {"system": 0.3, "tool_call": 0.2, "tool_output": 0.15, "user": 0.1}
KNOWLEDGE = {
    "rule": ((r"\b(must|shall|always|never|required|mandatory)\b", 1.0), (r"\b(ensure|verify|validate)\s+that\b", 0.7), (r"^(do not|don't)\b", 0.6), (r"\bevery\s+(request|call|operation)\b", 0.5)),
    "gotcha": ((r"\b(don't forget|watch out|be careful|beware)\b", 1.0), (r"\b(common mistake|pitfall|trap|gotcha)\b", 1.0), (r"\b(avoid|prevent)\s+\w+ing\b", 0.7), (r"\b(can cause|may lead to|will result in)\s+\w*(error|issue|problem|bug)", 0.8)),
    "pattern": ((r"\bSELECT\b.*\bFROM\b", 1.0), (r"\b(INSERT|UPDATE|DELETE)\s+INTO?\b", 1.0), (r"^(def|function|class|async def)\s+\w+", 1.0), (r"```\w*\n", 0.9), (r"\{\{.*\}\}", 0.7), (r"\$\{?\w+\}?", 0.5)),
    "procedure": ((r"^\s*(step\s*[0-9]+|1\.|first,?)\s*", 1.0), (r"\b(then|next|after that|finally)\b", 0.6), (r"\b(follow these steps|process|workflow|procedure)\b", 0.8), (r"^\s*[-*]\s+\w", 0.4), (r"[0-9]+\)\s+\w", 0.7)),
    "definition": ((r"\b(is defined as|means|refers to|is when)\b", 1.0), (r"^[A-Z][a-z]+\s+(is|are)\s+(a|an|the)\b", 0.8), (r"\b(definition|meaning|concept)\s*:", 0.9), (r"\baka\b|\bi\.e\.\b", 0.5)),
    "constraint": ((r"\b(limit|maximum|minimum|at most|at least)\b", 1.0), (r"\b(cannot|must not|should not)\s+exceed\b", 1.0), (r"\b(up to|no more than|between)\s+[0-9]+", 0.8), (r"\b(restricted|bounded|capped)\b", 0.6)),
    "example": ((r"\b(for example|e\.g\.|such as|like this)\b", 1.0), (r"\b(consider|imagine|suppose)\s+(the following|this)\b", 0.7), (r"^example:", 1.0), (r"\b(here's|here is)\s+(an|a)\s+example\b", 0.9)),
}
INTENTS = {
    "query": ((r"how\s+do\s+i\s+(?:query|get|find|retrieve)", 1.0), (r"(?:sql|query)\s+(?:for|to)", 0.9), (r"write\s+(?:a\s+)?(?:sql|query)", 0.9), (r"select\s+.+\s+from", 0.8)),
    "lookup": ((r"what\s+is\s+(?:the|a)", 0.9), (r"tell\s+me\s+about", 0.8), (r"explain\s+", 0.85), (r"describe\s+", 0.8), (r"define\s+", 0.9)),
    "procedure": ((r"how\s+(?:do|can|should)\s+i", 0.9), (r"what\s+(?:are\s+)?the\s+steps", 0.95), (r"walk\s+me\s+through", 0.9), (r"step\s+by\s+step", 0.85), (r"guide\s+me", 0.8)),
    "validation": ((r"is\s+(?:this|it)\s+(?:correct|right|valid)", 0.95), (r"does\s+this\s+look\s+(?:right|correct)", 0.9), (r"verify\s+", 0.85), (r"check\s+(?:if|whether)", 0.85), (r"validate\s+", 0.9)),
    "comparison": ((r"(?:what\s+is\s+)?the\s+difference\s+between", 0.95), (r"compare\s+", 0.9), (r"\bvs\.?\b", 0.7), (r"versus\b", 0.8), (r"which\s+(?:is|one)\s+better", 0.85)),
    "troubleshooting": ((r"(?:why|how)\s+(?:is|does)\s+.+\s+(?:not|fail|error)", 0.9), (r"fix\s+(?:this|the)", 0.85), (r"debug\s+", 0.9), (r"(?:getting|got)\s+(?:an?\s+)?error", 0.85), (r"doesn't\s+work", 0.8)),
    "example": ((r"(?:show|give)\s+(?:me\s+)?(?:an?\s+)?example", 0.95), (r"for\s+example", 0.7), (r"sample\s+(?:code|query)", 0.9), (r"can\s+you\s+demonstrate", 0.85)),
}


def tokens(text) -> Column:
    """Distinct lower-case words (letters, digits, underscore)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def words(text) -> Column:
    """Distinct lower-case pieces between white space."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"\s+")), "")


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def keyword_match(query_tokens: Column, text_tokens: Column) -> Column:
    """Share of the query's tokens that the text holds; 0 for a query without tokens."""
    return F.when(F.size(query_tokens) > 0, overlap(query_tokens, text_tokens) / F.size(query_tokens)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, overlap(a, b) / F.size(F.array_union(a, b))).otherwise(0.0)


def normalized(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_hash(text, kind) -> Column:
    return F.left(F.sha2(F.concat(kind, F.lit(":"), normalized(text)), 256), F.lit(16))


def n_words(text) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def estimate_quarter(text) -> Column:
    """A token for every four characters, and one more."""
    return F.floor(F.length(text) / 4) + 1


def estimate_section(text) -> Column:
    return F.floor(F.length(text) / 4)


def estimate_words(text) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(n_words(text) * F.lit(13) / 10)


def references(text) -> Column:
    """Distinct ids of all [ref:a,b] marks, in order."""
    marks = F.regexp_extract_all(text, F.lit(r"\[ref:([a-zA-Z0-9_,-]+)\]"), F.lit(1))
    return F.array_remove(F.array_distinct(F.flatten(F.transform(marks, lambda m: F.split(m, ",")))), "")


def strip_references(text) -> Column:
    bare = F.regexp_replace(text, r"\[ref:[a-zA-Z0-9_,-]+\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "  +", " "), r" ([.,;:!?])", "$1"))


def parse_confidence(text) -> Column:
    """A share from '0.8', '80%' or '80'; null if it is no number."""
    raw = F.trim(text)
    number = F.regexp_replace(raw, "%$", "").try_cast("double")
    share = F.when(raw.endswith("%") | ((number > 1) & (number <= 100)), number / 100).otherwise(number)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def clean_extraction(text) -> Column:
    """Without a leading 'that', first letter in upper case, ending with a full stop."""
    bare = F.trim(F.regexp_replace(F.trim(text), "^(?i)that ", ""))
    full = F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 30))
    return F.when(bare == "", bare).when(bare.rlike("[.!?]$"), full).otherwise(F.concat(full, F.lit(".")))


def event_importance(kind, text) -> Column:
    """0 to 1 from the event's type, question marks, decisions, facts, capitalised words and length."""
    low, n = F.lower(text), F.length(text)
    score = F.lit(0.5)
    weight = F.lit(0.0)
    for name, value in EVENT_WEIGHTS.items():
        weight = F.when(F.col(kind) == name, value).otherwise(weight)
    score = score + weight + F.when(F.contains(low, F.lit("?")), 0.1).otherwise(0.0) + F.when(low.rlike(DECISIONS), 0.1).otherwise(0.0)
    for fact in FACTS:
        score = score + F.when(low.rlike(fact), 0.05).otherwise(0.0)
    capitals = F.size(F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: w.rlike("^[A-Z][a-z]+$")))
    score = score + F.least(F.lit(0.1), capitals * 0.02) + F.when((n > 100) & (n < 500), 0.05).when(n >= 500, 0.02).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def memory_importance(text, source, explicit: bool = False) -> Column:
    score = F.lit(0.7 if explicit else 0.5) + F.when(n_words(text) > 5, 0.1).otherwise(0.0)
    score = score + F.when(F.lower(text).rlike("love|hate|always|never|favorite|best|worst"), 0.1).otherwise(0.0)
    personal = F.arrays_overlap(F.split(F.lower(source), r"\s+"), F.array(*map(F.lit, ("i", "my", "me", "myself"))))
    return F.least(F.lit(1.0), score + F.when(personal, 0.1).otherwise(0.0))


def ambiguity(text) -> Column:
    """Why a query may need rewriting: pronoun, reference, implicit or ellipsis; null if it is clear.

    Words are compared between single spaces, so word borders follow Unicode in any regular expression engine.
    """
    t = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), " "), F.lit(" "))
    has = lambda words: t.rlike(f" ({words}) ")
    starts = lambda words: t.rlike(f"^ ({words}) ")
    return F.when(has(PRONOUN), "pronoun").when(has(REFERENCE), "reference").when(starts(IMPLICIT), "implicit").when(starts(ELLIPSIS), "ellipsis").when(n_words(text) <= 3, "implicit")


def knowledge_type(text) -> Column:
    """(type, confidence) of the best family of patterns: its largest weight and 0.15 for each further match; insight if none."""

    def scored(hits: Column, order: int, kind: str) -> Column:
        value = F.round(F.least(F.lit(1.0), F.array_max(hits) + (F.size(hits) - 1) * 0.15), 6)
        return F.when(F.size(hits) > 0, F.struct(value.alias("confidence"), F.lit(-order).alias("order"), F.lit(kind).alias("type")))

    def family(order: int, kind: str, rules) -> Column:
        hits = F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit("(?im)" + p)), w) for p, w in rules]))
        return F.transform(F.array(hits), lambda h: scored(h, order, kind))[0]  # each pattern runs once

    options = [family(i, kind, rules) for i, (kind, rules) in enumerate(KNOWLEDGE.items())]
    top = F.greatest(*options)
    return F.when(top["confidence"] >= 0.3, F.struct(top["type"].alias("type"), top["confidence"].alias("confidence"))).otherwise(F.struct(F.lit("insight").alias("type"), F.lit(0.5).alias("confidence")))


def intents(text) -> Column:
    """(intent, score) of every family of patterns that matches, by name."""
    found = []
    for intent, rules in INTENTS.items():
        score = F.greatest(*[F.when(F.regexp_like(text, F.lit("(?i)" + p)), w).otherwise(0.0) for p, w in rules])
        found.append(F.when(score > 0, F.struct(F.lit(intent).alias("intent"), score.alias("score"))))
    return F.sort_array(F.array_compact(F.array(*found)))


def headline(text, width: int = 80) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)


def strip_html(html) -> Column:
    """Text of a page: without scripts, styles, comments and tags; white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\n\r]+", " "))
