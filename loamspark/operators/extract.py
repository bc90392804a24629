"""Text to records: pattern rules, personal data, content filters, chunks, alignment, compression, answers."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamspark.functions import text as tx

END = r"(?:\.|,|!|$)"
# Pattern, group template, confidence and tags of the extraction rules.
RULES = (
    (r"\bi\s+(?:really\s+)?(?:love|adore)\s+(.+?)" + END, "User loves {0}", 0.85, "preference,positive"),
    (r"\bi\s+(?:really\s+)?(?:like|enjoy|prefer)\s+(.+?)" + END, "User likes {0}", 0.80, "preference,positive"),
    (r"\bi\s+(?:really\s+)?(?:hate|dislike|can't stand|detest)\s+(.+?)" + END, "User dislikes {0}", 0.85, "preference,negative"),
    (r"\bi\s+(?:always|usually|typically)\s+(.+?)" + END, "User typically {0}", 0.75, "preference,habit"),
    (r"\bi\s+(?:never|rarely|seldom)\s+(.+?)" + END, "User rarely/never {0}", 0.75, "preference,avoidance"),
    (r"\bi\s+am\s+(?:a|an)\s+(.+?)" + END, "User is a {0}", 0.85, "identity,profession"),
    (r"\bi\s+work\s+(?:at|for)\s+(.+?)" + END, "User works at {0}", 0.90, "work,employer"),
    (r"\bi\s+work\s+as\s+(?:a|an)?\s*(.+?)" + END, "User works as {0}", 0.90, "work,profession"),
    (r"\bi\s+live\s+in\s+(.+?)" + END, "User lives in {0}", 0.90, "location,residence"),
    (r"\bi\s+(?:have|own)\s+(?:a|an)?\s*(.+?)" + END, "User has {0}", 0.75, "possession"),
    (r"\bmy\s+name\s+is\s+(.+?)" + END, "User's name is {0}", 0.95, "identity,name"),
)
# The other rules.
ALL_RULES = RULES + (
    (r"\bmy\s+favorite\s+(.+?)\s+is\s+(.+?)" + END, "User's favorite {0} is {1}", 0.90, "preference,favorite"),
    (r"\bi'm\s+([0-9]+)\s+years?\s+old", "User is {0} years old", 0.90, "identity,age"),
    (r"\bi\s+speak\s+(.+?)" + END, "User speaks {0}", 0.85, "skill,language"),
    (r"\bi\s+(?:went|traveled|visited)\s+(?:to\s+)?(.+?)(?:\s+last|\s+yesterday|\s+recently|\.|,|!|$)", "User visited {0}", 0.80, "travel,experience"),
    (r"\blast\s+(?:week|month|year)\s+i\s+(.+?)" + END, "Recently, user {0}", 0.75, "recent,experience"),
    (r"\bi\s+(?:just|recently)\s+(.+?)" + END, "User recently {0}", 0.75, "recent,experience"),
    (r"\bi\s+used\s+to\s+(.+?)" + END, "User used to {0}", 0.70, "past,experience"),
    (r"\bi\s+(?:want|need)\s+to\s+(.+?)" + END, "User wants to {0}", 0.70, "goal,desire"),
    (r"\bi'm\s+(?:interested|curious)\s+(?:in|about)\s+(.+?)" + END, "User is interested in {0}", 0.80, "interest"),
    (r"\bi'm\s+(?:learning|studying)\s+(.+?)" + END, "User is learning {0}", 0.80, "learning,goal"),
    (r"\bi'm\s+(?:trying|working)\s+(?:to|on)\s+(.+?)" + END, "User is working on {0}", 0.75, "goal,current"),
    (r"\bi\s+(?:know|understand)\s+(.+?)" + END, "User knows {0}", 0.70, "knowledge,skill"),
    (r"\bi'm\s+(?:good|great|excellent)\s+at\s+(.+?)" + END, "User is skilled at {0}", 0.85, "skill,expertise"),
    (r"\bi\s+(?:can|am able to)\s+(.+?)" + END, "User can {0}", 0.70, "ability,skill"),
)
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}\b",
    "ssn": r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b",
    "card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9][0-9])[0-9]{12})\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "date_of_birth": r"\b[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}\b",
}
# All patterns of each kind.
ALL_PII = PII | {
    "phone": r"\([0-9]{3}\)\s*[0-9]{3}[-.\s]?[0-9]{4}|" + PII["phone"] + r"|\b\+1[-.\s]?[0-9]{3}[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b|\b\+[0-9]{1,3}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}\b",
    "card": PII["card"] + r"|\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b",
    "ip": PII["ip"] + r"|\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "date_of_birth": r"(?i:\b(?:born|dob|birthday|birth date)[:\s]+[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}\b)|" + PII["date_of_birth"],
}
ACTIONS = ("allow", "warn", "redact", "block")


def apply_rules(docs: DataFrame, rules=ALL_RULES) -> DataFrame:
    """id, content, confidence, tags of every match of every rule in docs (id, text)."""

    def of(pattern: str, template: str, confidence: float, tags: str) -> Column:
        parts = re.split(r"\{[0-9]\}", template)
        groups = [F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(k)) for k in range(1, len(parts))]

        def made(*found: Column) -> Column:
            content = F.concat(F.lit(parts[0]), *[x for m, p in zip(found, parts[1:], strict=True) for x in (F.trim(m), F.lit(p))])
            return F.struct(content.alias("content"), F.lit(confidence).alias("confidence"), F.lit(tags).alias("tags"))

        return F.transform(groups[0], lambda m: made(m)) if len(groups) == 1 else F.zip_with(*groups, lambda m, n: made(m, n))

    return docs.select("id", F.explode(F.concat(*[of(*rule) for rule in rules])).alias("m")).select("id", "m.*")


def filter_candidates(candidates: DataFrame, least: float = 0.5, most: int = 10) -> DataFrame:
    """Of each id the most confident candidates, one of equal content (case and surrounding space aside)."""
    key = F.lower(F.trim("content"))
    one = candidates.where(F.col("confidence") >= least).withColumn("_n", F.row_number().over(Window.partitionBy("id", key).orderBy(F.desc("confidence"), F.asc("content")))).where("_n = 1")
    ranked = one.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), F.asc("content"))))
    return ranked.where(F.col("_n") <= most).drop("_n")


def pii_counts(text: str, patterns: dict[str, str] = ALL_PII) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).alias(k) for k, p in patterns.items()]


def pii_redact(text: str, patterns: dict[str, str] = ALL_PII) -> Column:
    """Every match replaced by its kind in brackets, kind by kind."""
    out = F.col(text)
    for kind in ("email", "card", "ip", "ssn", "phone", "date_of_birth"):
        out = F.regexp_replace(out, patterns[kind], f"[{kind.upper()}]")
    return out


def content_action(text: str, categories: dict[str, tuple[tuple[str, ...], str]]) -> Column:
    """The strongest action (allow < warn < redact < block) of categories whose words occur as whole words."""
    level = F.lit(0)
    for words, action in categories.values():
        pattern = r"(?i)\b(" + "|".join(map(re.escape, words)) + r")\b"
        level = F.greatest(level, F.when(F.col(text).rlike(pattern), ACTIONS.index(action)).otherwise(0))
    return F.element_at(F.array(*map(F.lit, ACTIONS)), level + 1)


def _pieces(text: str, size: int) -> list[tuple[int, int]]:
    """Character spans of chunks: whole sentences up to size, a longer sentence broken at a newline or space."""
    spans, start, end = [], 0, 0
    for m in re.finditer(r".+?(?:[.!?。！？]+[\"')\]]*(?=\s|$)|$)\s*", text, re.S):
        if m.end() - start > size and end > start:
            spans.append((start, end))
            start = end
        end = m.end()
        while end - start > size:
            cut = max(text.rfind("\n", start + 1, start + size), text.rfind(" ", start + 1, start + size)) + 1
            cut = cut if cut > start else start + size
            spans.append((start, cut))
            start = cut
    if end > start:
        spans.append((start, end))
    return spans


def chunk(docs: DataFrame, size: int = 2000) -> DataFrame:
    """id, chunk, start, end, text: sentence-aware chunks of docs (id, text), no character lost."""
    shape = f"id {docs.schema['id'].dataType.simpleString()}, chunk int, start int, end int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(pdf["id"], pdf["text"], strict=True) if t for k, (a, b) in enumerate(_pieces(t, size))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "start", "end", "text"])

    return docs.select("id", "text").mapInPandas(run, shape)


def align(rows: DataFrame, least: float = 0.75) -> DataFrame:
    """id, status, start, end: where extraction stands in text; exact first, else the window of words that is most alike."""
    shape = f"id {rows.schema['id'].dataType.simpleString()}, status string, start int, end int"

    def place(text: str, wanted: str) -> tuple[str, int, int]:
        at = text.lower().find(wanted.lower())
        if wanted and at >= 0:
            return "exact", at, at + len(wanted)
        words, ask = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)], re.findall(r"\w+", wanted.lower())
        best, n, bag = (least, None), len(ask), set(ask)
        for i in range(len(words) - n + 1 if n else 0):
            part = [w for w, _, _ in words[i : i + n]]
            if len(bag.intersection(part)) * 2 >= n and (r := difflib.SequenceMatcher(None, part, ask, False).ratio()) >= best[0] and (best[1] is None or r > best[0]):
                best = (r, i)
        return ("none", -1, -1) if best[1] is None else ("fuzzy", words[best[1]][1], words[best[1] + n - 1][2])

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, *place(t or "", e or "")) for i, t, e in zip(pdf["id"], pdf["text"], pdf["extraction"], strict=True)], columns=["id", "status", "start", "end"])

    return rows.select("id", "text", "extraction").mapInPandas(run, shape)


def json_from_text(text: Column) -> Column:
    """The first JSON object or array in a model's answer (fenced or bare), as a string; null if there is none."""

    @F.pandas_udf("string")
    def salvage(values: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def first(s):
            for m in re.finditer(r"[\[{]", s or ""):
                try:
                    return json.dumps(decoder.raw_decode(s, m.start())[0])
                except ValueError:
                    continue
            return None

        return values.map(first)

    return salvage(text)


def similarity(a: Column, b: Column) -> Column:
    """Share of matching characters of two texts, white space collapsed, lower case."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        clean = lambda s: re.sub(r"\s+", " ", s or "").strip().lower()
        return pd.Series([difflib.SequenceMatcher(None, clean(p), clean(q)).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return ratio(a, b)


def compress_output(text: str, limit: int = 500, head: float = 0.7, tail: float = 0.25) -> Column:
    """Tool output: distinct lines if fewer than 70 % of over 20 lines are, else head and tail if longer than limit."""
    t = F.col(text)
    lines = F.split(t, "\n")
    keys = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    deduped = F.array_join(F.array_distinct(keys), "\n")
    cut = F.concat(F.substring(t, 1, int(limit * head)), F.lit("\n...\n"), F.right(t, F.lit(int(limit * tail))))
    return F.when(F.length(t) <= limit, t).when((F.size(lines) > 20) & (F.size(F.array_distinct(keys)) < 0.7 * F.size(lines)), deduped).otherwise(cut)


def grade(answer: Column, truth: Column, kind: str, tolerance: float = 0.001) -> Column:
    """Whether an answer is right: exact (case and punctuation aside), numeric (within tolerance) or choice (its letter)."""
    if kind == "numeric":
        number = lambda c: F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
        return F.coalesce(F.abs(number(answer) - number(truth)) <= tolerance, F.lit(False))
    if kind == "choice":
        letter = lambda c: F.upper(F.regexp_extract(c, r"(?i)(?:answer is\s*)?\(?\b([a-e])\b", 1))
        return (letter(answer) != "") & (letter(answer) == letter(truth))
    bare = lambda c: tx.normalized(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", ""))
    return bare(answer) == bare(truth)


def ace_line(text: Column) -> Column:
    """(id, helpful, harmful, content) of a line '[id] helpful=n harmful=m :: text'."""
    pattern = r"^\[([^\]]+)\]\s*helpful=([0-9]+)\s+harmful=([0-9]+)\s*::\s*(.*)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("id"), part(2).cast("int").alias("helpful"), part(3).cast("int").alias("harmful"), part(4).alias("content")))
