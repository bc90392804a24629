"""Context assembly and consolidation: sections packed to a budget, redaction modes, conflicts, dependency order, lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamspark.operators.extract import ALL_PII
from loamspark.operators.graph import _written as written

#: The order in which kinds are redacted.
KINDS = ("email", "card", "ip", "ssn", "phone", "date_of_birth")


def partial_mask(kind: str, m: Column) -> Column:
    """An e-mail keeps the first letters and the last part of its domain, a number its last four digits, others their ends."""
    stars = lambda x: F.concat(F.left(x, F.lit(1)), F.repeat(F.lit("*"), F.length(x) - 1))
    if kind == "email":
        group = lambda p: F.regexp_extract(m, p, 1)
        return F.concat(stars(group("^(.*)@")), F.lit("@"), stars(group(r"@([^@]*)\.[^.@]*$")), F.lit("."), group(r"\.([^.@]*)$"))
    if kind in ("phone", "card"):
        ends = r"(?s)^(.*)((?:[0-9][^0-9]*){4})$"
        return F.concat(F.regexp_replace(F.regexp_extract(m, ends, 1), "[0-9]", "*"), F.regexp_extract(m, ends, 2))
    return F.concat(F.left(m, F.lit(1)), F.repeat(F.lit("*"), F.length(m) - 2), F.right(m, F.lit(1)))


MODES: dict[str, Callable[[str, Column], Column]] = {
    "mask": lambda kind, m: F.regexp_replace(m, "[A-Za-z0-9]", "*"),
    "hash": lambda kind, m: F.left(F.sha2(m, 256), F.lit(8)),
    "partial": partial_mask,
    "remove": lambda kind, m: F.lit(""),
}


def redact(text: str, mode: str, patterns: dict[str, str] = ALL_PII) -> Column:
    """Every match of every kind put through a mode of MODES, kind by kind: gaps and matches are cut once and zipped."""
    out = F.col(text)

    def step(kind: str) -> Callable[[Column], Column]:
        def one(t: Column) -> Column:
            found = F.transform(F.regexp_extract_all(t, F.lit(patterns[kind]), F.lit(0)), lambda m: MODES[mode](kind, m))
            return F.array_join(F.flatten(F.zip_with(F.split(t, patterns[kind], -1), found, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")

        return one

    for kind in KINDS:
        out = F.element_at(F.transform(F.array(out), step(kind)), 1)  # a variable, so that each kind reads the text once
    return out


def priority_pack(sections: DataFrame, group: str, budget: int) -> DataFrame:
    """group, left, kept: required sections always, then by priority those that still fit what is left of the budget.

    sections: group, seq, priority, required, cost. kept holds required ones by seq, then the others as taken; ties of
    priority go to the smaller seq. A fold over the sections of one context, which are few.
    """
    rows = sections.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((~F.col("required")).alias("later"), F.when(F.col("required"), 0).otherwise(-F.col("priority")).alias("p"), "seq", F.col("cost").cast("long").alias("cost")))).alias("s"))
    spent = F.aggregate(F.filter("s", lambda x: ~x["later"]), F.lit(0).cast("long"), lambda a, x: a + x["cost"])
    first = F.transform(F.filter("s", lambda x: ~x["later"]), lambda x: x["seq"])
    start = F.struct(F.greatest(F.lit(budget).cast("long") - spent, F.lit(0).cast("long")).alias("left"), first.alias("kept"))
    step = lambda a, x: F.when(x["later"] & (x["cost"] <= a["left"]), F.struct((a["left"] - x["cost"]).alias("left"), F.array_append(a["kept"], x["seq"]).alias("kept"))).otherwise(a)
    return rows.select(group, F.aggregate("s", start, step).alias("r")).select(group, "r.left", "r.kept")


def fit_sections(sections: DataFrame, group: str, budget: int) -> DataFrame:
    """group, seq, required of what stays: sections leave by rising priority until the budget holds them.

    A required section leaves only while the whole is over 1.5 times the budget. Ties of priority go to the smaller seq.
    """
    rows = sections.groupBy(group).agg(F.sum(F.col("cost").cast("long")).alias("total"), F.array_sort(F.collect_list(F.struct("priority", "seq", "required", F.col("cost").cast("long").alias("cost")))).alias("s"))
    none = F.expr(f"cast(array() as array<{sections.schema['seq'].dataType.simpleString()}>)")
    limit = lambda x: F.when(x["required"], budget * 1.5).otherwise(float(budget))
    step = lambda a, x: F.when(a["now"] > limit(x), F.named_struct(F.lit("now"), a["now"] - x["cost"], F.lit("gone"), F.array_append(a["gone"], x["seq"]))).otherwise(a)
    gone = F.aggregate("s", F.named_struct(F.lit("now"), F.col("total"), F.lit("gone"), none), step, lambda a: a["gone"])
    return rows.select(group, F.explode("s").alias("x"), gone.alias("gone")).where(~F.array_contains("gone", F.col("x.seq"))).select(group, "x.seq", "x.required")


# Words of the conflict checks.
POSITIVE = ("likes", "loves", "prefers", "enjoys", "always", "wants", "favorite")
NEGATIVE = ("dislikes", "hates", "avoids", "never", "doesn't like", "doesn't want")
AFFIRMATIVE = ("is", "has", "does", "can", "will")
NEGATIONS = ("is not", "isn't", "has not", "hasn't", "does not", "doesn't", "cannot", "can't", "won't")


def conflicting(new: str, old: str, overlap: Column) -> Column:
    """Whether two texts (lower case) may contradict: opposite feelings, a negation or other numbers, about the same keywords."""
    has = lambda c, words: F.col(c).rlike("|".join(words))
    opposite = lambda a, b: (has(new, a) & has(old, b)) | (has(new, b) & has(old, a))
    numbers = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b[0-9]+\b"), F.lit(0))))
    differ = (F.size(numbers(new)) > 0) & (F.size(numbers(old)) > 0) & (numbers(new) != numbers(old))
    return (opposite(POSITIVE, NEGATIVE) & (overlap > 0.3)) | (opposite(AFFIRMATIVE, NEGATIONS) & (overlap > 0.4)) | (differ & (overlap > 0.5))


def consolidation_action(similarity: Column, overlap: Column, conflict: Column, duplicate: float = 0.98, merge: float = 0.88, keywords: float = 0.8) -> Column:
    """IGNORE a duplicate of the best match, MERGE a near one with its keywords unless it is a CONFLICT, else ADD."""
    near = (similarity >= merge) & (overlap >= keywords)
    return F.when(similarity >= duplicate, "IGNORE").when(near & conflict, "CONFLICT").when(near, "MERGE").otherwise("ADD")


def dependency_levels(edges: DataFrame, most: int = 64) -> DataFrame:
    """node, level: a node stands one level over the highest of those it depends on; ordering by level is a topological order.

    edges: node, needs. ValueError if a level beyond `most` is reached, as in a cycle.
    """
    nodes = edges.select("node").union(edges.select("needs")).distinct()
    level = nodes.join(edges.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(0))
    out, at = level, 0
    while not level.isEmpty():
        at += 1
        if at > most:
            raise ValueError("cyclic dependency")
        level = edges.join(level.select(F.col("node").alias("needs")), "needs").select("node").distinct().withColumn("level", F.lit(at))
        level = written(level)  # each step reads the one before, not all before it
        out = out.unionByName(level)
    found = out.groupBy("node").agg(F.max("level").alias("level"))
    if nodes.count() > found.count():
        raise ValueError("cyclic dependency")
    return found


def progressive_limit(hits: DataFrame, group: str, order: list[Column], sufficient: Column, need: int, first: int = 5, most: int = 40) -> DataFrame:
    """group, limit, enough: the limit doubles from first to most until its best hits hold `need` sufficient ones."""
    limits = [first]
    while limits[-1] < most:
        limits.append(min(limits[-1] * 2, most))
    ranked = hits.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most)
    counts = ranked.groupBy(group).agg(*[F.count_if(sufficient & (F.col("_n") <= k)).alias(f"_{k}") for k in limits])
    chosen = F.coalesce(*[F.when(F.col(f"_{k}") >= need, k) for k in limits], F.lit(most))
    return counts.select(group, chosen.alias("limit"), (F.col(f"_{most}") >= need).alias("enough"))
