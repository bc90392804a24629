"""Column functions of skills, sections and evolving preferences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grades of an evaluation, and the weights of its five dimensions.
GRADES = {"good": 1.0, "average": 0.5, "poor": 0.0}
WEIGHTS = (0.25, 0.25, 0.2, 0.15, 0.15)


def trigger_score(words: Column, text: Column, trigger: str) -> Column:
    """How well a lower-case text (and its distinct words) calls for a trigger: 0 to 0.9."""
    own = sorted(set(trigger.split()))
    share = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in own]))) / F.lit(len(own))
    inside = F.least(F.lit(0.9), 0.6 + 0.3 * F.lit(len(trigger)) / F.length(text))
    return F.when(F.contains(text, F.lit(trigger)), inside).when(share >= 0.5, 0.5 + 0.2 * share).otherwise(F.lit(0.0))


def best_trigger(text: Column, catalog: dict[str, str]) -> Column:
    """(score, skill) of the best trigger of a small catalog of skills, ties to the later name; one pass, no join."""
    low = F.lower(text)
    words = F.array_distinct(F.split(low, r"\s+"))
    return F.array_max(F.array(*[F.struct(F.round(trigger_score(words, low, t), 6).alias("score"), F.lit(s).alias("skill")) for s, t in catalog.items()]))


def trigger_confidence(trigger: Column, asked: Column) -> Column:
    t, a = F.lower(trigger), F.lower(asked)
    return F.when(t == a, 1.0).when(F.startswith(t, a) | F.endswith(t, a), 0.9).otherwise(0.7)


def evaluation_score(*grades: Column) -> Column:
    """Weighted mean of five grades, of four places; an unknown grade counts as poor."""
    value = lambda g: F.coalesce(*[F.when(g == k, v) for k, v in GRADES.items()], F.lit(0.0))
    return F.round(sum((value(g) * w for g, w in zip(grades, WEIGHTS, strict=True)), F.lit(0.0)), 4)


def lint(name: Column, description: Column, least: int = 20) -> Column:
    """Findings of a skill's name and description, in this order; empty where it is sound."""
    checks = (("name-format", ~F.rlike(name, F.lit("^[a-z0-9]+(-[a-z0-9]+)*$"))), ("no-description", F.trim(description) == ""), ("short-description", F.length(description) < least))
    return F.array_compact(F.array(*[F.when(found, F.lit(label)) for label, found in checks]))
