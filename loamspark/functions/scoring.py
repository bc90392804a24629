"""Column functions that score and blend: recency, salience, effectiveness, boosts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def age_days(ts, as_of) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(86_400_000_000.0)


def recency(ts, as_of, half_life: float = 7.0) -> Column:
    """1 now, halved every half_life days, 0 to 1."""
    return clamp(F.exp(-F.lit(math.log(2) / half_life) * age_days(ts, as_of)))


def salience(similarity, accesses, accessed, as_of, half_life: float = 30.0) -> Column:
    """Similarity times log accesses times decay since the last one; never accessed decays nothing, no access gives 0."""
    decay = F.when(accessed.isNull(), 1.0).otherwise(F.exp(-0.693 * age_days(accessed, as_of) / half_life))
    return similarity * F.ln(accesses + 1) * decay


def blend(first, second, weight: float = 0.7) -> Column:
    return clamp(first * weight + second * round(1 - weight, 6))


def recency_boost(ts, as_of, most: float = 0.2, days: float = 30.0) -> Column:
    return F.greatest(F.lit(0.0), most * (1 - age_days(ts, as_of) / days))


def effectiveness(helpful, harmful) -> Column:
    """Share of helpful uses; one half if unused."""
    return F.when(helpful + harmful > 0, helpful / (helpful + harmful)).otherwise(0.5)


def effectiveness_boost(helpful, harmful, least_usage: int = 3) -> Column:
    usage = helpful + harmful
    return F.when(usage >= least_usage, clamp(0.1 * (helpful - 2.0 * harmful) / (usage + 1), -0.3, 0.3)).otherwise(0.0)


def position_score(rank, step: float = 0.1) -> Column:
    """1 for the first, less by step for each place after it, 0.1 at least."""
    return F.greatest(F.lit(0.1), 1.0 - step * (rank - 1))
