"""Sessions as ordered events: turns, tails, compaction windows, metrics, packing to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_turns(events: DataFrame) -> DataFrame:
    """events (session_id, seq, type) with turn: each user event starts one; events before the first user event are turn 0."""
    w = Window.partitionBy("session_id").orderBy("seq")
    users = F.sum(F.when(F.col("type") == "user", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return events.withColumn("turn", users - F.when(F.first("type").over(w) == "user", 1).otherwise(0))


def turn_slice(events: DataFrame, start: Column | int, end: Column | int) -> DataFrame:
    return number_turns(events).where((F.col("turn") >= start) & (F.col("turn") < end))


def last_turns(events: DataFrame, n: int) -> DataFrame:
    """Events from turn (user events of the whole session - n) on; a leading group without a user event counts as a turn of its own."""
    total = F.sum(F.when(F.col("type") == "user", 1).otherwise(0)).over(Window.partitionBy("session_id"))
    return number_turns(events.withColumn("_u", total)).where(F.col("turn") >= F.greatest(F.col("_u") - n, F.lit(0))).drop("_u")


def tail(events: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def keep_recent(events: DataFrame, n: int) -> DataFrame:
    """Sliding-window compaction: all system events and the last n others."""
    w = Window.partitionBy("session_id", F.col("type") == "system").orderBy(F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(w)).where((F.col("type") == "system") | (F.col("_n") <= n)).drop("_n")


def keep_important(events: DataFrame, n: int, importance: Column, least: float = 0.3) -> DataFrame:
    """The n // 2 last events, and of the others the most important that reach least, n events in all."""
    recent = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    rest = Window.partitionBy("session_id", F.col("_n") > n // 2).orderBy(F.desc("importance"), F.asc("seq"))
    ranked = events.withColumn("importance", F.round(importance, 6)).withColumn("_n", F.row_number().over(recent)).withColumn("_i", F.row_number().over(rest))
    return ranked.where((F.col("_n") <= n // 2) | ((F.col("_i") <= n - n // 2) & (F.col("importance") >= least))).drop("_n", "_i")


def sliding(events: DataFrame, size: int, stride: int) -> DataFrame:
    """start (0, stride, ...) and members of each window of size events; the last may be short; no stride means size."""
    stride = stride if stride > 0 else size
    w = Window.partitionBy("session_id").orderBy("seq")
    placed = events.withColumn("_p", F.row_number().over(w) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - size + 1) / stride)).cast("int")
    last = F.floor(F.col("_p") / stride).cast("int")
    return placed.withColumn("start", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("start", F.col("start") * stride).groupBy("session_id", "start").agg(F.array_sort(F.collect_list("seq")).alias("members"))


def batches(events: DataFrame, size: int) -> DataFrame:
    return events.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("session_id").orderBy("seq")) - 1) / size))


def budget_prefix(items: DataFrame, group: str, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Items of each group up to the first that no longer fits; the first item always stays."""
    w = Window.partitionBy(group).orderBy(*order)
    used = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return items.withColumn("used", used).withColumn("_n", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def budget_pack(items: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Greedy packing with skips: each item in order is taken if it still fits; kept holds the taken orders, left the rest of the budget.

    A fold over the group's ordered array; a group is one session or query, which its context limit bounds.
    """
    kept = F.expr(f"cast(array() as array<{items.schema[order].dataType.simpleString()}>)")
    start = F.struct(F.lit(budget).cast("long").alias("left"), kept.alias("kept"))
    step = lambda a, x: F.when(x["c"] <= a["left"], F.struct((a["left"] - x["c"]).alias("left"), F.array_append(a["kept"], x["o"]).alias("kept"))).otherwise(a)
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("items"))
    return rows.select(group, F.aggregate("items", start, step).alias("r")).select(group, "r.left", "r.kept")


def summary_fallback(events: DataFrame, parts: int = 5, width: int = 200) -> DataFrame:
    """Without a model: the first sentence (shorter than width) of the last user messages, joined."""
    first = F.trim(F.element_at(F.split("content", "[.!?]"), 1))
    said = events.where("type = 'user'").select("session_id", "seq", first.alias("s")).where((F.length("s") > 0) & (F.length("s") < width))
    lists = said.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "s"))).alias("a"))
    return lists.select("session_id", F.array_join(F.transform(F.slice("a", F.greatest(F.size("a") - parts + 1, F.lit(1)), parts), lambda x: x["s"]), "; ").alias("summary"))


def render(events: DataFrame) -> DataFrame:
    """Messages of each session in order: an array of (role, content) with agent as assistant."""
    role = F.when(F.col("type") == "agent", "assistant").otherwise(F.col("type"))
    rows = events.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", role.alias("role"), "content"))).alias("m"))
    return rows.select("session_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
