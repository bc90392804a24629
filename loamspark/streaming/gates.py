"""Stateful operators on event streams: rate limiters, novelty gate, incremental index, session and audit helpers.

Each state machine is a plain function of (state, rows), used by the stream (applyInPandasWithState) and by the batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(state: tuple, rows: pd.DataFrame, rate: float, capacity: float) -> tuple[tuple, list[bool]]:
    """state (tokens, last time) or (): tokens refill by event time up to capacity; each allowed row takes one."""
    tokens, last = state if state else (float(capacity), None)
    out = []
    for t in rows["t"]:
        tokens = tokens if last is None else min(float(capacity), tokens + max(0.0, t - last) * rate)
        last = t if last is None else max(last, t)
        out.append(tokens >= 1)
        tokens -= 1.0 if out[-1] else 0.0
    return (tokens, last), out


def sliding_log(state: tuple, rows: pd.DataFrame, limit: int, seconds: float) -> tuple[tuple, list[bool]]:
    """state: times of allowed rows; a row is allowed while fewer than limit of them lie in the last seconds."""
    log, out = list(state), []
    for t in rows["t"]:
        log = [x for x in log if x > t - seconds]
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return tuple(log), out


def fixed_window(state: tuple, rows: pd.DataFrame, limit: int, seconds: float) -> tuple[tuple, list[bool]]:
    """state (window start, count): windows start at a key's first row after the last one ended."""
    start, n = state if state else (None, 0.0)
    out = []
    for t in rows["t"]:
        if start is None or t >= start + seconds:
            start, n = t, 0.0
        out.append(n < limit)
        n += 1.0 if out[-1] else 0.0
    return (start, n), out


def _limited(df: DataFrame, machine: Callable, stream: bool) -> DataFrame:
    schema = "key long, id long, t double, allowed boolean"

    def run(pdf: pd.DataFrame, state: tuple) -> tuple[tuple, pd.DataFrame]:
        pdf = pdf.sort_values(["t", "id"])
        state, allowed = machine(state, pdf)
        return state, pdf[["key", "id", "t"]].assign(allowed=allowed)

    if not stream:
        return df.select("key", "id", "t").groupBy("key").applyInPandas(lambda pdf: run(pdf, ())[1], schema)

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            state, out = run(pd.concat(parts), tuple(held.get[0]) if held.exists else ())
            held.update((list(map(float, state)),))
            yield out

    return df.select("key", "id", "t").groupBy("key").applyInPandasWithState(step, schema, "values array<double>", "append", GroupStateTimeout.NoTimeout)


def rate_limit(df: DataFrame, kind: str, stream: bool = False, **options) -> DataFrame:
    """allowed for each row of df (key, id, t in seconds): kind token_bucket (rate, capacity), sliding_log or fixed_window (limit, seconds)."""
    machine = {"token_bucket": token_bucket, "sliding_log": sliding_log, "fixed_window": fixed_window}[kind]
    return _limited(df, lambda state, rows: machine(state, rows, **options), stream)


def novel(held: np.ndarray, x: np.ndarray, texts: list[str], window: int = 20, threshold: float = 0.92, least: int = 20) -> tuple[np.ndarray, list[bool]]:
    """Accepts a text of at least `least` characters whose unit vector is less than threshold near the last accepted ones."""
    out = []
    for v, text in zip(x, texts, strict=True):
        v = v / max(float(np.linalg.norm(v)), 1e-12)
        ok = len(text or "") >= least and (not len(held) or float((held @ v).max()) < threshold)
        out.append(ok)
        if ok:
            held = np.concatenate([held, v[None]])[-window:] if len(held) else v[None]
    return held, out


def novelty_gate(df: DataFrame, stream: bool = False, **options) -> DataFrame:
    """accepted for each row of df (key, id, text, embedding), in order of id within its key."""
    schema = "key long, id long, accepted boolean"

    def run(pdf: pd.DataFrame, held: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        pdf = pdf.sort_values("id")
        held, accepted = novel(held, np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["text"].tolist(), **options)
        return held, pdf[["key", "id"]].assign(accepted=accepted)

    rows = df.select("key", "id", "text", "embedding")
    if not stream:
        return rows.groupBy("key").applyInPandas(lambda pdf: run(pdf, np.zeros((0, 0)))[1], schema)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            pdf = pd.concat(parts)
            width = len(pdf["embedding"].iloc[0])
            held = np.array(state.get[0], float).reshape(-1, width) if state.exists else np.zeros((0, width))
            held, out = run(pdf, held)
            state.update((held.ravel().tolist(),))
            yield out

    return rows.groupBy("key").applyInPandasWithState(step, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts of events (ts, user_id, event_type) with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def incremental_index(events: DataFrame) -> DataFrame:
    """Running counts and times by entity and action; as a stream in update mode."""
    return events.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of an id once, as long as repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
