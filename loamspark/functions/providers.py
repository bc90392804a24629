"""Hooks for models: text to text, text to vector and text to token count, as vectorised UDFs, with deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_model(client: Callable[[], Callable[[list[str]], list[str]]]):
    """A column function that calls a model once per Arrow batch; client() opens one connection per task."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = client()
        for batch in batches:
            yield pd.Series(ask(batch.fillna("").tolist()))

    return call


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """A unit vector from signed hashes of tokens: stable across runs and machines, inside the JVM."""
    slots = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).cast("int").alias("i"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(slots, F.lit(0.0), lambda a, x: a + F.when(x["i"] == i, x["s"]).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(raw, lambda x: x / norm)).otherwise(raw)


def embedding_model(client: Callable[[], Callable[[list[str]], np.ndarray]]):
    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = client()
        for batch in batches:
            yield pd.Series(list(np.asarray(embed(batch.fillna("").tolist()), np.float32)))

    return call
