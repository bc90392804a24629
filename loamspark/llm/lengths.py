"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.llm.bpe import encoder, vocabulary_path
from loamspark.llm.common import materialize, read, with_arrow_columns

BLOCK = 1024


def token_lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_tokens, the encoded length of each whole text (null: 0)."""

    def make():
        count = encoder(vocabulary_path(path)).count
        return lambda texts: [[count(x) for x in texts]]

    return with_arrow_columns(docs, text, [T.StructField("n_tokens", T.LongType())], make)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct n_tokens: docs of that length and, from suffix sums, what a context limit of n_tokens gives.

    n_docs, docs_above (longer ones), tokens_above (their tokens), docs_at_most, tokens_at_most (tokens of documents that fit),
    truncated_total (tokens left when every document is cut at n_tokens), all_docs and all_tokens.
    Suffix sums run within blocks of 1024 lengths and over the blocks' totals, so no task holds more than either.
    No rows give no rows; repeated rows count each; a null length counts as 0.
    """
    counts = lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    # Written once: the encoding behind it must not run for the blocks' totals and again for the rows.
    counts = materialize(counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("b_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("l_docs"),
        F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("l_tokens"),
        F.sum("b_docs").over(every).alias("all_docs"),
        F.sum("b_tokens").over(every).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("l_docs") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))).alias("docs_above"),
        (F.col("l_tokens") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0))).alias("tokens_above"),
        "all_docs",
        "all_tokens",
    )
    return out.select(
        "*",
        (F.col("all_docs") - F.col("docs_above")).alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_above")).alias("tokens_at_most"),
        (F.col("all_tokens") - F.col("tokens_above") + F.col("docs_above") * F.col("n_tokens")).alias("truncated_total"),
    )


def limit_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row with an array of structs (max_tokens, docs_that_fit, tokens_that_fit, truncated_total), exact for any listed limit."""

    def of(limit: int):
        fit = F.when(F.col("n_tokens") <= limit, F.struct("docs_at_most", "tokens_at_most"))
        docs, tokens = F.coalesce(F.max(fit)["docs_at_most"], F.lit(0)), F.coalesce(F.max(fit)["tokens_at_most"], F.lit(0))
        cut = (F.coalesce(F.max("all_docs"), F.lit(0)) - docs) * F.lit(limit)
        return F.struct(F.lit(limit).cast("long").alias("max_tokens"), docs.alias("docs_that_fit"), tokens.alias("tokens_that_fit"), (tokens + cut).alias("truncated_total"))

    return histogram.agg(F.array(*map(of, limits)).alias("totals"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length such that at least that share of documents is no longer."""
    return histogram.where(F.col("docs_at_most") >= F.lit(share) * F.col("all_docs")).agg(F.min("n_tokens").alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(read(spark, sf_dir, "documents").select("doc_id", "text")).select("n_tokens"))
