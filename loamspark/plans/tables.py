"""Readers of the registered queries' tables, and views of them as domain records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories: id, user_id, content, kind, confidence, is_active."""
    labels = read(spark, sf_dir, "labels")
    return (
        read(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("user_id"),
            F.col("text").alias("content"),
            F.col("lang").alias("kind"),
            F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("confidence"),
            (F.coalesce("toxic", F.lit(0)) == 0).alias("is_active"),
        )
    )


#: The same as a DuckDB common table expression.
MEMORIES = """memories AS (SELECT d.doc_id AS id, d.source AS user_id, d.text AS content, d.lang AS kind,
  coalesce(l.quality::double, 0.5) AS confidence, coalesce(l.toxic, 0) = 0 AS is_active
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as events: session_id, seq, type, content."""
    kind = F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), kind.alias("type"), F.col("text").alias("content"))


EVENTS = "ev AS (SELECT conv_id AS session_id, turn AS seq, CASE WHEN role = 'assistant' THEN 'agent' ELSE role END AS type, text AS content FROM conversations)"


#: Openings of questions, put before turns in order, so that classifiers of questions have something to find.
OPENINGS = ("what is the ", "how do i find ", "please fix the ", "compare ", "", "explain ", "show me an example of ")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with an opening of a question before the text: conv_id, turn, role, text."""
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.pmod("turn", F.lit(len(OPENINGS))) + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(opening, "text").alias("text"))


ASKED = "asked AS (SELECT conv_id, turn, role, ([" + ", ".join(f"'{x}'" for x in OPENINGS) + f"])[turn % {len(OPENINGS)} + 1] || text AS text FROM conversations)"
