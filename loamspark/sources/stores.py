"""Stores as tables: filters, vector namespaces, versioned sessions, JSON and parquet documents, HTML and frontmatter sources."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.operators.knowledge import guarded_merge, merge_keyed

OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(*v),
    "nin": lambda c, v: ~c.isin(*v),
    "contains": lambda c, v: F.array_contains(c, v),
}


def compile_filters(filters: list[tuple[str, str, object]]) -> Column:
    """One predicate of (field, operator, value), all of which must hold; an unknown operator means equality."""
    out = F.lit(True)
    for field, operator, value in filters:
        out = out & OPERATORS.get(operator, OPERATORS["eq"])(F.col(field), value)
    return out


def any_tag(tags: str, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(w.lower()) for w in wanted]))


def every_tag(tags: str, wanted: list[str]) -> Column:
    return F.size(F.array_intersect(F.transform(tags, F.lower), F.array(*[F.lit(w.lower()) for w in wanted]))) == len(set(map(str.lower, wanted)))


def not_expired(as_of: Column, column: str = "expires_at") -> Column:
    return F.col(column).isNull() | (as_of <= F.col(column))


class Table:
    """A keyed table in a folder: reads, upserts, versioned saves and deletes, each written as a new generation.

    A table opened on a folder starts from its newest whole generation. A generation that another writer has begun or
    written meanwhile is an error, not overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], version: str):
        self.spark, self.path, self.schema, self.key, self.version = spark, path.rstrip("/"), schema, key, version
        self.generation = self._newest()

    def _newest(self) -> int:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        names = [x.getPath().getName() for x in files.listStatus(folder)]
        whole = [int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(whole, default=0)

    def read(self) -> DataFrame:
        if not self.generation:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/g{self.generation}")

    def _write(self, df: DataFrame) -> None:
        df.write.mode("error").parquet(f"{self.path}/g{self.generation + 1}")
        self.generation += 1

    def upsert(self, changes: DataFrame) -> None:
        self._write(merge_keyed(self.read(), changes, self.key, self.version))

    def save(self, changes: DataFrame) -> DataFrame:
        """Versioned save; returns the rejected rows, whose stored version is higher (written beside the new generation)."""
        merged, rejected = guarded_merge(self.read(), changes, self.key, self.version)
        beside = f"{self.path}/rejected{self.generation + 1}"
        rejected.write.mode("overwrite").parquet(beside)
        self._write(merged)
        return self.spark.read.schema(rejected.schema).parquet(beside)

    def delete(self, ids: DataFrame) -> None:
        self._write(self.read().join(ids, self.key, "left_anti"))

    def page(self, order: list[Column], offset: int, limit: int) -> DataFrame:
        return self.read().orderBy(*order).offset(offset).limit(limit)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in parts by a numeric column, filters and columns pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


def read_frontmatter(spark: SparkSession, path: str) -> DataFrame:
    """path, fields (map), body of Markdown files that may start with simple 'key: value' lines between '---' lines."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    return raw.select("path", F.map_from_entries(pairs).alias("fields"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


def code_symbols(code: DataFrame) -> DataFrame:
    """id, kind, name of classes and functions in sources (id, language, text)."""
    shape = f"id {code.schema['id'].dataType.simpleString()}, kind string, name string"
    rules = {
        "python": (("class", r"^\s*class\s+(\w+)"), ("function", r"^\s*(?:async\s+)?def\s+(\w+)")),
        "javascript": (("class", r"\bclass\s+(\w+)"), ("function", r"\bfunction\s+(\w+)")),
        "java": (("class", r"\b(?:class|interface|enum)\s+(\w+)"), ("function", r"\b\w+\s+(\w+)\s*\([^)]*\)\s*\{")),
        "go": (("class", r"\btype\s+(\w+)\s+struct"), ("function", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)")),
        "rust": (("class", r"\b(?:struct|enum|trait)\s+(\w+)"), ("function", r"\bfn\s+(\w+)")),
    }

    def run(batches):
        for pdf in batches:
            rows = [(i, kind, m[1]) for i, lang, text in zip(pdf["id"], pdf["language"], pdf["text"], strict=True) for kind, p in rules.get(lang, ()) for m in re.finditer(p, text or "", re.M)]
            yield pd.DataFrame(rows, columns=["id", "kind", "name"])

    return code.select("id", "language", "text").mapInPandas(run, shape)
