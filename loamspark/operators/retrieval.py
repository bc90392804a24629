"""Retrieval for many queries at once: keyword and vector top-k, fusion, merging, masking, reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamspark.functions import text as tx

#: Largest set of query vectors that one pass holds on every executor; larger sets run in several passes.
QUERY_BLOCK = 4096
#: Vectors scored at once, rows that wait to be merged with the best so far, and rows of a batch that leaves a task.
VECTOR_BLOCK, WAITING, OUT_ROWS = 256, 1 << 16, 10_000


def topk(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark drops later rows before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def keyword_scores(queries: DataFrame, docs: DataFrame, tokenizer=tx.tokens) -> DataFrame:
    """query_id, id, hits, score (hits by the query's tokens) for pairs of queries (query_id, text) and docs (id, text) that share a token.

    An equi-join on tokens: documents without any query token never leave their task.
    """
    q = queries.select("query_id", tokenizer("text").alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    d = docs.select("id", F.explode(tokenizer("text")).alias("token"))
    hits = d.join(q, "token").groupBy("query_id", "id", "n").agg(F.count("*").alias("hits"))
    return hits.select("query_id", "id", "hits", (F.col("hits") / F.col("n")).alias("score"))


def similar_topk(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", least: float = -np.inf, same_group: bool = False, drop_self: bool = False) -> DataFrame:
    """query_id, id, score of the k best vectors (id, embedding, group) for each query (query_id, embedding, group).

    Each task scores VECTOR_BLOCK vectors at once against the block of queries with one matrix product and keeps k a query,
    so its memory does not grow with its vectors and k times the queries leave it; scores are rounded to 6 places and ties go
    to the smaller id. A null group equals no group.
    """
    spark = vectors.sparkSession
    if same_group:
        queries, vectors = queries.where(F.col("group").isNotNull()), vectors.where(F.col("group").isNotNull())
    rows = queries.select("query_id", F.col("embedding").cast("array<double>"), *(["group"] if same_group else [])).orderBy("query_id").toLocalIterator()
    shape = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    parts: list[DataFrame] = []
    for block in _blocks(rows, QUERY_BLOCK):
        ids = np.array([r["query_id"] for r in block])
        matrix = np.array([r["embedding"] for r in block], float)
        groups = np.array([r["group"] for r in block]) if same_group else None
        shared = spark.sparkContext.broadcast((ids, matrix, groups))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, groups = shared.value
            best = Best(len(ids), k)
            for pdf in (p.iloc[at : at + VECTOR_BLOCK] for p in batches for at in range(0, len(p), VECTOR_BLOCK)):
                x = np.stack(pdf["embedding"].to_numpy()).astype(float)
                if metric == "l2":
                    s = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))
                else:
                    s = q @ x.T
                    if metric == "cosine":
                        scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
                        s = np.where(scale > 0, s / np.where(scale > 0, scale, 1), 0.0)
                s = np.round(s, 6) + 0.0
                ok = s >= least
                if same_group:
                    ok &= groups[:, None] == pdf["group"].to_numpy()[None]
                own = pdf["id"].to_numpy()
                if drop_self:
                    ok &= ids[:, None] != own[None]
                best.add(s, ok, own)
            best.merge()
            for at in range(0, len(best.query), OUT_ROWS):
                part = slice(at, at + OUT_ROWS)
                yield pd.DataFrame({"query_id": ids[best.query[part]], "id": best.ids[part], "score": best.score[part]})

        parts.append(vectors.select("id", "embedding", *(["group"] if same_group else [])).mapInPandas(score, shape))
    if not parts:
        return spark.createDataFrame([], shape)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return topk(out, ["query_id"], [F.desc("score"), F.asc("id")], k)


class Best:
    """The k best rows of each of n queries: the larger score, then the smaller id. Rows wait and are merged a good many at once."""

    def __init__(self, n: int, k: int):
        self.k, self.waiting, self.wait = k, [], 0
        self.query, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None
        #: Whether a query holds k rows, and the score and id of its last one.
        self.full, self.bar, self.last = np.zeros(n, bool), np.full(n, -np.inf), None

    def add(self, s: np.ndarray, ok: np.ndarray, own: np.ndarray) -> None:
        """Scores s (queries by rows of ids own) where ok."""
        maybe = ok & (s >= self.bar[:, None])
        if s.shape[1] > self.k and np.count_nonzero(maybe) > 2 * self.k * len(s):
            # No row below the block's own k-th score of a query can be among its k best.
            maybe &= s >= np.partition(np.where(ok, s, -np.inf), -self.k, axis=1)[:, -self.k, None]
        i, j = np.nonzero(maybe)
        if self.last is not None:
            fresh = ~self.full[i] | (s[i, j] > self.bar[i]) | (own[j] < self.last[i])
            i, j = i[fresh], j[fresh]
        if len(i):
            self.waiting.append((i, s[i, j], own[j]))
            self.wait += len(i)
        if self.wait >= WAITING:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        query, score, ids = (np.concatenate(x) for x in zip(*([(self.query, self.score, self.ids)] if self.ids is not None else []), *self.waiting, strict=True))
        self.waiting, self.wait = [], 0
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        at, kept = np.flatnonzero(rank == self.k - 1), rank < self.k
        if self.last is None:
            self.last = np.zeros(len(self.full), ids.dtype)
        self.full[query[at]], self.bar[query[at]], self.last[query[at]] = True, score[at], ids[at]
        self.query, self.score, self.ids = query[kept], score[kept], ids[kept]


def _blocks(rows, size: int):
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """query_id, id, rrf, rank from ranked lists (query_id, id, rank): sum of 1 / (k + rank); ties go to the smaller id."""
    every = lists[0].select("query_id", "id", "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select("query_id", "id", "rank"))
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"))
    return topk(fused, ["query_id"], [F.desc("rrf"), F.asc("id")], limit or (1 << 31) - 1)


def merge_sources(results: DataFrame, strategy: str, weights: dict[str, float] | None = None) -> DataFrame:
    """position of each row of results (query_id, source, id, score): by score, by source first, or interleaved round robin."""
    score = F.col("score")
    if weights:
        weight = F.lit(1.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, w).otherwise(weight)
        score = score * weight
    df = results.withColumn("score", score)
    best = [F.desc("score"), F.asc("source"), F.asc("id")]
    if strategy == "score_only":
        order = best
    else:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), F.asc("id"))))
        order = [F.asc("source"), F.asc("_r")] if strategy == "source_first" else [F.asc("_r"), F.asc("source")]
    return df.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("_r")


def prefer_own(own: DataFrame, shared: DataFrame, discount: float = 0.8) -> DataFrame:
    """Own results and discounted shared ones (query_id, id, score); of one id the own one stays."""
    both = own.withColumn("_p", F.lit(0)).unionByName(shared.withColumn("score", F.col("score") * discount).withColumn("_p", F.lit(1)))
    return topk(both, ["query_id", "id"], [F.asc("_p")], 1, "_n").drop("_n", "_p")


def mask_seen(results: DataFrame, seen: DataFrame) -> DataFrame:
    """results (query_id, id, ...) that seen (query_id, id) lacks."""
    return results.join(seen, ["query_id", "id"], "left_anti")


def rerank(results: DataFrame, boost: Column, k: int) -> DataFrame:
    """query_id's k best rows by score plus boost, clamped to 0 and 1."""
    return topk(results.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + boost)), 6)), ["query_id"], [F.desc("score"), F.asc("id")], k)


def limit_by_share(scored: DataFrame, share: float = 0.1, least: int = 8, most: int = 25) -> DataFrame:
    """Rows (query_id, id, score) of at least that share of the query's best score, but no fewer than least and no more than most."""
    w = Window.partitionBy("query_id")
    ranked = topk(scored, ["query_id"], [F.desc("score"), F.asc("id")], most).withColumn("_top", F.max("score").over(w))
    return ranked.where((F.col("score") >= F.col("_top") * share) | (F.col("rank") <= least)).drop("_top")


def diversify(results: DataFrame, k: int, diversity: float = 0.3) -> DataFrame:
    """query_id, id, mmr, position: greedy choice of relevance against the largest word overlap with what is chosen.

    results (query_id, id, score, content) hold the few candidates of each query; one query is one group.
    """
    kind = results.schema
    shape = f"query_id {kind['query_id'].dataType.simpleString()}, id {kind['id'].dataType.simpleString()}, mmr double, position int"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        sets = [frozenset((c or "").lower().split()) for c in pdf["content"]]
        scores, ids = pdf["score"].to_numpy(float), pdf["id"].to_numpy()
        nearest, left, out = np.zeros(len(pdf)), list(range(len(pdf))), []
        while left and len(out) < k:
            values = [(1 - diversity) * scores[i] - diversity * nearest[i] for i in left]
            best = left.pop(int(np.argmax(values)))
            out.append((pdf["query_id"].iloc[0], ids[best], round(float(max(values)), 6), len(out) + 1))
            for i in left:
                union = sets[i] | sets[best]
                nearest[i] = max(nearest[i], len(sets[i] & sets[best]) / len(union) if union else 0.0)
        return pd.DataFrame(out, columns=["query_id", "id", "mmr", "position"])

    return results.groupBy("query_id").applyInPandas(choose, shape)
