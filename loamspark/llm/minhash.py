"""Near-dedup of documents: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamspark.llm.common import components, likely, materialize, read, salted_pairs, scramble, shingles, with_arrow_columns, word_hashes

SIMILARITY = 0.8
BANDS, ROWS = 10, 2
#: Slots of the document-frequency table (fixed: four bytes each, whatever the corpus), values in one of its rows.
SLOTS, SLICE = 1 << 20, 1 << 14
#: Members that one verification group holds; members and characters that a block of a band holds; columns multiplied at once.
GROUP, BLOCK, BLOCK_CHARS, COLUMNS = 64, 512, 4_000_000, 4096
POOL = 1 << 16


@functools.cache
def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws of consistent weighted sampling: r (gamma 2, 1), beta (uniform) and the logarithm of c (gamma 2, 1)."""
    rng = np.random.default_rng(11)
    r = rng.gamma(2, 1, POOL).astype(np.float32)
    return np.maximum(r, 1e-6), rng.random(POOL).astype(np.float32), np.log(np.maximum(rng.gamma(2, 1, POOL), 1e-12)).astype(np.float32)


_ODD = scramble(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One value for each of BANDS x ROWS hashes: the sampled shingle and its quantised log weight (improved scheme).

    keys are distinct and sorted. Each shingle's draws come from a pool by a hash of it, so all documents see the same ones.
    """
    r_pool, beta_pool, c_pool = _pool()
    logs = np.log(weights).astype(np.float32)
    best = np.full(len(_ODD), np.inf, np.float32)
    key, step = np.zeros(len(_ODD), np.uint64), np.zeros(len(_ODD), np.int64)
    rows = np.arange(len(_ODD))
    for at in range(0, len(keys), 4096):
        part = keys[at : at + 4096]
        draw = ((part[None] * _ODD[:, None]) >> np.uint64(48)).astype(np.intp)
        r, beta = r_pool[draw], beta_pool[draw]
        t = np.floor(logs[None, at : at + 4096] / r + beta)
        a = c_pool[draw] - r * (t - beta) - r
        k = a.argmin(1)
        value = a[rows, k]
        better = value < best
        best[better], key[better], step[better] = value[better], part[k[better]], t[rows, k][better].astype(np.int64)
    return scramble(key ^ scramble(step.view(np.uint64)))


def features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (sorted) and their weights: occurrences times inverse document frequency."""
    keys, tf = np.unique(shingles(text), return_counts=True)
    return keys, tf * idf[(keys & np.uint64(SLOTS - 1)).astype(np.intp)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    return float(common / (a[1].sum() + b[1].sum() - common))


def idf_table(docs: DataFrame) -> np.ndarray:
    """The weight of each of SLOTS slots of shingles, from the documents of all texts (text) in which the slot occurs.

    Frequencies are counted over every document; shingles share slots by hash, so the table has one size at any scale.
    The weight runs from 1 (in every document) to 1.25 (in one): near copies in large groups share shingles that many
    documents hold, and a steeper weight would let the few edited ones outweigh them.
    """

    def count(batches):
        table, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                slots = np.unique(shingles(text) & np.uint64(SLOTS - 1)).astype(np.intp)
                table[slots] += 1
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(SLOTS // SLICE)], pa.int32()), pa.array([n] + [0] * (SLOTS // SLICE), pa.int64()), pa.array([b""] + [zlib.compress(table[i : i + SLICE].tobytes(), 1) for i in range(0, SLOTS, SLICE)], pa.binary())],
            names=["slice", "n", "counts"],
        )

    def add(pdf):
        total = np.zeros(SLICE, np.int64)
        for raw in pdf["counts"]:
            if raw:
                total += np.frombuffer(zlib.decompress(raw), np.int64)
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "n": [int(pdf["n"].sum())], "counts": [total.tobytes()]})

    shape = "slice int, n long, counts binary"
    partial = docs.select("text").mapInArrow(count, shape)
    # Tables of many tasks meet in two steps, so no task adds up all of them.
    half = partial.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("slice", "part").applyInPandas(add, shape)
    half = half.select("slice", "n", "counts").groupBy("slice").applyInPandas(_add_raw, shape)
    table, n = np.zeros(SLOTS, np.int64), 0
    for row in half.collect():  # SLOTS values at most
        if row["slice"] < 0:
            n = row["n"]
        else:
            table[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], np.int64)
    return (1 + 0.25 * np.clip(np.log((n + 1) / (table + 1)) / np.log(n + 2), 0, 1)).astype(np.float32)


def _add_raw(pdf):
    total = np.zeros(SLICE, np.int64)
    for raw in pdf["counts"]:
        total += np.frombuffer(raw, np.int64)
    return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "n": [int(pdf["n"].sum())], "counts": [total.tobytes()]})


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the document's class), n_copies (documents in its exact class), kept, for every row of docs (doc_id, text).

    Documents with the same words in the same order are one exact class. Of each exact class one document is signed;
    documents that share a band are compared with the band's centre by weighted Jaccard similarity, those that fail meet
    all others of their bands block by block, and classes are the components of the links found. Null texts and texts without words link with
    nothing and keep themselves. Rows that repeat a doc_id with another text are compared by its smallest text. Columns
    beside doc_id and text are ignored.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(docs))

    def make():
        def bands(text):
            keys, weights = features(text, idf.value)
            if not len(keys):
                return None
            s = signature(keys, weights).reshape(BANDS, ROWS)
            return scramble(s[:, 0] ^ (scramble(s[:, 1] + np.uint64(1)) + np.arange(BANDS, dtype=np.uint64))).view(np.int64).tolist()

        return lambda values: [[_fingerprint(x) for x in values], [bands(x) for x in values]]

    fields = [T.StructField("words", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    signed = materialize(with_arrow_columns(docs.select("doc_id", "text"), "text", fields, make).select("doc_id", "words", "bands"))
    reps = materialize(signed.where("words is not null").groupBy("words").agg(F.min(F.struct("doc_id", "bands")).alias("r"), F.count("*").alias("n_copies")))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    keyed = materialize(reps.groupBy(F.col("r.doc_id").alias("id")).agg(F.min(F.struct("words", "r.bands"))["bands"].alias("bands")).select("id", F.explode(F.array_distinct("bands")).alias("band")))
    reps = reps.select("words", F.col("r.doc_id").alias("rep"), "n_copies")
    # Texts are gathered once, for all that share a band with another; a merge join, so that the plan is the same at any size.
    crowded = materialize(keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    wanted = materialize(keyed.join(crowded, "band", "left_semi").select("id").distinct())
    needed = materialize(likely(texts, "id", wanted).join(wanted.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    keyed = materialize(keyed.join(crowded, "band", "left_semi"))
    # The smallest id of a band is its centre, which meets every other member.
    centres = keyed.groupBy("band").agg(F.min("id").alias("centre"))
    met = materialize(keyed.join(centres, "band").where("id != centre").select("band", "id", "centre"))

    def verify(centre, members):
        a = features(centre["text"], idf.value)
        return [(m["member"], m["centre"], s) for m in members if (s := weighted_jaccard(a, features(m["text"], idf.value))) >= similarity]

    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = materialize(met.select(F.col("id").alias("member"), "centre").distinct())
    found = materialize(salted_pairs(pairs, needed, GROUP, verify, f"a {kind}, b {kind}, similarity double"))
    taken = found.select(F.col("a").alias("id"), F.col("b").alias("centre"), F.lit(False).alias("open"))
    met = met.join(taken, ["id", "centre"], "left").select("band", "id", F.coalesce("open", F.lit(True)).alias("open"))
    links = found.unionByName(block_links(materialize(met), needed, idf, similarity, kind))
    joined = components(links.select("a", "b"))
    classes = reps.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("words", F.coalesce("component", "rep").alias("class_id"), "n_copies")
    out = signed.where("words is not null").join(classes, "words").select("doc_id", "class_id", "n_copies")
    rest = signed.where("words is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def block_links(met: DataFrame, texts: DataFrame, idf, similarity: float, kind: str) -> DataFrame:
    """Links (a, b, similarity) that join all members of a band which are similar, where a member is still open.

    met: band, id, open (not linked with the band's centre), without the centre itself; texts: id, text. Open members are dealt
    into blocks of bounded size, linked ones into others, and every pair of blocks with an open one is compared in a task of
    its own, so no pair with an open member is left out and no task grows with a band. Of the links in a pair of blocks a
    spanning forest is returned. Bands of the same members are compared once.
    """
    sums = [F.sum(F.xxhash64(F.lit(n), "id", "open").cast("decimal(38,0)")).alias(f"sum{n}") for n in (1, 2)]
    bands = met.groupBy("band").agg(F.count("*").alias("n"), F.count_if("open").alias("n_open"), *sums).where("n > 1 and n_open > 0")
    bands = materialize(bands.groupBy("n", "n_open", "sum1", "sum2").agg(F.min("band").alias("band")).select("band"))
    rest = materialize(met.join(bands, "band").join(texts.select("id", F.length("text").alias("chars")), "id"))
    blocks = lambda n, c: F.greatest(F.ceil(n / BLOCK), F.ceil(c / BLOCK_CHARS)).cast("int")
    mine = lambda x: F.when(F.col("open"), x)
    other = lambda x: F.when(~F.col("open"), x)
    counts = rest.groupBy("band").agg(
        blocks(F.count(mine(F.lit(1))), F.sum(mine(F.col("chars")))).alias("p"),
        F.coalesce(blocks(F.count(other(F.lit(1))), F.sum(other(F.col("chars")))), F.lit(0)).alias("q"),
    )
    dealt = rest.join(counts, "band").withColumn("block", F.when(F.col("open"), F.pmod(F.xxhash64("id"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("id"), F.greatest("q", F.lit(1)))))
    last = F.when(F.col("open"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1
    dealt = dealt.select("id", "band", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    cells = dealt.select("id", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).join(texts, "id")
    rows = cells.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "id")
    arrow = to_arrow_schema(T._parse_datatype_string(f"a {kind}, b {kind}, similarity double"))

    def run(batches):
        at, ids, units = None, [], []

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["band"], row["lo"], row["hi"])
                if here != at:
                    if found := spanning_links(ids, units, similarity):
                        yield made()
                    at, ids, units = here, [], []
                ids.append(row["id"])
                units.append(unit_features(row["text"], idf.value))
        if found := spanning_links(ids, units, similarity):
            yield made()

    return rows.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def unit_features(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One column for each occurrence of a shingle (the first, the second, ...) and its weight, so that common weight is a dot product."""
    keys, tf = np.unique(shingles(text), return_counts=True)
    nth = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    weights = np.repeat(idf[(keys & np.uint64(SLOTS - 1)).astype(np.intp)], tf)
    return np.repeat(keys, tf) + scramble(nth.astype(np.uint64)), weights


def spanning_links(ids: list, units: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple]:
    """(a, b, weighted Jaccard) of enough links to connect all ids whose links (at least similarity) connect them."""
    n = len(ids)
    if n < 2:
        return []
    sizes = [len(c) for c, _ in units]
    columns, weights, owners = np.concatenate([c for c, _ in units]), np.concatenate([w for _, w in units]), np.repeat(np.arange(n), sizes)
    totals = np.bincount(owners, weights, n)
    _, first, column, count = np.unique(columns, return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column, weight = place[column], weights[first[shared]].astype(float)
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    owners, column = owners[order], column[order]
    common = np.zeros((n, n))
    for at in range(0, len(shared), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, min(COLUMNS, len(shared) - at)))
        part[owners[lo:hi], column[lo:hi] - at] = 1
        common += (part * weight[at : at + COLUMNS]) @ part.T
    union = totals[:, None] + totals[None] - common
    score = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
    out, fresh = [], np.ones(n, bool)
    for start in range(n):
        stack = [start] if fresh[start] else []
        fresh[start] = False
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(fresh & (score[i] >= similarity)).tolist():
                fresh[j] = False
                stack.append(j)
                out.append((ids[i], ids[j], float(score[i, j])))
    return out


def _fingerprint(text: str | None) -> str | None:
    words = word_hashes(text)
    return xxhash.xxh3_128_hexdigest(words.tobytes()) if len(words) else None


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near duplicates: one row of its smallest doc_id; rows without words all stay.

    Rows without a doc_id stay; of the rows of one id one with the smallest text stays; other columns, whatever their names,
    pass through; an empty table stays empty.
    """
    kept = near_duplicates(docs, similarity).where("kept").select("doc_id").distinct()
    words = F.coalesce(F.regexp_like("text", F.lit(r"[^\s]")), F.lit(False))
    rows = docs.select("doc_id", "text", words.alias("words"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    firsts = rows.where("words").join(kept, "doc_id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("n = 1")
    loose = rows.where(F.col("doc_id").isNull() | ~F.col("words"))
    return firsts.select("doc").unionByName(loose.select("doc")).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
