"""Embedding near-dedup: coarse inverted lists, product-quantised residuals, table-lookup distances, exact cosine rerank."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm.common import bounded_sample, components, materialize, read

THRESHOLD = 0.93
#: Candidates whose exact cosine is computed at once.
RERANK = 1 << 15
#: Bound of the vectors that the quantisers are fitted on, lists, subspaces, codes a subspace, rows of a block.
SAMPLE_ROWS, LISTS, SUBSPACES, CODES, BLOCK = 20_000, 64, 8, 64, 1024


def _nearest(x: np.ndarray, centres: np.ndarray, batch: int = 8192) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(x[i : i + batch] @ centres.T - half).argmax(1) for i in range(0, len(x), batch)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class ProductQuantiser:
    """Coarse centres and codebooks of residual subspaces."""

    def __init__(self, sample: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 5):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.dim = x.shape[1]
        while self.dim % subspaces:
            subspaces -= 1
        self.subspaces, self.width = subspaces, self.dim // subspaces
        self.coarse = _kmeans(x, lists, seed)
        residual = x - self.coarse[_nearest(x, self.coarse)]
        self.books = [_kmeans(residual[:, s * self.width : (s + 1) * self.width], codes, seed + 1 + s) for s in range(subspaces)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = _nearest(x, self.coarse)
        residual = x - self.coarse[cells]
        codes = np.stack([_nearest(residual[:, s * self.width : (s + 1) * self.width], b) for s, b in enumerate(self.books)], 1)
        return cells, codes.astype(np.uint8)

    def probes(self, x: np.ndarray, threshold: float) -> list[np.ndarray]:
        """For each unit vector all lists that can hold a vector within the threshold.

        A vector in list c is at least as near to c as to the query's own centre, so it lies beyond the plane between the
        two; lists whose plane is farther away than the largest chord at the threshold cannot hold a link.
        """
        chord = np.sqrt(2 - 2 * threshold) + 1e-9
        near = _nearest(x, self.coarse)
        squares = ((self.coarse * self.coarse).sum(1)[None] - 2 * x @ self.coarse.T)
        between = np.linalg.norm(self.coarse[None] - self.coarse[near][:, None], axis=2)
        gap = (squares - squares[np.arange(len(x)), near][:, None]) / np.maximum(2 * between, 1e-12)
        within = gap <= chord
        within[np.arange(len(x)), near] = True
        return [np.flatnonzero(w) for w in within]

    def least(self, x: np.ndarray, cell: int, codes: np.ndarray, threshold: float) -> np.ndarray:
        """The smallest looked-up dot product with each coded vector that a query within the threshold can have.

        Such a query is c times the vector plus sqrt(1 - c^2) times a unit vector across it, c at least the threshold; the
        coded form has a part along the vector and a part across it, and the parts bound the product from below.
        """
        coded = self.coarse[cell] + np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], 1)
        along = np.einsum("nd,nd->n", x, coded)
        across = np.sqrt(np.maximum((coded * coded).sum(1) - along * along, 0))
        return np.where(along > 0, threshold * along - np.sqrt(1 - threshold * threshold) * across, -np.inf) - 1e-9

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Dot products of each query's subvectors with every code: queries x subspaces x codes."""
        return np.stack([q[:, s * self.width : (s + 1) * self.width] @ b.T for s, b in enumerate(self.books)], 1)


def usable():
    """Rows that can link: a label, and an embedding that is not null, holds only finite numbers and is not zero."""
    ok = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(ok & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors of equal label and length link when their cosine in double precision reaches the threshold. Exact copies stand
    behind one row with their number; of the others, each is probed against all lists that can hold a link, candidates come
    from table lookups, and every candidate is reranked by its exact cosine. Rows that cannot link keep themselves.
    Rows of one id, and rows without an id, count as vectors of their own: each has its own n_links; component_id is the
    smallest id of the component, null if none of its rows has one. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = rows.where(usable()).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # Written once, so that each distinct vector keeps its number.
    good = materialize(good.withColumn("rep", F.monotonically_increasing_id()))
    sample = bounded_sample(good.select("rep", "embedding"), SAMPLE_ROWS)
    by_length: dict[int, list] = {}
    for r in sorted(sample, key=lambda r: r["embedding"]):
        by_length.setdefault(len(r["embedding"]), []).append(r["embedding"])
    quantisers = {n: ProductQuantiser(np.array(v)) for n, v in by_length.items()}
    # Lengths that the sample lacks are compared in one list, still in blocks.
    found = spark.sparkContext.broadcast(quantisers)

    def placed(batches):
        for pdf in batches:
            out = []
            for n, part in pdf.groupby(pdf["embedding"].map(len)):
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                scale = np.abs(x).max(1, keepdims=True)
                u = x / scale
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                pq = found.value.get(n)
                cells, codes = pq.encode(u) if pq else (np.zeros(len(u), int), np.zeros((len(u), 1), np.uint8))
                probes = pq.probes(u, threshold) if pq else [np.zeros(1, int)] * len(u)
                out.append(pd.DataFrame({"rep": part["rep"].to_numpy(), "copies": part["copies"].to_numpy(), "label": part["label"].to_numpy(), "dim": n, "cell": cells, "probes": [p.tolist() for p in probes], "codes": [c.tobytes() for c in codes], "unit": [v.tolist() for v in u]}))
            if out:
                yield pd.concat(out)

    label = vectors.schema["label"].dataType.simpleString()
    shape = f"rep long, copies long, label {label}, dim int, cell int, probes array<int>, codes binary, unit array<double>"
    units = materialize(good.select("rep", "copies", "label", "embedding").mapInPandas(placed, shape))
    # Lists are cut into blocks; a list's blocks follow from its rows, so tasks stay of one size however common a list is.
    lists = units.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    key = ["label", "dim"]
    sliced = units.join(lists, [*key, "cell"]).withColumn("block", F.pmod(F.xxhash64("rep", "codes"), F.col("blocks")).cast("int"))
    sliced = materialize(sliced.drop("blocks"))
    # A block as base meets every block that probes its list; tasks are pairs of blocks (base list and block, own list and block).
    own = sliced.groupBy(*key, "cell", "block").agg(F.array_distinct(F.flatten(F.collect_set("probes"))).alias("lists"))
    asked = own.select(*key, F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.explode("lists").alias("cell"))
    tasks = asked.join(lists, [*key, "cell"]).select(*key, "q_cell", "q_block", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # Of two blocks that meet either way, one task looks at both directions.
    flip = F.struct("q_cell", "q_block") > F.struct("cell", "block")
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    tasks = tasks.select(*key, pick("q_cell", "cell").alias("a_cell"), pick("q_block", "block").alias("a_block"), pick("cell", "q_cell").alias("b_cell"), pick("block", "q_block").alias("b_block")).distinct()
    tasks = materialize(tasks)
    cols = [*key, "a_cell", "a_block", "b_cell", "b_block"]
    body = ["rep", "copies", "probes", "codes", "unit"]
    left = tasks.join(sliced.withColumnsRenamed({"cell": "a_cell", "block": "a_block"}), [*key, "a_cell", "a_block"]).select(*cols, F.lit(0).alias("side"), *body)
    same = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_block") == F.col("b_block"))
    right = tasks.where(~same).join(sliced.withColumnsRenamed({"cell": "b_cell", "block": "b_block"}), [*key, "b_cell", "b_block"]).select(*cols, F.lit(1).alias("side"), *body)

    def compare(pdf):
        first = pdf.iloc[0]
        pq = found.value.get(int(first["dim"]))
        a = pdf[pdf["side"] == 0]
        alone = first["a_cell"] == first["b_cell"] and first["a_block"] == first["b_block"]
        b = a if alone else pdf[pdf["side"] == 1]
        links, edges = _compare(pq, a, b, alone, int(first["a_cell"]), int(first["b_cell"]), threshold)
        return pd.DataFrame(links + edges, columns=["rep", "other", "links"])

    linked = materialize(left.unionByName(right).groupBy(*cols).applyInPandas(compare, "rep long, other long, links long"))
    counts = linked.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(linked.where("links = 0").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    reps = good.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    reps = materialize(reps.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component", "first"))
    least = reps.groupBy("component").agg(F.min("first").alias("component_id"))
    reps = reps.join(least, "component").select("label", "embedding", "n_links", "component_id")
    out = rows.where(usable()).join(reps, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(pq: ProductQuantiser | None, a, b, alone: bool, a_cell: int, b_cell: int, threshold: float):
    """(links, edges) of one pair of blocks: each vector's number of linked copies here, and a spanning forest of the links."""
    if not len(a) or not len(b):
        return [], []
    xa, xb = np.stack(a["unit"].to_numpy()), np.stack(b["unit"].to_numpy())
    if pq is None:
        maybe = np.ones((len(a), len(b)), bool)
    else:
        codes = np.stack([np.frombuffer(c, np.uint8) for c in b["codes"]])
        tables = pq.tables(xa)
        near = xa @ pq.coarse[b_cell]
        approx = np.repeat(near[:, None], len(b), 1)
        for s in range(pq.subspaces):
            approx += tables[:, s][:, codes[:, s]]
        maybe = approx >= pq.least(xb, b_cell, codes, threshold)[None]
        asks = np.array([b_cell in p for p in a["probes"]])
        asked = np.array([a_cell in p for p in b["probes"]])
        maybe &= asks[:, None] | asked[None]
    if alone:
        maybe = np.triu(maybe | maybe.T, 1)
    i, j = np.nonzero(maybe)
    exact = np.concatenate([np.einsum("nd,nd->n", xa[i[k : k + RERANK]], xb[j[k : k + RERANK]]) >= threshold for k in range(0, len(i), RERANK)] or [np.zeros(0, bool)])
    i, j = i[exact], j[exact]
    if not len(i):
        return [], []
    ida, idb = a["rep"].to_numpy(), b["rep"].to_numpy()
    na, nb = np.bincount(i, b["copies"].to_numpy()[j], len(a)), np.bincount(j, a["copies"].to_numpy()[i], len(b))
    links = [(ida[k], ida[k], int(na[k])) for k in np.flatnonzero(na)] + [(idb[k], idb[k], int(nb[k])) for k in np.flatnonzero(nb)]
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    edges = []
    shift = 0 if alone else len(a)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(x), root(y + shift)
        if p != q:
            parent[p] = q
            edges.append((ida[x], idb[y], 0))
    return links, edges


def op3_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings"))
