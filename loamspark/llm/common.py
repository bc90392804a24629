"""Shared pieces: the shared folder, Arrow column mapping, word shingles, verification groups and components."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SHINGLE = 5
#: Rows and bytes of a column that are worked on at once, and bytes of an Arrow batch that goes to a Python worker.
PIECE, PIECE_BYTES, BATCH_BYTES = 1024, 2 << 20, 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_FREE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the warehouse's where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return found.rstrip("/") if found else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loam-shared"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, so that long texts do not fill a worker; a smaller setting stays."""
    if int(spark.conf.get(_BATCH_SETTING).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def sliced(batch: pa.RecordBatch, column: int, rows: int = PIECE, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most `rows` rows and about `size` bytes of a string or binary column (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends[at:], before + size, "right"))))
        yield batch.slice(at, n)
        at += n


def materialize(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there and survives lost executors.

    Shuffle files of the write are removed as soon as it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loam-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SETTING, None)
    spark.conf.set(_FREE_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SETTING) if before is None else spark.conf.set(_FREE_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_arrow_columns(df: DataFrame, source: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """df with fields added (columns of these names are replaced).

    make() runs once per partition; its result maps the values of column source (string or binary) in a part of an Arrow
    batch, bounded in rows and bytes, to one list or array per field.
    """
    names = {f.name for f in fields}
    kept = [c for c in df.columns if c not in names or c == source]
    out = T.StructType([df.schema[c] for c in kept if c not in names] + fields)
    arrow = to_arrow_schema(out)
    new = [arrow.field(f.name).type for f in fields]

    place = kept.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in (part for b in batches for part in sliced(b, place)):
            work = work or make()
            made = work(batch.column(place).to_pylist())
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in names]
            columns += [m if isinstance(m, pa.Array) else pa.array(m, type=t) for m, t in zip(made, new, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    bound_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, out)


MIX = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = scramble(np.arange(1, 257, dtype=np.uint64))
_POWER, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Bytes that are summed at once; a longer word is hashed on its own.
CHUNK = 1 << 17


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The first CHUNK + 1 powers of an odd multiplier and of its inverse, by 64-bit overflow."""
    out = []
    for base in (_POWER, _INVERSE):
        steps = np.full(CHUNK + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and a 64-bit hash of each word of data (split at ASCII white space).

    Bytes are summed with rising powers, a chunk of the words at a time; a word's hash is its part of the sum, shifted back.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers()
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + CHUNK, "right"))
        if j == i:
            out[i], i = xxhash.xxh64_intdigest(data[base : ends[i]]), i + 1
            continue
        part = raw[base : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return starts, scramble(out)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word (lower case, split at ASCII white space)."""
    return words_of(lowered(text))[1]


def runs_of_words(w: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of five word hashes; of one to four, one for all; of none, none."""
    if not len(w):
        return w
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(w))):
        h = (h ^ w[j : j + n]) * MIX
        h ^= h >> np.uint64(29)
    return scramble(h)


def shingles(text: str | None) -> np.ndarray:
    """A 64-bit hash for each run of five words; a text of one to four words has one shingle, one without words none."""
    return runs_of_words(word_hashes(text))


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Ends of the lists of a column of lists of structs, from 0 on (a null list is empty), and each field of their structs, one list after the other."""
    ends = column.offsets.to_numpy()
    whole = column.values.slice(ends[0], ends[-1] - ends[0])
    return ends - ends[0], whole.flatten()


def _values(column: pa.Array) -> list:
    """The values of a column; of one of lists of structs of integers, an array with a row for each struct."""
    if not pa.types.is_list(column.type) or not pa.types.is_struct(column.type.value_type):
        return column.to_pylist()
    ends, fields = list_parts(column)
    rows = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in fields], 1)
    return [rows[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def salted_pairs(pairs: DataFrame, docs: DataFrame, per_group: int, verify: Callable, schema: str) -> DataFrame:
    """Rows of verify(centre, members) over groups of one centre and about per_group members, each a dict of its columns
    (lists of structs of integers: an array with a row for each).

    pairs: member, centre (ids of docs) and more columns; docs: id, text. A centre's text is repeated once for each
    per_group members, so no group grows with the number of a centre's members. Groups stream through sorted partitions:
    a task holds one group at a time.
    """
    extra = [c for c in pairs.columns if c not in ("member", "centre")]
    sizes = pairs.groupBy("centre").agg(F.count("*").alias("links"))
    parts = sizes.withColumn("parts", F.ceil(F.col("links") / per_group).cast("int"))
    members = (
        pairs.join(parts.select("centre", "parts"), "centre")
        .withColumn("salt", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
        .join(docs.select(F.col("id").alias("member"), "text"), "member")
        .select("centre", "salt", "member", "text", *extra)
    )
    centres = (
        parts.join(docs.select(F.col("id").alias("centre"), "text"), "centre")
        .select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "text", *[F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in extra])
    )
    bound_batches(docs.sparkSession)
    rows = members.unionByName(centres).repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.asc_nulls_first("member"))
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        centre, members, found = None, [], []
        for batch in batches:
            for row in (dict(zip(batch.schema.names, x, strict=True)) for x in zip(*map(_values, batch.columns), strict=True)):
                if row["member"] is None:
                    if members:
                        found += verify(centre, members)
                    centre, members = row, []
                else:
                    members.append(row)
                if len(found) > 4096:
                    yield made(found)
                    found = []
        if members:
            found += verify(centre, members)
        yield made(found)

    return rows.mapInArrow(run, schema)


def likely(df: DataFrame, key: str, wanted: DataFrame, bits: int = 24) -> DataFrame:
    """df without most rows whose key wanted (a column of the same name) lacks: a bitmap of 2^bits hashes, broadcast.

    The bitmap has 2^(bits - 6) words at most, whatever the data (4 MB for 24 bits); where it is full it lets every row
    pass. An exact semi-join must follow.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    word, bit = F.floor(slot / 64).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("_bit")
    words = wanted.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = df.select("*", word, bit).join(F.broadcast(words), "_word")
    return marked.where(F.col("_bit").bitwiseAND(F.col("_bits")) != 0).drop("_word", "_bit", "_bits")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of the undirected edges (a, b).

    Alternates star contractions towards the smallest neighbour until nothing changes; each round is written
    to the shared folder. The driver only sees one checksum row per round.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = materialize(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    hubs = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(hubs)


def bounded_sample(df: DataFrame, rows: int, text: str | None = None, chars: int = 4096) -> list:
    """About `rows` rows (never over twice as many) chosen by a hash of the whole row, on the driver: for fitting a model only.

    A longer text is sampled by a stretch of `chars` characters at a place its hash chooses, so the sample is bounded in bytes as well.
    """
    total = df.count()
    share = min(1.0, rows / total) if total else 1.0
    picked = df.where(F.pmod(F.xxhash64(F.lit(17), *[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 30)) < int(share * (1 << 30)))
    if text:
        at = F.pmod(F.xxhash64(F.lit(19), text), F.greatest(F.length(text) - chars, F.lit(1)))
        picked = picked.withColumn(text, F.substring(text, (at + 1).cast("int"), F.lit(chars)))
    return picked.limit(2 * rows).collect()
