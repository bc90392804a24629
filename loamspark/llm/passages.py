"""Substring dedup: compact windows of token min-hashes, interval joins where documents share them, then verified passages.

A run of LEAST shingles can only belong to a near-duplicate passage if most of its shingles occur in another document as
well. So shingles are first marked as shared or not, over all documents, without a row for each: batches of documents send
sorted hashes by ranges, and one bit for each comes back. Stretches of marked shingles (pieces) carry on; texts do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loamspark.llm.common import SHINGLE, bound_batches, components, list_parts, lowered, materialize, read, runs_of_words, salted_pairs, scramble, sliced, words_of

SIMILARITY = 0.8
#: Least words of a passage, hash functions, and how many of them must share a window at one place.
WORDS, HASHES, ENOUGH = 50, 6, 2
#: Words that may be missing between matching stretches, and how far two anchors' alignments may differ.
GAP, DRIFT = 10, 8
#: The part of a run's shingles that must occur elsewhere. A passage of any length at a Jaccard similarity of 0.8 holds a
#: run of the least length with 60 % (four fifths of a passage of nearly two runs, its other fifth all in the middle).
SHARED = 0.6
#: Bytes of text in a batch, ranges of hashes for so many batches, bits of a hash within its range.
PACK, RANGES, PER_BATCHES, LOW = 4 << 20, 1024, 8192, 32
#: Members of a centre in one group; contexts in a block of the exact remainder; rows, columns and pairs of its matrix at once.
GROUP, BLOCK, ROWS, COLUMNS, PAIRS = 64, 512, 64, 256, 1 << 13
#: Hash functions whose keys look for passages of one component's members that no centre covers: they change spans, no class.
OPEN_FUNCTIONS = 2
#: Members of a cell up to which its pairs are looked at one by one.
FEW = 3

FUNCTION = 7  # the low bits of a key that tell its hash function


def windows_of(values: np.ndarray, owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, place, right) of every node of the Cartesian trees of values (one tree for each owner, owners ascending) whose
    subtree spans at least `least` places.

    Every run of values between left and right that holds place has its minimum there. Such nodes are exactly the minima
    of runs of `least` values, found at once by sliding minima; the nearest smaller value on either side of a node is
    again such a node, so a stack over them alone gives their spans. Of equal values the first counts as smaller, and a
    node just below one of its own value is left out: texts that repeat a word have one window for the run.
    """
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none
    bits = np.uint64(max(1, n.bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = values & ~low | np.arange(n, dtype=np.uint64)
    run, size = packed, 1
    while size * 2 <= least:
        run = np.minimum(run[:-size], run[size:])
        size *= 2
    if size < least:
        run = np.minimum(run[: n - least + 1], run[least - size :])
    run = run[owners[: n - least + 1] == owners[least - 1 :]]
    if not len(run):
        return none, none, none
    ranks = run[np.concatenate([[True], run[1:] != run[:-1]])]
    places = (ranks & low).astype(np.int64)
    own = owners[places]
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist() + [len(own)]
    first, last = np.searchsorted(owners, own, "left").tolist(), (np.searchsorted(owners, own, "right") - 1).tolist()
    left, right = [0] * len(places), last
    at, rank = places.tolist(), ranks.tolist()
    for begin, end in zip(edges, edges[1:]):
        stack: list[int] = []
        for i in range(begin, end):
            x = rank[i]
            while stack and rank[stack[-1]] > x:
                right[stack.pop()] = at[i] - 1
            left[i] = at[stack[-1]] + 1 if stack else first[i]
            stack.append(i)
    lefts, rights = np.array(left), np.array(right)
    # A place whose subtree starts just after an equal value stands under it.
    fresh = (lefts == np.array(first)) | (values[lefts - 1] != values[places])
    return lefts[fresh], places[fresh], rights[fresh]


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, place, right) of the windows of one text's values."""
    return list(zip(*(x.tolist() for x in windows_of(values, np.zeros(len(values), np.int64), least)), strict=True))


_SEEDS = scramble(np.arange(101, 101 + HASHES, dtype=np.uint64))


def reach(least: int) -> int:
    """Places on either side of a shared minimum that show whether a passage of `least` lies around it."""
    return least + 2 * DRIFT


_POWER, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _rising(n: int, base: np.uint64) -> np.ndarray:
    """The powers 0 to n of base, by 64-bit overflow."""
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _ranked(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """values of so many bits sorted, and their places, those of equal values ascending. If both fit a word they are sorted as one, which is faster."""
    low = np.uint64(len(values).bit_length())
    if bits + int(low) > 64:
        order = np.argsort(values, kind="stable")
        return values[order], order
    packed = np.sort(values << low | np.arange(len(values), dtype=np.uint64))
    return packed >> low, (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


class Batch:
    """The shingles of a batch of documents that have at least `least`, one document after the other."""

    def __init__(self, texts: list[str | None], least: int, bits: int):
        raw = [lowered(t) for t in texts]
        starts, w = words_of(b" ".join(raw))
        # Words of a document are counted from the borders, as documents are few next to words.
        border = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in raw]))
        held = np.diff(border)
        doc = np.repeat(np.arange(len(raw)), held)
        n = max(0, len(w) - SHINGLE + 1)
        whole = doc[:n] == doc[SHINGLE - 1 :][:n]
        whole &= (held >= least + SHINGLE - 1)[doc[:n]] if n else False
        s = runs_of_words(w)[:n] if n else w[:0]
        self.values, self.owners = s[whole], doc[:n][whole]
        self.places = np.flatnonzero(whole) - border[self.owners]
        short = self.values >> np.uint64(64 - LOW - bits)
        ranked, order = _ranked(short, LOW + bits)
        owner = self.owners[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)]
        at = np.flatnonzero(fresh)
        #: Distinct shortened hashes, the one of each shingle, and whether two documents of the batch hold it.
        self.distinct, self.which = ranked[at], np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(fresh) - 1
        self.often = owner[at] != owner[np.concatenate([at[1:], [len(order)]]).astype(np.int64) - 1] if len(at) else np.zeros(0, bool)
        self.bounds = np.searchsorted(self.distinct >> np.uint64(LOW), np.arange((1 << bits) + 1, dtype=np.uint64))


def _packed(docs: DataFrame) -> DataFrame:
    """batch, body: documents (doc_id, text) of a task, about PACK bytes of text at a time, compressed."""
    plain = pa.schema([pa.field("doc_id", to_arrow_schema(docs.select("doc_id").schema).field(0).type), pa.field("text", pa.string())])

    def run(batches):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def made():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, plain, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in held:
                    out.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([task << 20 | number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "body"])

        for batch in batches:
            for part in sliced(batch, 1, 1 << 20, PACK):
                held.append(pa.RecordBatch.from_arrays([part.column(0).cast(plain[0].type), part.column(1).cast(pa.string())], schema=plain))
                size += part.nbytes
                if size >= PACK:
                    yield made()
                    number, held, size = number + 1, [], 0
        if held:
            yield made()

    return docs.select("doc_id", "text").mapInArrow(run, "batch long, body binary")


def _unpacked(body: bytes) -> tuple[pa.Array, list[str | None]]:
    table = pa.ipc.open_stream(body).read_all()
    return table.column(0).combine_chunks(), table.column(1).to_pylist()


def _ranges(packed: DataFrame, least: int, bits: int) -> DataFrame:
    """bucket, batch, hashes: the distinct shortened hashes of each batch, by ranges, the low LOW bits of each."""

    def run(batches):
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Batch(_unpacked(body.as_py())[1], least, bits)
                low, full = b.distinct.astype(np.uint32), np.flatnonzero(np.diff(b.bounds))
                blobs = [low[b.bounds[k] : b.bounds[k + 1]].tobytes() for k in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), number), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "batch", "hashes"])

    return packed.mapInArrow(run, "bucket int, batch long, hashes binary")


def _marks(ranges: DataFrame) -> DataFrame:
    """batch, bucket, mask: a bit for each hash of ranges, whether another batch holds it as well."""

    def marked(bucket, held):
        values = np.concatenate([np.frombuffer(h, np.uint32) for _, h in held])
        ranked, order = _ranked(values.astype(np.uint64), LOW)
        same, again = ranked[1:] == ranked[:-1], np.zeros(len(ranked), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        cuts = np.cumsum([len(h) // 4 for _, h in held])[:-1]
        masks = [np.packbits(x).tobytes() for x in np.split(again, cuts)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), pa.array(masks, pa.binary())], names=["batch", "bucket", "mask"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, number, hashes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != now and held:
                    yield marked(now, held)
                    held = []
                now = bucket
                held.append((number, hashes))
        if held:
            yield marked(now, held)

    return ranges.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "batch long, bucket int, mask binary")


WINDOW = T.StructType([T.StructField("key", T.LongType()), T.StructField("context", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("place", "left", "right")]])


def stretches_of_shared(owners: np.ndarray, shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and exclusive ends of the stretches covered by runs of `least` shingles (of one owner) with enough shared ones."""
    n = len(shared)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(shared)])
    good = ((sums[least:] - sums[:-least]) >= SHARED * least) & (owners[: n - least + 1] == owners[least - 1 :])
    cover = np.zeros(n + 1, np.int64)
    cover[: n - least + 1] += good
    cover[least:] -= good
    inside = np.cumsum(cover[:n]) > 0
    joined = np.concatenate([[False], inside[1:] & inside[:-1] & (owners[1:] == owners[:-1])])
    return np.flatnonzero(inside & ~joined), np.flatnonzero(inside & ~np.concatenate([joined[1:], [False]])) + 1


def pieces_of(docs: DataFrame, least: int) -> DataFrame:
    """piece, doc_id, start, body, windows: the stretches of every document that other documents may share.

    body: 32 bits of each shingle. windows: the compact windows of each hash function, key (a hash of the minimum, its low
    bits the function), context (a hash of the shingles up to reach(least) places around it) and places counted within the piece.
    """
    packed = materialize(_packed(docs))
    # More ranges for more batches, so that the hashes of a range fit a worker at any size.
    bits = (RANGES * -(-max(1, packed.count()) // PER_BATCHES) - 1).bit_length()
    masks = _marks(_ranges(packed, least, bits)).groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask"))).alias("masks"))
    rows = packed.join(masks.hint("merge"), "batch").select("batch", "body", F.col("masks.bucket").alias("buckets"), F.col("masks.mask").alias("masks"))
    shape = T.StructType([T.StructField("piece", T.LongType()), docs.schema["doc_id"], T.StructField("start", T.IntegerType()), T.StructField("body", T.BinaryType()), T.StructField("windows", T.ArrayType(WINDOW))])
    arrow = to_arrow_schema(shape)
    struct = arrow.field("windows").type.value_type

    def made(number: int, body: bytes, buckets: list, masks: list):
        ids, texts = _unpacked(body)
        b = Batch(texts, least, bits)
        shared = b.often
        for k, mask in zip(buckets, masks, strict=True):
            lo, hi = b.bounds[k], b.bounds[k + 1]
            shared[lo:hi] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo).astype(bool)
        starts, ends = stretches_of_shared(b.owners, shared[b.which], least)
        if not len(starts):
            return
        inside = np.repeat(np.arange(len(starts)), ends - starts)
        offset = np.cumsum(ends - starts) - (ends - starts)
        values = b.values[np.arange(len(inside)) - np.repeat(offset, ends - starts) + np.repeat(starts, ends - starts)]
        columns, count = [], np.zeros(len(starts), np.int64)
        ends = ends - starts + offset  # from here on counted within the pieces alone
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _rising(len(values), _POWER)[:-1], out=sums[1:])
        down = _rising(len(values), _INVERSE)
        for k, seed in enumerate(_SEEDS):
            h = scramble(values ^ seed)
            left, place, right = windows_of(h, inside, least)
            owner = inside[place]
            lo, hi = np.maximum(place - reach(least), offset[owner]), np.minimum(place + reach(least) + 1, ends[owner])
            context = scramble((sums[hi] - sums[lo]) * down[lo] ^ scramble((place - lo + 1).astype(np.uint64))).view(np.int64)
            columns.append((owner, (scramble(h[place]) & ~np.uint64(FUNCTION) | np.uint64(k)).view(np.int64), context, place - offset[owner], left - offset[owner], right - offset[owner]))
            count += np.bincount(owner, minlength=len(starts))
        owner, *rest = (np.concatenate(x) for x in zip(*columns, strict=True))
        order = np.argsort(owner, kind="stable")
        fields = [pa.array(x[order]) for x in rest[:2]] + [pa.array(x[order], pa.int32()) for x in rest[2:]]
        windows = pa.StructArray.from_arrays(fields, fields=list(struct))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), windows)
        data, rows = values.astype(np.uint32).tobytes(), pa.array(b.owners[starts])
        bodies = [data[4 * o : 4 * (o + e - s)] for o, s, e in zip(offset.tolist(), offset.tolist(), ends.tolist(), strict=True)]
        full = [pa.array((number << 20) + np.arange(len(starts)), pa.int64()), ids.take(rows), pa.array(b.places[starts], pa.int32()), pa.array(bodies, pa.binary()), lists.cast(arrow.field("windows").type)]
        yield pa.RecordBatch.from_arrays(full, schema=arrow)

    def run(batches):
        for batch in batches:
            for number, body, buckets, masks in zip(*(batch.column(i) for i in range(4)), strict=True):
                yield from made(number.as_py(), body.as_py(), buckets.as_py(), masks.as_py())

    return materialize(rows.mapInArrow(run, shape))


def enough(anchors: np.ndarray, least: int) -> bool:
    """Whether runs of anchors (rows of function, my place, their place, first, last) of enough functions meet in nearly `least` places."""
    kind, lo, hi = anchors[:, 0], anchors[:, 3], anchors[:, 4]
    if np.count_nonzero(np.bincount(kind)) < ENOUGH:
        return False
    order = np.argsort(lo)
    # How far the runs of each function reach that began up to a place; of equal places the last one knows all.
    far = np.full((HASHES, len(lo)), -1, np.int64)
    far[kind[order], np.arange(len(lo))] = hi[order]
    np.maximum.accumulate(far, axis=1, out=far)
    return bool(((far >= lo[order] + (max(1, least - DRIFT) - 1)).sum(0) >= ENOUGH).any())


def _stretches(shared: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and exclusive ends of the runs of places in shared that follow one another within gap."""
    cuts = (shared[1:] - shared[:-1] > gap).nonzero()[0]
    return shared[np.concatenate([[0], cuts + 1])], shared[np.concatenate([cuts, [len(shared) - 1]])] + 1


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted (faster than np.unique, which hashes, where they are few)."""
    ranked = np.sort(values)
    fresh = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    return ranked[fresh]


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    x, y = _distinct(x), _distinct(y)
    both = len(_held(x, y))
    return both / (len(x) + len(y) - both)


def passages(mine: np.ndarray, theirs: np.ndarray, anchors: np.ndarray, least: int, similarity: float, known: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """(start, end, their start, their end, Jaccard) of near-duplicate stretches of two lists of shingles; ends exclusive.

    anchors: rows of hash function, my place, their place, first and last for the windows that both share; first and last are
    the run, in my places, that lies in either window. A stretch is a run of shared shingles with gaps of few words (known:
    their distinct shingles, sorted); a pair of stretches needs anchors of enough hash functions whose runs meet, the least
    length and the similarity. Each alignment of its anchors is tried, then the stretches as a whole (texts that repeat
    themselves have no single alignment).
    """
    if len(mine) == len(theirs) >= least and len(anchors) and (mine == theirs).all():
        return [(0, len(mine), 0, len(mine), 1.0)]
    shared = _held(mine, _distinct(theirs) if known is None else known)
    if len(shared) < least * similarity:
        return []
    starts, ends = _stretches(shared, GAP)
    if (ends - starts).max() < least:
        return []
    common = _held(theirs, np.sort(mine[shared]))
    out: list[tuple[int, int, int, int, float]] = []
    for gap in (GAP, 1):
        (s1, e1), (s2, e2) = _stretches(shared, gap), _stretches(common, gap)
        pair = s1.searchsorted(anchors[:, 1], "right") * (len(s2) + 1) + s2.searchsorted(anchors[:, 2], "right")
        order = np.argsort(pair, kind="stable")
        for own in np.split(order, np.diff(pair[order]).nonzero()[0] + 1):
            i, j = divmod(int(pair[own[0]]), len(s2) + 1)
            a, b, c, d = int(s1[i - 1]), int(e1[i - 1]), int(s2[j - 1]), int(e2[j - 1])
            if min(b - a, d - c) < least or not enough(anchors[own], least):
                continue
            met = anchors[own]
            shifts = met[:, 1] - met[:, 2]
            by = np.lexsort((met[:, 1], shifts))
            met, shifts = met[by], shifts[by]
            groups = np.split(met, (np.diff(shifts) > DRIFT).nonzero()[0] + 1)
            tried = []
            for group in groups:
                # One group is all of them, which are enough.
                if len(groups) > 1 and not enough(group, least):
                    continue
                shift = int(group[len(group) // 2, 1] - group[len(group) // 2, 2])
                lo, hi = max(a, c + shift), min(b, d + shift)
                if hi - lo < least:
                    continue
                if len(groups) > 1:
                    # Several alignments in one stretch: keep what this one matches itself.
                    aligned = np.flatnonzero(_aligned(mine[lo:hi], theirs, lo - shift)) + lo
                    if not len(aligned):
                        continue
                    lo, hi = int(aligned[0]), int(aligned[-1]) + 1
                tried.append((lo, hi, lo - shift, hi - shift))
            tried.append((a, b, c, d))
            for lo, hi, x, y in tried:
                if hi - lo >= least and not any(s <= lo and hi <= e for s, e, *_ in out) and (score := _jaccard(mine[lo:hi], theirs[x:y])) >= similarity:
                    out.append((lo, hi, x, y, score))
    return out


def _aligned(values: np.ndarray, others: np.ndarray, at: int) -> np.ndarray:
    """Which values stand in others within DRIFT places of their own place, counted from at."""
    wide = np.zeros(len(values) + 2 * DRIFT, values.dtype)
    lo, hi = max(0, at - DRIFT), min(len(others), at + len(values) + DRIFT)
    wide[lo - (at - DRIFT) : hi - (at - DRIFT)] = others[lo:hi]
    return np.logical_or.reduce([wide[d : d + len(values)] == values for d in range(2 * DRIFT + 1)])


def repeated_passages(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each side of each verified link: doc_id, start, end (words, end exclusive), other_id, similarity.

    Pieces whose windows have the same minimum, and whose windows' runs around it overlap by about the least length, are
    linked to one of them, hash function by hash function; pairs whose runs meet for enough hash functions are verified.
    Members of a key that this leaves uncovered or in different components meet all others of the key by the shingles around
    their places (around_minima); links that neither join components nor cover more words have no rows there. Null texts,
    and texts shorter than `words`, have no windows; rows with a null doc_id are left out. Rows that repeat a doc_id are
    compared with one another like other documents (other_id is then the doc_id itself); a passage that only one row
    repeats is not reported. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    least = words - SHINGLE + 1
    pieces = pieces_of(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), least)
    windows = pieces.select("piece", F.explode("windows").alias("w")).select("w.key", "w.context", "piece", "w.place", "w.left", "w.right")
    first = F.min_by(F.struct("place", "left", "right"), F.struct("piece", "place"))
    shared = windows.groupBy("key").agg(F.min("piece").alias("centre"), F.max("piece").alias("last"), first.alias("c")).where("centre < last").drop("last")
    # The interval join: both windows' runs around the shared minimum must overlap by nearly the least length.
    before = F.least(F.col("place") - F.col("left"), F.col("c.place") - F.col("c.left"))
    after = F.least(F.col("right") - F.col("place"), F.col("c.right") - F.col("c.place"))
    links = materialize(windows.join(shared, "key").select("key", "context", "piece", "place", "centre", F.col("c.place").alias("c_place"), before.cast("int").alias("before"), after.cast("int").alias("after")))
    anchor = F.struct(F.col("key").bitwiseAND(FUNCTION).cast("int").alias("k"), "place", "c_place", (F.col("place") - F.col("before")).alias("lo"), (F.col("place") + F.col("after")).alias("hi"))
    met = links.where((F.col("piece") != F.col("centre")) & (F.col("before") + F.col("after") + 1 >= least - DRIFT))
    pairs = met.groupBy(F.col("piece").alias("member"), "centre").agg(F.collect_list(anchor).alias("anchors"), F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("key").bitwiseAND(FUNCTION).cast("int")))).alias("functions"))
    pairs = materialize(pairs.where(F.col("functions") >= ENOUGH).drop("functions"))

    def verify(centre, members):
        theirs, rows, own = np.frombuffer(centre["text"], np.uint32), [], []
        known = _distinct(theirs)
        for m in members:
            for a, b, c, d, score in passages(np.frombuffer(m["text"], np.uint32), theirs, m["anchors"], least, similarity, known):
                rows.append((m["member"], a, b, centre["centre"], score))
                own.append((c, d, m["member"], score))
        merged: list[list] = []
        for start, end, member, score in sorted(own):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end, member, score])
        return rows + [(centre["centre"], s, e, m, x) for s, e, m, x in merged]

    bodies = pieces.select(F.col("piece").alias("id"), F.col("body").alias("text"))
    found = materialize(salted_pairs(pairs, bodies, GROUP, verify, FOUND))
    # What is left for the other pairs of a key: places that no passage covers yet, and pieces of different components.
    spans = found.select(F.col("piece").alias("id"), "start", "end").distinct()
    covered = (F.col("l.piece") == F.col("s.id")) & (F.col("l.place") >= F.col("s.start")) & (F.col("l.place") < F.col("s.end"))
    places = links.select("key", "context", "piece", "place")
    left = materialize(places.alias("l").join(spans.alias("s"), covered, "left_anti").select("key", "piece", "place").withColumn("open", F.lit(True)))
    joined = components(found.select(F.col("piece").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "piece")
    members = places.join(left.hint("merge"), ["key", "piece", "place"], "left").join(joined.hint("merge"), "piece", "left")
    members = members.select("key", "context", "piece", "place", F.coalesce("open", F.lit(False)).alias("open"), F.coalesce("component", "piece").alias("component"))
    found = found.unionByName(around_minima(materialize(members), pieces, least, similarity))
    own = pieces.select("piece", "doc_id", F.col("start").alias("at"))
    other = pieces.select(F.col("piece").alias("other"), F.col("doc_id").alias("other_id"))
    return found.join(own, "piece").join(other, "other").select("doc_id", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end") + SHINGLE - 1).alias("end"), "other_id", "similarity")


FOUND = "piece long, start int, end int, other long, similarity double"


def around_minima(members: DataFrame, pieces: DataFrame, least: int, similarity: float) -> DataFrame:
    """Passages (both sides) around the places of a key's members, where a place is open or the members' components differ.

    members: key, context, piece, place, open, component. Members with equal contexts share a passage and are linked with
    one of them by aggregation, however many they are. The distinct contexts of a key are dealt into blocks of bounded size,
    and every pair of blocks that can hold a wanted pair is compared in a task of its own, so no task grows with a key:
    closed contexts of the key's most frequent component do not meet one another. Pairs of two components meet under the keys
    of every hash function; pairs of one component, which can only add words to spans, under those of OPEN_FUNCTIONS.
    """
    members = members.withColumn("open", F.col("open") & (F.col("key").bitwiseAND(FUNCTION) < OPEN_FUNCTIONS))
    of_key = members.groupBy("key").agg(F.max("open").alias("o"), F.min("component").alias("c"), F.max("component").alias("d")).where("o or c < d").select("key")
    rest = materialize(members.join(of_key.hint("merge"), "key", "left_semi"))
    one = rest.groupBy("key", "context").agg(F.min(F.struct("piece", "place", "component")).alias("r"), F.max("piece").alias("last"), F.max("open").alias("open"), F.min("component").alias("c"), F.max("component").alias("d"))
    one = materialize(one.select("key", "context", "r.piece", "r.place", "r.component", "last", "open", "c", "d"))
    sizes = pieces.select("piece", (F.octet_length("body") / 4).cast("int").alias("size"))
    equal = one.where("piece < last and (open or c < d)").select("key", "context", F.col("piece").alias("first"), "last")
    equal = rest.select("key", "context", "piece", "place").join(equal, ["key", "context"]).join(sizes, "piece")
    start, end = F.greatest(F.col("place") - reach(least), F.lit(0)), F.least(F.col("place") + reach(least) + 1, F.col("size"))
    equal = equal.select("piece", start.alias("start"), end.alias("end"), F.when(F.col("piece") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("other"), F.lit(1.0).alias("similarity")).distinct()
    # Distinct contexts: open if nothing else has the same; keys at the same places of the same pieces are compared once.
    distinct = one.select("key", "piece", "place", "component", (F.col("open") & (F.col("piece") == F.col("last"))).alias("open"))
    sums = [F.sum(F.xxhash64(F.lit(n), "piece", "place", "open").cast("decimal(38,0)")).alias(f"sum{n}") for n in (1, 2)]
    keys = distinct.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("o"), F.min("component").alias("c"), F.max("component").alias("d"), F.mode("component").alias("main"), *sums)
    keys = keys.where("n > 1 and (o or c < d)").groupBy("n", "o", "sum1", "sum2").agg(F.min(F.struct("key", "main")).alias("k")).select("k.key", "k.main")
    active = F.col("open") | (F.col("component") != F.col("main"))
    dealt = materialize(distinct.join(keys, "key").withColumn("active", active).drop("main"))
    counts = dealt.groupBy("key").agg(F.ceil(F.count_if("active") / BLOCK).cast("int").alias("p"), F.ceil(F.count_if(~F.col("active")) / BLOCK).cast("int").alias("q"))
    dealt = dealt.join(counts, "key")
    spread = F.xxhash64("piece", "place")
    dealt = dealt.withColumn("block", F.when(F.col("active"), F.pmod(spread, F.greatest("p", F.lit(1)))).otherwise(F.col("p") + F.pmod(spread, F.greatest("q", F.lit(1)))).cast("int"))
    # Contexts are cut from the pieces, each gathered once.
    own = dealt.groupBy("piece").agg(F.collect_list(F.struct("key", "place", "open", "component", "active", "block", "p", "q")).alias("own"))
    cut = own.join(pieces.select("piece", "body"), "piece")
    fields = "key long, piece long, place int, open boolean, component long, active boolean, block int, p int, q int, first int, context binary"
    arrow = to_arrow_schema(T._parse_datatype_string(fields))

    def contexts(batches):
        for batch in batches:
            ends, (key, places, *rest) = list_parts(batch.column(1))
            owner, place = np.repeat(np.arange(batch.num_rows), np.diff(ends)), places.to_numpy()
            piece, bodies = batch.column(0).to_numpy()[owner], batch.column(2).to_pylist()
            lo, hi = np.maximum(place - reach(least), 0), place + reach(least) + 1
            for at in range(0, len(place), 4096):
                own = slice(at, at + 4096)
                cuts = [bodies[o][4 * a : 4 * b] for o, a, b in zip(owner[own].tolist(), lo[own].tolist(), hi[own].tolist(), strict=True)]
                columns = [key[own], pa.array(piece[own]), places[own], *[x[own] for x in rest], pa.array(lo[own]), pa.array(cuts, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    last = F.when(F.col("active"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1
    cells = cut.mapInArrow(contexts, fields).withColumn("meets", F.explode(F.sequence(F.lit(0), last)))
    cells = cells.select("key", F.least("block", "meets").alias("lo"), F.greatest("block", "meets").alias("hi"), "piece", "place", "open", "component", "block", "first", "context")
    rows = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "piece", "place")
    shape = to_arrow_schema(T._parse_datatype_string(FOUND))

    def run(batches):
        def made(found):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), shape, strict=True)], schema=shape)

        at, cell = None, []
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(9)] + [batch.column(9).to_pylist()]
            for key, lo, hi, *row in zip(*columns, strict=True):
                if (key, lo, hi) != at:
                    if found := cell_links(cell, least, similarity):
                        yield made(found)
                    at, cell = (key, lo, hi), []
                cell.append((*row[:6], np.frombuffer(row[6], np.uint32)))
        if found := cell_links(cell, least, similarity):
            yield made(found)

    return equal.unionByName(materialize(rows.mapInArrow(run, FOUND)))


def _reached(held: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places to the end of the stretch on one side of a centre, and how many of them are shared; a row of held for each pair, from the centre outwards."""
    if gap == 1:
        full = np.where(held.all(1), held.shape[1], held.argmin(1)).astype(np.int16)
        return full, full
    steps = np.arange(1, held.shape[1] + 1, dtype=np.int16)
    last = np.maximum.accumulate(np.where(held, steps, np.int16(0)), axis=1)
    ends = steps - last >= gap  # so many places without one, the next cannot go on
    first = ends.argmax(1)
    length = np.where(ends.any(1), last[np.arange(len(last)), first], last[:, -1])
    return length, (held & (steps <= length[:, None])).sum(1, dtype=np.int16)


def likely_pairs(contexts: list[np.ndarray], centres: list[int], asked: np.ndarray, width: int, least: int, similarity: float) -> np.ndarray:
    """Which asked pairs (both ways) can have a passage around their centres: the stretches that they share, with gaps of few words
    or none, are long enough, and enough of their places is shared (a little less than the similarity asks, as values may repeat).

    Stretches hold no more shared places than the whole contexts, so pairs with too few of these are left out before.
    """
    n = len(contexts)
    ranked, order = _ranked(np.concatenate(contexts).astype(np.uint64), 32)
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    values, code = ranked[fresh], np.empty(len(order), np.int64)
    code[order] = np.cumsum(fresh) - 1
    sizes = np.array([len(c) for c in contexts])
    owner = np.repeat(np.arange(n), sizes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table = np.full((n, 2 * width + 1), len(values), np.int64)
    table[owner, inside - np.repeat(centres, sizes) + width] = code
    rate = 2 * similarity / (1 + similarity) - 0.04

    def holding(at: int) -> np.ndarray:
        mine = (owner >= at) & (owner < at + COLUMNS)
        has = np.zeros((len(values) + 1, min(COLUMNS, n - at)), bool)
        has[code[mine], owner[mine] - at] = True
        return has

    total = np.zeros((n, n), np.int16)
    rows = np.flatnonzero(asked.any(1))
    for at in range(0, n, COLUMNS):
        has = holding(at)
        for k in range(0, len(rows), ROWS):
            part = rows[k : k + ROWS]
            total[part, at : at + COLUMNS] = has[table[part]].sum(1, dtype=np.min_scalar_type(2 * width + 1))
    near = asked & (total + total.T >= 2 * (rate * least - 1))  # a centre counts even where it is not shared
    length, count, whole = (np.zeros((n, n), np.int16) for _ in range(3))
    for at in range(0, n, COLUMNS):
        mine, other = np.nonzero(near[:, at : at + COLUMNS])
        if len(mine) and n > COLUMNS:
            has = holding(at)
        for k in range(0, len(mine), PAIRS):
            p, q = mine[k : k + PAIRS], other[k : k + PAIRS]
            held = has[table[p], q[:, None]]
            sides, m = np.concatenate([held[:, width + 1 :], held[:, :width][:, ::-1]]), len(p)
            far, shared = _reached(sides, GAP)
            length[p, at + q], count[p, at + q] = far[:m] + far[m:] + 1, shared[:m] + shared[m:] + 1
            near_by = _reached(sides, 1)[0]
            whole[p, at + q] = near_by[:m] + near_by[m:] + 1
    dense = count + count.T >= rate * (length.astype(np.int32) + length.T)
    long = length >= least
    return near & (long & long.T & dense | (whole >= least) & (whole.T >= least))


def cell_links(cell: list[tuple], least: int, similarity: float) -> list[tuple]:
    """Both sides of the passages around the places of a cell of (piece, place, open, component, block, first place, context).

    A pair has an open member or two components and, if the cell has two blocks, one of either. The stretch around the place
    that the pair shares (as in passages, with gaps of few words or none) must have the least length and the similarity.

    Every stretch of a member holds its place, so what its passages cover is one interval. A pair whose members are linked
    already, and neither of which has a value just outside its interval that the other holds, can neither link nor cover
    anything more: it is left out, and so are passages that add nothing. Rows thus grow with the members, not with their pairs.
    """
    n = len(cell)
    if n < 2:
        return []
    contexts, centres = [x[6] for x in cell], [x[1] - x[5] for x in cell]
    if n <= FEW:
        apart = len({x[4] for x in cell}) > 1
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) for a, b in ((cell[i], cell[j]),) if a[0] != b[0] and (a[2] or b[2] or a[3] != b[3]) and not (apart and a[4] == b[4])]
    else:
        piece, is_open, component, block = (np.array([x[i] for x in cell]) for i in (0, 2, 3, 4))
        wanted = (piece[:, None] != piece[None]) & (is_open[:, None] | is_open[None] | (component[:, None] != component[None]))
        if block.min() != block.max():
            wanted &= block[:, None] != block[None]
        if not wanted.any():
            return []
        pairs = np.argwhere(np.triu(likely_pairs(contexts, centres, wanted, reach(least), least, similarity), 1)).tolist()
    owners = [x[3] for x in cell]
    out, held, ranked, spans, group = [], {}, {}, {}, {c: c for c in owners}

    def root(c: int) -> int:
        while group[c] != c:
            group[c] = c = group[group[c]]
        return c

    def values(i: int) -> tuple[list, set]:
        if i not in held:
            held[i] = (v := contexts[i].tolist()), set(v)
        return held[i]

    def grows(i: int, j: int) -> bool:
        """Whether the interval of i can grow by what j holds: a stretch goes on within GAP places."""
        if i not in spans:
            return True
        (lo, hi), mine, theirs = spans[i], values(i)[0], values(j)[1]
        return not (theirs.isdisjoint(mine[hi : hi + GAP]) and theirs.isdisjoint(mine[max(0, lo - GAP) : lo]))

    def cover(i: int, a: int, b: int) -> bool:
        """Adds a passage to what is covered; whether that is more than before."""
        lo, hi = spans.get(i, (a + 1, a))
        spans[i] = min(lo, a), max(hi, b)
        return spans[i] != (lo, hi)

    def rank(i: int) -> np.ndarray:
        if i not in ranked:
            ranked[i] = np.sort(contexts[i])
        return ranked[i]

    for i, j in pairs:
        one, two = root(owners[i]), root(owners[j])
        if one == two and not grows(i, j) and not grows(j, i):
            continue
        if found := passage_around(contexts[i], contexts[j], centres[i], centres[j], least, similarity, (rank(i), rank(j))):
            a, b, c, d, score = found
            group[one] = two
            more = [cover(i, a, b), cover(j, c, d)]
            if one != two or any(more):
                p, q = cell[i][5], cell[j][5]
                out += [(cell[i][0], p + a, p + b, cell[j][0], score), (cell[j][0], q + c, q + d, cell[i][0], score)]
    return out


def passage_around(x: np.ndarray, y: np.ndarray, centre: int, other: int, least: int, similarity: float, ranked: tuple | None = None) -> tuple | None:
    """(start, end, their start, their end, Jaccard) of the stretch around a shingle that both contexts hold, ends exclusive. ranked: both contexts sorted."""

    def stretch(shared: np.ndarray, at: int, gap: int) -> tuple[int, int]:
        cuts = (shared[1:] - shared[:-1] > gap).nonzero()[0]
        if not len(cuts):
            return int(shared[0]), int(shared[-1]) + 1
        k = int(cuts.searchsorted(shared.searchsorted(at)))
        return int(shared[cuts[k - 1] + 1] if k else shared[0]), int(shared[cuts[k]] if k < len(cuts) else shared[-1]) + 1

    my_rank, their_rank = ranked or (np.sort(x), np.sort(y))
    mine = _held(x, their_rank)
    if len(mine) < similarity * least:
        return None
    theirs = None
    for gap in (GAP, 1):
        a, b = stretch(mine, centre, gap)
        if b - a < least:
            return None  # smaller gaps give shorter stretches
        theirs = _held(y, my_rank) if theirs is None else theirs
        c, d = stretch(theirs, other, gap)
        if d - c < least:
            return None
        left, right = set(x[a:b].tolist()), set(y[c:d].tolist())
        both = len(left & right)
        if (score := both / (len(left) + len(right) - both)) >= similarity:
            return a, b, c, d, score
    return None


def _held(x: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Places of x whose values are among the ranked (sorted) ones."""
    return (ranked.take(ranked.searchsorted(x), mode="clip") == x).nonzero()[0]


def repeated_documents(found: DataFrame) -> DataFrame:
    """One row for each document of repeated_passages: doc_id, class_id, n_spans, repeated_words, spans (start-end, merged, joined by commas).

    No passages give no rows. A document that only rows of its own id share keeps its id as its class.
    """
    found = materialize(found)
    classes = components(found.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b"))).withColumnsRenamed({"node": "doc_id", "component": "class_id"})
    spans = found.select("doc_id", "start", "end").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    pair = "array<struct<start:int,end:int>>"

    def step(a, s):
        grown = F.struct(a["at"]["start"].alias("start"), F.greatest(a["at"]["end"], s["end"]).alias("end"))
        fresh = F.struct(s.alias("at"), F.when(a["at"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["at"]))).alias("out"))
        return F.when(s["start"] <= a["at"]["end"], F.struct(grown.alias("at"), a["out"].alias("out"))).otherwise(fresh)

    none = F.struct(F.expr("cast(null as struct<start:int,end:int>)").alias("at"), F.expr(f"cast(array() as {pair})").alias("out"))
    merged = F.aggregate("spans", none, step, lambda a: F.concat(a["out"], F.array(a["at"])))
    spans = spans.select("doc_id", merged.alias("spans"))
    return spans.join(classes, "doc_id", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("repeated_words"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_documents(repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text")))
