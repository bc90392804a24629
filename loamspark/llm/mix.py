"""Mixing sources to target weights by pivotal dependent rounding through a reduction tree. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamspark.llm.common import materialize, read

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents in a group of the first level, and groups whose residuals meet on the next.
GROUP, FAN_IN = 256, 64
#: Equal rows in a block.
EQUAL = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from rows (source, size); one row a source.

    All sizes together are shared by weight (by rank of the source in code-point order, null last) and no target passes
    three times its source's size: with sources by the level at which they reach that, the capped ones come first, and
    the level of the others follows from what is left. Whole numbers until the last division, so reruns agree.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), rank + 1)
    full = F.col("source_size") * MOST_COPIES
    by_level = Window.orderBy(full / F.col("weight"), F.asc_nulls_last("source"))
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    later = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sums.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(everything))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum(full).over(earlier), F.lit(0))) / F.sum("weight").over(later))
    ranked = ranked.withColumn("level", F.coalesce(F.min(F.when(F.col("level") * F.col("weight") <= full, F.struct(full / F.col("weight"), "level"))).over(everything)["level"], F.lit(0.0)))
    return ranked.select("source", "source_size", F.least(full.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _unit(seed: Column) -> Column:
    """A number from 0 to 1 fixed by seed."""
    return F.pmod(seed, F.lit(1 << 52)) / float(1 << 52)


ITEM = "struct<h:bigint,row:bigint,n:bigint,doc_id:{id},size:bigint,whole:int,p:double>"


def _pivot(items: Column, item: str, level: int) -> Column:
    """(carry, done) after all items have met one after the other.

    Two items with fractional p exchange words (p times size) so that their sum stays and one p becomes 0 or 1; which one
    gains is drawn so that each keeps its expectation. What is not yet whole meets the next item. done: whole copies.
    """
    none = F.expr(f"cast(null as {item})")
    no_items = F.expr(f"cast(array() as array<{item}>)")

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["row"].alias("row"), x["n"].alias("n"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["whole"].alias("whole"), p.alias("p"))

    def meet(acc: Column, x: Column) -> Column:
        a = acc["carry"]

        def moved(v: Column) -> Column:
            # up: words that b can give to a; down: words that a can give to b.
            rises = _unit(F.xxhash64(F.lit(level), a["h"], x["h"])) * (v["up"] + v["down"]) < v["down"]
            pa = F.when(rises, F.when((1 - a["p"]) * a["size"] <= x["p"] * x["size"], 1.0).otherwise(a["p"] + v["up"] / a["size"])).otherwise(F.when(a["p"] * a["size"] <= (1 - x["p"]) * x["size"], 0.0).otherwise(a["p"] - v["down"] / a["size"]))
            pb = F.when(rises, F.when(x["p"] * x["size"] <= (1 - a["p"]) * a["size"], 0.0).otherwise(x["p"] - v["up"] / x["size"])).otherwise(F.when((1 - x["p"]) * x["size"] <= a["p"] * a["size"], 1.0).otherwise(x["p"] + v["down"] / x["size"]))
            return F.struct(with_p(a, pa).alias("a"), with_p(x, pb).alias("b"))

        whole = lambda y: (y["p"] <= 0.0) | (y["p"] >= 1.0)
        limits = F.struct(F.least((1 - a["p"]) * a["size"], x["p"] * x["size"]).alias("up"), F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"]).alias("down"))
        after = _let(
            _let(limits, moved),
            lambda m: F.struct(
                F.when(~whole(m["a"]), m["a"]).when(~whole(m["b"]), m["b"]).otherwise(none).alias("carry"),
                F.concat(acc["done"], F.filter(F.array(m["a"], m["b"]), whole)).alias("done"),
            ),
        )
        done = F.struct(a.alias("carry"), F.concat(acc["done"], F.array(x)).alias("done"))
        return F.when(whole(x), done).when(a.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(after)

    return F.aggregate(items, F.struct(none.alias("carry"), no_items.alias("done")), meet)


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size (words; null text: 0), row (a hash of the three columns), n (its number among equal rows) and h, which orders a row and seeds its draws.

    Equal rows are counted before any shuffle and dealt out again in blocks, so however many there are no task holds all of them.
    """
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), row_hash(text).alias("row")).groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("rows"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / EQUAL))).alias("block"))
    several = rows.where("rows > 1").repartition("row", "block").select("*", F.explode(F.sequence(F.col("block") * EQUAL, F.least(F.col("rows"), (F.col("block") + 1) * EQUAL) - 1)).alias("n"))
    every = rows.where("rows = 1").withColumn("n", F.lit(0).cast("long")).unionByName(several)
    return every.select("doc_id", "source", "size", "row", "n", F.when(F.col("n") == 0, F.col("row")).otherwise(F.xxhash64("row", "n")).alias("h"))


def row_hash(text: str) -> Column:
    return F.xxhash64("doc_id", "source", text)


def mix(rows: DataFrame) -> DataFrame:
    """Rows of sized() with source_size, target and copies (0 to 3), so that each source's copied words come near its target.

    Groups of about GROUP documents of a source are rounded side by side; the one residual of each group meets those of
    FAN_IN other groups on the next level, until each source has one, which is rounded to the nearer side. So a source
    misses its target by at most half of one document. Documents without words take part with no copies beyond the whole ones.
    Every level is a table in the shared folder; no level joins or gathers by source alone, so a hot source is no hot task.
    A null source is a source of its own, the last. An empty table gives no rows. Only sources are ranked in one task: they
    are few next to documents.
    """
    item = ITEM.format(id=rows.schema["doc_id"].dataType.simpleString())
    rows = materialize(rows)
    targets = materialize(source_targets(rows))
    total = rows.count()
    groups = max(1, math.ceil(total / GROUP))
    grouped = (
        rows.withColumn("part", F.pmod("h", F.lit(groups)))
        .groupBy("source", "part")
        .agg(F.collect_list(F.struct("h", "row", "n", "doc_id", "size")).alias("items"))
    )
    t = targets.withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = lambda x: F.struct(x["h"].alias("h"), x["row"].alias("row"), x["n"].alias("n"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.col("whole").alias("whole"), F.when(x["size"] > 0, F.col("rate") - F.col("whole")).otherwise(0.0).alias("p"))
    level = (
        grouped.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("rate", F.least(rate, F.lit(float(MOST_COPIES))))
        .withColumn("whole", F.floor("rate").cast("int"))
        .select("source", "source_size", "target", "part", F.transform(F.sort_array("items"), start).alias("items"))
    )
    depth, out = 0, []
    while True:
        level = level.withColumn("r", _pivot(F.col("items"), item, depth)).select("source", "source_size", "target", "part", "r.carry", "r.done")
        level = materialize(level)
        out.append(level.select("source", "source_size", "target", F.explode("done").alias("d")))
        if groups == 1:
            break
        groups, depth = math.ceil(groups / FAN_IN), depth + 1
        level = (
            level.where("carry is not null")
            .withColumn("part", F.pmod("part", F.lit(groups)))
            .groupBy("source", "source_size", "target", "part")
            .agg(F.sort_array(F.collect_list("carry")).alias("items"))
        )
    last = level.where("carry is not null").select("source", "source_size", "target", F.col("carry").alias("d"))
    for more in out:
        last = last.unionByName(more)
    copies = (F.col("d.whole") + F.when(F.col("d.p") >= 0.5, 1).otherwise(0)).alias("copies")
    return last.select("d.row", "d.n", "d.doc_id", "source", "d.size", "source_size", "target", copies)


def mix_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each row as often as mix() takes it (not at all, or up to three times); columns as they were.

    Rows of equal doc_id, source and text are numbered, and their counts dealt among them, partition by partition. Null
    texts have no words; other columns, whatever their names, pass through; an empty table stays empty.
    """
    taken = materialize(mix(sized(docs, text)).select("row", "n", "copies"))
    whole = docs.select(row_hash(text).alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    several = materialize(taken.where("n > 0").select("row").distinct())
    rows = whole.join(several.withColumn("many", F.lit(True)).hint("merge"), "row", "left")
    alone = rows.where("many is null").select("row", "doc").join(taken.where("copies > 0"), "row")
    equal = materialize(rows.where("many").select("row", "doc", F.spark_partition_id().alias("part")))
    sums = equal.groupBy("row", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("row").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = equal.withColumn("own", F.row_number().over(Window.partitionBy("row", "part").orderBy(F.lit(0)))).join(sums.select("row", "part", before.alias("before")), ["row", "part"])
    numbered = numbered.select("row", (F.col("before") + F.col("own") - 1).alias("n"), "doc").join(taken.where("copies > 0"), ["row", "n"])
    both = alone.select("doc", "copies").unionByName(numbered.select("doc", "copies"))
    return both.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(sized(read(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
