"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the mix belongs to the source whose stretch of cumulative target shares holds the point frac(k / golden ratio), so
any run of slots is close to the targets. Slots are ranked per source; slot r of a source takes its block r modulo the
number of blocks, blocks being equal runs of tokens of the source's documents in a shuffled order. A source's slots beyond
its target take nothing and missing ones follow at the end, so each source gives its target's whole tokens exactly.

Neither ranks nor running sums put a source into one task: both are taken within cells (chunks of slots, ranges of shuffle
keys) and shifted by prefix sums over the cells, whose number per source is bounded.

Defined results: a null text has size 0; a size-0 document is taken 0 times; equal ids keep their rows and share a place in
the order by source and text; a null source is a source of its own, the last; a document of which the mix takes nothing has no first slot; an empty table gives no row; other
columns are ignored.

One row for each source passes one task where sources are ranked and their targets found, and the driver holds the shares of those
with a target; a source takes some 30 bytes there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.storage import Scratch

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_TOKENS = 256
#: Ranges of shuffle keys per source, and slots per chunk.
CELLS, CHUNK = 4096, 4096
_GOLDEN = (math.sqrt(5) - 1) / 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """sizes: (source, source_size). Adds the rank by code point (null last), the weight and the target.

    With sources in order of limit / weight, those before the first that stays within its share are at their limits, and
    the others share what is left by weight; that is where resharing the excess again and again ends.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    limited = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = limited.withColumn("level", left / rest).withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(whole)["level"]
    free = F.max(F.col("free").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return share.select("source", "place", "source_size", F.when(free, level * F.col("weight")).otherwise(F.col("most").cast("double")).alias("target"))


def _placed(highs: np.ndarray, places: np.ndarray) -> Callable:
    def run(batches):
        for batch in batches:
            slot = batch.column(0).to_numpy()
            x = slot * _GOLDEN
            at = np.searchsorted(highs, x - np.floor(x), "right").clip(0, len(places) - 1)
            yield pa.RecordBatch.from_pydict({"id": slot, "place": places[at]})

    return run


def schedule(spark: SparkSession, targets: DataFrame, block_tokens: int) -> DataFrame:
    """Rows (place, block, full, first, cut, cut_slot): how often a block is taken whole and the first slot that does, the tokens of
    its one partial taking and that one's slot.

    The shares of the sources are the only thing that the driver holds. The few slots by which a source falls short of
    its target at the schedule's end follow as a closing round, source by source.
    """
    goals = targets.select("place", "source_size", F.floor("target").alias("goal")).where("goal > 0")
    goals = goals.withColumn("blocks", F.ceil(F.col("source_size") / block_tokens))
    whole, rest = F.floor(F.col("goal") / F.col("source_size")), F.col("goal") % F.col("source_size")
    goals = goals.withColumn("needed", whole * F.col("blocks") + F.ceil(rest / block_tokens))
    shares = goals.select("place", "goal").orderBy("place").toPandas()
    total = int(shares.goal.sum())
    slots = math.ceil(total / block_tokens)
    highs = shares.goal.cumsum().to_numpy() / max(total, 1)
    placed = spark.range(slots).mapInArrow(_placed(highs, shares.place.to_numpy(np.int32)), "id long, place int")
    placed = placed.withColumn("chunk", F.floor(F.col("id") / CHUNK))
    counts = placed.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("place").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("id")) - 1).join(before, ["place", "chunk"])
    had = goals.join(counts.groupBy("place").agg(F.sum("n").alias("had")), "place", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    missing = F.greatest(F.col("needed") - F.col("had"), F.lit(0))
    had = had.withColumn("closes", F.sum(missing).over(Window.orderBy("place")) - missing + slots)  # one row per source
    closing = had.where("had < needed").select("place", "had", "closes", F.explode(F.sequence("had", F.col("needed") - 1)).alias("r"))
    closing = closing.select("place", "r", (F.col("closes") + F.col("r") - F.col("had")).alias("id"))
    slot = ranked.select("place", (F.col("r") + F.col("before")).alias("r"), "id").union(closing).join(goals, "place")
    slot = slot.withColumn("block", F.col("r") % F.col("blocks")).withColumn("start", F.floor(F.col("r") / F.col("blocks")) * F.col("source_size") + F.col("block") * block_tokens)
    size = F.least(F.lit(block_tokens), F.col("source_size") - F.col("block") * block_tokens)
    slot = slot.withColumn("size", size).withColumn("take", F.least("size", F.col("goal") - F.col("start"))).where("take > 0")
    is_whole = F.col("take") == F.col("size")
    return slot.groupBy("place", "block").agg(
        F.sum(is_whole.cast("long")).alias("full"),
        F.min(F.when(is_whole, F.col("id"))).alias("first"),
        F.sum(F.when(is_whole, 0).otherwise(F.col("take"))).alias("cut"),
        F.min(F.when(~is_whole, F.col("id"))).alias("cut_slot"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS, block_tokens: int = BLOCK_TOKENS, salt: str = "mix") -> DataFrame:
    """One row per input row: id, size, source_size, target of its source, taken (the words that slots of the schedule take of it), and
    the first of these slots and their number."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(salt)))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), F.xxhash64(text_col).alias("tie"))
    sized = scratch.keep(sized, "sized").withColumn("cell", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    sums = scratch.keep(sized.groupBy("source", "cell").agg(F.sum("size").alias("n")), "sums")
    targets = scratch.keep(source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size"))).coalesce(1), "targets")
    known = F.broadcast(targets.select(F.col("source").alias("of"), "place", "source_size", "target")) if targets.count() <= 100_000 else targets.withColumnRenamed("source", "of")
    shift = sums.withColumn("shift", F.sum("n").over(Window.partitionBy("source").orderBy("cell")) - F.col("n")).select(F.col("source").alias("of"), F.col("cell").alias("at"), "shift")
    within = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(within)).join(shift, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at"))).drop("of", "at")
    placed = placed.withColumn("start", F.col("upto") + F.col("shift") - F.col("size")).join(known, F.col("source").eqNullSafe(F.col("of")))
    placed = scratch.keep(placed.select("doc_id", "key", "tie", "size", "source_size", "target", "place", "start"), "placed")

    blocks = F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("size") - 1) / block_tokens)))
    pieces = placed.where("size > 0").select("doc_id", "key", "tie", "place", "start", "size", blocks.alias("block"))
    low = F.greatest("start", F.col("block") * block_tokens)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_tokens)
    partial = F.greatest(F.lit(0).cast("long"), F.least("high", F.col("block") * block_tokens + F.col("cut")) - F.col("low"))
    taken = pieces.withColumns({"low": low, "high": high}).join(schedule(spark, targets, block_tokens), ["place", "block"]).withColumn("partial", partial)
    cut_slot = F.when(F.col("partial") > 0, F.col("cut_slot"))
    taken = taken.withColumn("n", F.col("full") * (F.col("high") - F.col("low")) + F.col("partial")).groupBy("place", "start")
    taken = taken.agg(F.sum("n").alias("taken"), F.min(F.least("first", cut_slot)).alias("first_slot"), F.sum(F.col("full") + (F.col("partial") > 0).cast("long")).alias("slots"))
    # within a source, where a document of some size starts is its own place
    filled = placed.where("size > 0").join(taken, ["place", "start"], "left")
    rows = filled.unionByName(placed.where("size = 0"), allowMissingColumns=True)
    taken, slots = (F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("taken", "slots"))
    return rows.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", taken, "first_slot", slots)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || 'mix') AS key,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 3 * source_size AS most FROM s),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, place) AS i FROM w),
v AS (SELECT *, ((SELECT sum(source_size) FROM o) - coalesce((SELECT sum(most) FROM o p WHERE p.i < o.i), 0))::DOUBLE
             / ((SELECT sum(weight) FROM o) - coalesce((SELECT sum(weight) FROM o p WHERE p.i < o.i), 0))::DOUBLE AS level FROM o),
f AS (SELECT min(i) AS i FROM v WHERE level * weight <= most),
t AS (SELECT source, source_size, CASE WHEN v.i >= f.i THEN (SELECT level FROM v x, f y WHERE x.i = y.i) * weight ELSE most::DOUBLE END AS target FROM v, f),
p AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS goal,
             (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
g AS (SELECT DISTINCT source, source_size, goal, ceil(source_size / 256)::BIGINT AS blocks,
             row_number() OVER (ORDER BY source NULLS LAST) AS place FROM (SELECT DISTINCT source, source_size, goal FROM p) WHERE goal > 0),
h AS (SELECT *, goal // source_size * blocks + ceil((goal % source_size) / 256)::BIGINT AS needed,
             sum(goal) OVER (ORDER BY place)::DOUBLE / (SELECT sum(goal) FROM g)::DOUBLE AS high FROM g),
k AS (SELECT k, k * ((sqrt(5.0::DOUBLE) - 1) / 2) AS x FROM (SELECT unnest(range((SELECT ceil(sum(goal) / 256)::BIGINT FROM g))) AS k)),
m AS (SELECT k, coalesce(min(place), (SELECT max(place) FROM h)) AS place FROM k LEFT JOIN h ON high > x - floor(x) GROUP BY k),
q AS (SELECT place, k, row_number() OVER (PARTITION BY place ORDER BY k) - 1 AS r FROM m),
n AS (SELECT h.place, needed, (SELECT count(*) FROM q WHERE q.place = h.place) AS had FROM h),
z AS (SELECT place, r, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY place, r) - 1 AS k
      FROM (SELECT place, unnest(range(had, needed)) AS r FROM n WHERE had < needed)),
a AS (SELECT y.place, k, r % blocks * 256 AS low, r // blocks * source_size + r % blocks * 256 AS spot, source_size, goal
      FROM (SELECT place, k, r FROM q UNION ALL SELECT place, k, r FROM z) y JOIN h ON y.place = h.place),
b AS (SELECT place, k, low, low + least(256, source_size - low, goal - spot) AS high FROM a WHERE goal > spot),
c AS (SELECT p.doc_id, p.key, sum(least(p.start + p.size, b.high) - greatest(p.start, b.low))::BIGINT AS taken, min(k)::BIGINT AS first_slot, count(*)::BIGINT AS slots
      FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source JOIN b ON b.place = h.place AND b.low < p.start + p.size AND b.high > p.start WHERE p.size > 0 GROUP BY p.doc_id, p.key)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(slots, 0)::BIGINT AS slots
FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.key = c.key
"""
