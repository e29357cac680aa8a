"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

A document's size is its number of words. Targets share the total of all sizes by weight, stop at
`most` times a source's size and pass the excess on (water filling: the level at which the shares
sum up is found with one window over the sources). Slots of one block of words each take the
golden-ratio points frac(t * phi) through the cumulative targets; a slot's rank in its source says
which block of the source's shuffled word stream it takes, epoch after epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, load

#: Weights by the sources' rank, the cap on a target, 1 / golden ratio.
WEIGHTS = (5, 2, 1)
MOST = 3
PHI = 0.6180339887498949
SLOTS = 1 << 16
BLOCK = 4096
#: Slots of one range, ranked together; shuffled documents of a source are summed in so many groups.
RANGE = 1 << 13
GROUPS = 4096
BINS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, total, target for a table of source and size; null is a source of its own, the last in order."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source from here on
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_ = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / open_)
    # the first level, in order of the ratios, that its own source's cap is not below
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    per = per.withColumn("target", F.least("cap", level * F.col("weight")))
    return per.select("source", "rank", "source_size", "total", "target")


def schedule(targets: DataFrame, slots: int = SLOTS, most_block: int = BLOCK, most: int = MOST) -> DataFrame:
    """rank (of the source), slot, block_size, place (the slot's rank in its source), one row for each slot.

    A block has total / slots words, between 1 and most_block, so the number of slots grows with the
    input once blocks have their full size.
    """
    spark = targets.sparkSession
    order = Window.orderBy("rank")
    edges = targets.withColumn("high", F.sum("target").over(order)).withColumn("all", F.sum("target").over(Window.partitionBy()))
    edges = edges.where("target > 0").select("rank", "source_size", "total", ((F.col("high") - F.col("target")) / F.col("all")).alias("low"), (F.col("high") / F.col("all")).alias("high"), F.greatest(F.lit(1), F.least(F.lit(most_block), F.floor(F.col("total") / slots))).cast("long").alias("block_size"))
    binned = edges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") * BINS), F.least(F.floor(F.col("high") * BINS), F.lit(BINS - 1)))))
    # each bin makes its share of the slots: those t whose point falls there are found by range of t
    ranges = edges.select("total", "block_size").distinct().select("block_size", F.ceil(F.col("total") / F.col("block_size")).alias("n"))
    made = ranges.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE))).alias("part"))
    made = made.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    made = made.select("part", F.explode(F.sequence(F.col("part") * RANGE, F.least(F.col("n"), (F.col("part") + 1) * RANGE) - 1)).alias("slot"))
    point = F.col("slot") * F.lit(PHI)
    made = made.withColumn("point", point - F.floor(point)).withColumn("bin", F.floor(F.col("point") * BINS))
    dealt = made.join(binned, "bin").where("point >= low AND point < high")
    local = F.row_number().over(Window.partitionBy("rank", "part").orderBy("slot")) - 1
    dealt = dealt.select("rank", "part", "slot", "source_size", "block_size", local.alias("local"))
    counts = dealt.groupBy("rank", "part").agg(F.count("*").alias("n"))
    counts = counts.select("rank", "part", (F.sum("n").over(Window.partitionBy("rank").orderBy("part")) - F.col("n")).alias("before"))
    out = dealt.join(counts, ["rank", "part"]).withColumn("place", F.col("before") + F.col("local"))
    blocks = F.ceil(F.col("source_size") / F.col("block_size"))
    out = out.withColumn("blocks", blocks).where(F.col("place") < F.col("blocks") * most)
    return out.select("rank", "slot", "block_size", "place", (F.col("place") % F.col("blocks")).alias("block"), F.floor(F.col("place") / F.col("blocks")).alias("epoch"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = "mix", slots: int = SLOTS, most_block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs (whole times) and extra (words of a last, partial time) per row.

    Null texts and texts without words have size 0 and nothing is taken of them; a null source is
    the last one; rows with equal ids or texts stay separate rows; an empty table gives none. Rows
    shuffle by md5 of seed and id, so a rerun takes the same.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = checkpoint(rows)  # the texts are read once
    targets = checkpoint(source_targets(rows, weights, most))
    plan = schedule(targets, slots, most_block, most)
    # a block occurs floor(n / blocks) or one more times, the first blocks once more
    times = plan.groupBy("rank", "block").agg(F.count("*").alias("times"), F.first("block_size").alias("block_size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    named = targets.withColumnRenamed("source", "of")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "rank", "source_size", "total", "target", key.alias("key"))
    rows = rows.withColumn("group", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    # the place of each document in its source's shuffled stream: groups first, then inside a group
    sums = rows.groupBy("rank", "group").agg(F.sum("size").alias("n"))
    sums = sums.select("rank", "group", (F.sum("n").over(Window.partitionBy("rank").orderBy("group")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("rank", "group").orderBy("key", "size")
    placed = rows.join(sums, ["rank", "group"]).withColumn("nth", F.row_number().over(inside))
    placed = placed.withColumn("at", F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("block_size", F.greatest(F.lit(1), F.least(F.lit(most_block), F.floor(F.col("total") / slots))).cast("long"))
    first, last = F.floor(F.col("at") / F.col("block_size")), F.floor((F.col("at") + F.col("size") - 1) / F.col("block_size"))
    cut = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    low = F.greatest("at", F.col("block") * F.col("block_size"))
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("block_size"))
    cut = cut.withColumn("words", F.coalesce(high - low, F.lit(0)))
    got = cut.join(times.select("rank", "block", "times"), ["rank", "block"], "left")
    got = got.groupBy("rank", "group", "nth", "doc_id", "source", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    return got.select("doc_id", "source", "size", "source_size", "target", "taken", epochs.alias("epochs"), (F.col("taken") - epochs * F.col("size")).alias("extra"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same from the rules alone: closed-form overlaps instead of joined blocks.
OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, sum(source_size) OVER ()::DOUBLE AS total FROM s),
fill AS (
  SELECT 0 AS step, r, weight, 3.0::DOUBLE * source_size AS cap, FALSE AS stopped, total, total / (sum(weight) OVER ()) AS level FROM w
  UNION ALL
  SELECT step + 1, r, weight, cap, stopped OR level * weight > cap, total,
         (total - sum(CASE WHEN stopped OR level * weight > cap THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN stopped OR level * weight > cap THEN 0 ELSE weight END) OVER ()
  FROM fill WHERE step < 40),
t AS (
  SELECT w.source, w.r, w.source_size, w.total, CASE WHEN f.stopped THEN f.cap ELSE f.level * f.weight END AS target
  FROM w JOIN fill f ON w.r = f.r AND f.step = 40),
e AS (
  SELECT *, sum(target) OVER (ORDER BY r) AS high, sum(target) OVER () AS everything,
         CAST(greatest(1, least(4096, floor(total / 65536))) AS BIGINT) AS b FROM t),
slots AS (SELECT unnest(range(CAST((SELECT ceil(max(total) / max(b)) FROM e) AS BIGINT))) AS slot),
points AS (SELECT slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE) AS p FROM slots),
k AS (
  SELECT e.r, least(count(p), 3 * CAST(ceil(any_value(e.source_size) / any_value(e.b)) AS BIGINT)) AS n
  FROM e LEFT JOIN points ON p >= (high - target) / everything AND p < high / everything GROUP BY e.r),
pos AS (
  SELECT d.*, e.source_size, e.target, e.b, k.n, CAST(ceil(e.source_size / e.b) AS BIGINT) AS blocks,
         sum(size) OVER (PARTITION BY e.r ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS at_
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN k ON k.r = e.r)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (n // blocks) + greatest(0, least(at_ + size, (n % blocks) * b) - at_) END AS BIGINT) AS taken
FROM pos
"""
