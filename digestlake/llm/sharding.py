"""Shards by minimax contiguous partition, with DataFrame operations only.

Documents with equal texts form an atomic group; groups are put in the order of their smallest doc_id. The smallest
shard capacity for which a greedy cut of that order needs no more than the given shards is found by binary search, and
the order is cut there. Running sums come from sums per part, so no task holds more than one part. The search runs on
the driver over the few group ends that any cut can fall on; where these are many, distributed passes narrow the
capacity down first.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from digestlake.llm.common import partitions, text_of, written

#: Group ends that the driver may hold while it searches.
HELD_ENDS = 200_000
#: Capacities that one distributed pass tries.
TRIES = 16


def greedy(ends: list[int], capacity: int, shards: int, total: int) -> list[int] | None:
    """Where a greedy cut ends each shard, or None if shards of this capacity do not hold all. ends: sorted sums."""
    cuts, at = [], 0
    for _ in range(shards):
        k = bisect_right(ends, at + capacity) - 1
        if k >= 0 and ends[k] > at:
            at = ends[k]
        cuts.append(at)
    return cuts if at >= total else None


def _passes(ends: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """The greedy cuts of several capacities, one aggregate per shard."""
    at = [[0] for _ in capacities]
    for _ in range(shards):
        tops = [F.max(F.when(F.col("end") <= c[-1] + cap, F.col("end"))).alias(f"c{i}") for i, (c, cap) in enumerate(zip(at, capacities))]
        row = ends.agg(*tops).first()
        for i, c in enumerate(at):
            c.append(max(c[-1], row[i] or 0))
    return [c[1:] for c in at]


def capacity_cuts(ends: DataFrame, total: int, largest: int, shards: int, held: int = HELD_ENDS) -> tuple[int, list[int]]:
    """The smallest capacity and its cuts, over a table with the running sum `end` of every group."""
    low, high = max(-(-total // shards), largest), max(-(-total // shards) + largest, largest)
    if total == 0:
        return 0, [0] * shards
    # cut k of any capacity c in [low, high] lies in (k * (c - largest), k * c]
    spans = [(k * max(0, low - largest), k * high) for k in range(1, shards + 1)]
    cuts_high: list[int] | None = None
    while True:
        near = ends.where(" OR ".join(f"end BETWEEN {a} AND {b}" for a, b in spans)).select("end")
        some = [r[0] for r in near.limit(held + 1).collect()]
        if len(some) <= held:
            break
        step = max(1, (high - low) // (TRIES - 1))
        tries = sorted({min(high, low + i * step) for i in range(TRIES)} | {high})
        found = _passes(ends, tries, shards)
        ok = next(i for i, c in enumerate(found) if c[-1] >= total)
        high, cuts_high = tries[ok], found[ok]
        if ok == 0 or tries[ok] - tries[ok - 1] == 1:
            return high, cuts_high
        low = tries[ok - 1] + 1
        spans = list(zip(found[ok - 1], cuts_high))
    some.sort()
    while low < high:
        middle = (low + high) // 2
        if greedy(some, middle, shards, total):
            high = middle
        else:
            low = middle + 1
    return high, greedy(some, high, shards, total) or cuts_high or []


def shard(docs: DataFrame, shards: int = 8, text_col: str = "text", held: int = HELD_ENDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 1; null text counts as empty. Equal texts share a shard. No cut of the
    groups in their order gives a smaller largest shard. slot numbers a shard's rows from 0 without gaps, in the order
    of groups and then of doc_id; repeated rows get slots of their own, null doc_ids come first. law is "bytes" and
    grown_shard null: this law promises nothing when the count of shards grows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = text_of(text_col).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    rows = written(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("group_bytes"))
    # groups are written first, so that the join's inputs are plain exchanges and a large group's rows can be split
    placed = rows.join(written(groups, "shard-groups"), "digest")
    # parts of the order: a large group spans parts, since its rows are told apart by doc_id
    order = ["first_id", "digest", "doc_id"]
    placed = written(placed, "shard-placed")
    parted = written(placed.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "shard-parts")
    sums = parted.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("group_bytes").alias("largest"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per part
    starts = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("bytes").over(running), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(running), F.lit(0)).alias("rows_before"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = parted.withColumn("own_bytes", F.sum("size").over(own)).withColumn("own_row", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    summed = summed.join(F.broadcast(starts), F.col("part") == F.col("p"))
    summed = summed.select("doc_id", "size", "text_crc32", "digest", (F.col("own_bytes") + F.col("bytes_before")).alias("sum"), (F.col("own_row") + F.col("rows_before") - 1).alias("place"))
    summed = written(summed, "shard-sums")
    ends = summed.groupBy("digest").agg(F.max("sum").alias("end"))
    ends = written(ends, "shard-ends")
    total, largest = sums.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("largest"), F.lit(0))).first()
    _, cuts = capacity_cuts(ends, total, largest, shards, held)
    # a row's shard is the number of cuts at or below the sum before its group's end; rows of a group lie between cuts
    number = sum(((F.col("sum") > F.lit(c)).cast("int") for c in cuts[:-1]), F.lit(0))
    numbered = summed.withColumn("shard", number)
    first = {r[0]: r[1] for r in numbered.groupBy("shard").agg(F.min("place")).collect()}  # a row per shard
    offset = F.coalesce(*[F.when(F.col("shard") == k, F.lit(v)) for k, v in sorted(first.items())], F.lit(0)) if first else F.lit(0)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - offset).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
