"""Rewriting packs and shards: what moves, where it goes, and what stays untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from digestlake.operators.folds import last_writer, pack_garbage


def compacted(entries: DataFrame, percent: int = 50, forced: bool = False) -> DataFrame:
    """(pack, chunk, framed_len, old_pack, offset) after compaction of entries (pack, chunk, framed_len, dead).

    Live entries of a pack that is to be rewritten go to a new pack, named after the old one, gapless in chunk order.
    Other packs keep all their entries, tombstones included, and have no offset here since their bytes do not move. Writers bound the size of a pack, so the
    order within one fits a task.
    """
    plan = pack_garbage(entries, percent, forced).select("pack", "action")
    rows = entries.join(plan, "pack").where((F.col("action") != "Rewrite") | ~F.col("dead"))
    moves = F.col("action") == "Rewrite"
    before = Window.partitionBy("pack").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.when(moves, F.coalesce(F.sum("framed_len").over(before), F.lit(0)).cast("long"))
    return rows.select(F.when(moves, F.concat("pack", F.lit("+"))).otherwise(F.col("pack")).alias("pack"), "chunk", "framed_len", F.col("pack").alias("old_pack"), offset.alias("offset"))


def rewritten_shards(base: DataFrame, delta: DataFrame, key: list[str], order: list[str], shard: Column, gone: Column | None = None) -> DataFrame:
    """The new rows of the shards that delta touches, with their shard; other shards need no rewriting.

    base and delta have the same columns. The last row of a key in order stays, and goes if gone holds for it. A shard
    whose rows are all gone gives no row.
    """
    touched = delta.select(shard.alias("shard")).distinct()
    held = base.withColumn("shard", shard).join(touched, "shard", "left_semi")
    rows = last_writer(held.unionByName(delta.withColumn("shard", shard)), ["shard", *key], order)
    return rows if gone is None else rows.where(~gone)


def carried_runs(runs: DataFrame, key: list[str], order: list[str], levels: int = 40) -> DataFrame:
    """(level, key..., ...) of runs (run, key..., ...) numbered from 0, merged as a binary counter carries.

    With n runs, level l has a run if bit l of n is set; older runs are in higher levels. In each level the last row of
    a key in order stays. The levels of a run follow from n alone, so all merges are one aggregate.
    """
    n = runs.agg((F.max("run") + 1).cast("long").alias("n"))  # one row
    placed = runs.join(F.broadcast(n))
    bit = lambda i: F.shiftright(F.col("n"), i).bitwiseAND(F.lit(1)) == 1
    # bits of n from the top: a run belongs to the first level whose runs, with all above it, reach past its number
    end = lambda i: F.shiftright(F.col("n"), i) * F.lit(1 << i)
    level = F.coalesce(*[F.when(bit(i) & (F.col("run") < end(i)), F.lit(i)) for i in range(levels - 1, -1, -1)])
    return last_writer(placed.withColumn("level", level).drop("n"), ["level", *key], order)
