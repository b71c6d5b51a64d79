"""Aggregates: Merkle roll-ups, reassembly, payload collapse, last-writer-wins merges, layers and pack statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from digestlake.plans.workspace import checkpointed


def roll_up(children: DataFrame, parent: str, digest: Column, size: Column) -> DataFrame:
    """(parent, digest, size): the hash of the sorted child digests, and the recursive count of entries below."""
    listing = F.array_join(F.array_sort(F.collect_list(digest)), ",")
    return children.groupBy(parent).agg(F.sha2(listing, 256).alias("digest"), F.sum(size).cast("long").alias("size"))


def contribution(kind: Column, size: Column) -> Column:
    """What an entry adds to its directory's size: a directory one and its own size, anything else one."""
    return F.when(kind == "d", size + 1).otherwise(F.lit(1).cast("long"))


def reassemble(manifest: DataFrame) -> DataFrame:
    """(payload, bytes) from ordered chunks (payload, seq, bytes)."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "bytes")))
    return manifest.groupBy("payload").agg(F.array_join(F.transform(ordered, lambda x: x["bytes"]), "").alias("bytes"))


def collapse(records: DataFrame) -> DataFrame:
    """One row per payload: the smallest key that has it, its size, how many share it, and whether their sizes differ."""
    return records.groupBy("payload").agg(
        F.min(F.struct("namespace", "native_id")).alias("k"), F.max("payload_size").alias("size"), F.count("*").alias("shared"),
        (F.min("payload_size") != F.max("payload_size")).alias("conflict"),
    ).select("payload", F.col("k.namespace").alias("namespace"), F.col("k.native_id").alias("native_id"), "size", "shared", "conflict")


def last_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order. A partial aggregate, so a hot key is not gathered."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    last = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__last"))
    return last.select(*key, *[F.col(f"__last.{c}").alias(c) for c in (*order, *rest)])


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with first: whether each row is the first of its key. The minimum is a partial aggregate and joined back,
    so a hot key is not gathered; null keys are one key."""
    least = rows.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__least"))
    joined = rows.join(least, rows[key].eqNullSafe(least["__key"]))
    return joined.withColumn("first", F.col(order) == F.col("__least")).drop("__key", "__least")


def running(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows before each in order, 0 at first. order must tell rows apart; null
    values count as 0.

    Rows are dealt to ranges of order, summed inside each, and moved up by the sums of the ranges before: no task sorts
    more than its range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.withColumn("__value", value).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = dealt.groupBy("__part").agg(F.sum("__value").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn("__own", F.coalesce(own, F.lit(0))).join(F.broadcast(starts), "__part")
    return out.withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before", "__value")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in order, from 1. order must tell rows apart."""
    return running(rows, order, F.lit(1), name).withColumn(name, F.col(name) + 1)


def read_windows(rows: DataFrame, order: list[str], physical: list[Column | str], size: int = 65_536) -> DataFrame:
    """rows with window and place: order is cut into windows of size rows, each put into physical order.

    A window is sorted in one task and holds size rows, so that bound does not grow with rows.
    """
    dealt = numbered(rows, order, "__n").withColumn("window", F.floor((F.col("__n") - 1) / size).cast("long"))
    place = F.row_number().over(Window.partitionBy("window").orderBy(*physical))
    return dealt.withColumn("place", place.cast("long")).drop("__n")


def edit_facts(facts: DataFrame, keys: DataFrame, edited: Callable[[Column], Column]) -> DataFrame:
    """facts (identity, facts) after an edit of keys (identity): edited(fact, null where there is none) replaces the
    fact, null removes it. Identities that are not asked for stay. Repeated keys are edited once."""
    wanted = keys.select("identity").distinct().withColumn("__wanted", F.lit(True))
    both = facts.join(wanted, "identity", "full_outer")
    changed = F.when(F.col("__wanted"), edited(F.col("facts"))).otherwise(F.col("facts"))
    return both.select("identity", changed.alias("facts")).where(F.col("facts").isNotNull())


def clear_facts(facts: DataFrame, tombstone: str, generation: str) -> DataFrame:
    """facts without those that say something: empty ones stay, tombstone is one of them, and the fact of generation is
    the next number (1 where there is none)."""
    names = ("identity", "facts")
    stays = facts.where((F.octet_length("facts") == 0) & ~F.col("identity").isin(tombstone, generation)).select(*names)
    number = F.coalesce(F.max(F.when(F.col("identity") == generation, F.col("facts").cast("long"))), F.lit(0)) + 1
    counted = facts.agg(number.cast("string").alias("facts")).select(F.lit(generation).alias("identity"), "facts")
    marked = counted.select(F.lit(tombstone).alias("identity"), F.lit("").alias("facts"))
    return stays.unionByName(counted).unionByName(marked)


def generation_gaps(runs: DataFrame) -> DataFrame:
    """Runs (low, high) in order, with Gap, Overlap or Ok against the run before."""
    before = F.lag("high").over(Window.orderBy("low"))
    status = F.when(before.isNull() | (F.col("low") == before + 1), "Ok").when(F.col("low") > before + 1, "Gap").otherwise("Overlap")
    return runs.withColumn("status", status)


def ancestors(path: Column) -> Column:
    """Proper ancestor paths of a slash-separated path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def path_conflicts(files: DataFrame) -> DataFrame:
    """(path, below): files that are a proper prefix, on segments, of other paths. Ancestors make it an equi-join."""
    below = files.select(F.col("path").alias("below"), F.explode(ancestors(F.col("path"))).alias("path")).where("path != below").distinct()
    return below.join(files.select("path").distinct(), "path")


def merge_layers(layers: DataFrame) -> DataFrame:
    """The file tree of stacked layers (layer, path, whiteout, node).

    A whiteout removes its path and what lies below from lower layers only; of what is left the highest layer's entry
    wins, and an entry drops lower entries below its path.
    """
    wiped = layers.where("whiteout").select(F.col("path").alias("__w"), F.col("layer").alias("__wl")).distinct()
    files = layers.where("NOT whiteout")
    spots = files.select("layer", "path", F.explode(F.array_distinct(F.concat(ancestors(F.col("path")), F.array("path")))).alias("__a"))
    gone = spots.join(wiped, (spots["__a"] == wiped["__w"]) & (wiped["__wl"] > spots["layer"])).select("layer", "path").distinct()
    left = files.join(gone, ["layer", "path"], "left_anti")
    upper = left.select(F.col("path").alias("__u"), F.col("layer").alias("__ul")).distinct()
    low = left.select("layer", "path", F.explode(ancestors(F.col("path"))).alias("__a")).where("__a != path")
    over = low.join(upper, (low["__a"] == upper["__u"]) & (upper["__ul"] > low["layer"])).select("layer", "path").distinct()
    return last_writer(left.join(over, ["layer", "path"], "left_anti").select("path", "layer", "node"), ["path"], ["layer"])


def pack_garbage(entries: DataFrame, percent: int = 50, forced: bool = False) -> DataFrame:
    """Per pack its dead and whole bytes, and Rewrite where dead reaches the percentage, nothing lives, or it is forced."""
    dead = F.sum(F.when(F.col("dead"), F.col("framed_len")).otherwise(0)).cast("long")
    out = entries.groupBy("pack").agg(dead.alias("dead_bytes"), F.sum("framed_len").cast("long").alias("body_bytes"), F.sum(F.when(F.col("dead"), 0).otherwise(1)).cast("long").alias("live"))
    rewrite = (F.col("dead_bytes") > 0) & ((F.col("dead_bytes") * 100 >= F.col("body_bytes") * percent) | (F.col("live") == 0) | F.lit(forced))
    return out.withColumn("action", F.when(rewrite, "Rewrite").when(F.col("dead_bytes") > 0, "Tombstone").otherwise("Keep"))


def offsets(manifest: DataFrame) -> DataFrame:
    """manifest with each chunk's offset, the sum of the sizes before it."""
    before = Window.partitionBy("payload").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))


def covering(manifest: DataFrame, low: int, size: int) -> DataFrame:
    """Chunks that bytes [low, low + size) touch, for payloads that have them; a range past the end is none of theirs."""
    total = F.sum("size").over(Window.partitionBy("payload"))
    placed = offsets(manifest).withColumn("total", total)
    return placed.where((F.col("total") >= low + size) & (F.col("offset") < low + size) & (F.col("offset") + F.col("size") > low)).drop("total")


def canonical_violations(links: DataFrame) -> DataFrame:
    """Links that are not strictly above the one before them in their object's order."""
    before = F.lag("dst").over(Window.partitionBy("src").orderBy("ordinal"))
    return links.withColumn("before", before).where(F.col("before") >= F.col("dst")).drop("before")


def compaction_level(runs: Column) -> Column:
    """How many runs a carry merges when one is added to runs: the trailing one bits, as in a binary counter."""
    return F.length(F.regexp_extract(F.bin(runs), "1*$", 0))
