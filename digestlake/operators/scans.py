"""Reads: snapshot scans, prefix and keyset ranges, and batch lookups that keep the caller's order and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def created_through(objects: DataFrame, generation: int) -> DataFrame:
    """The snapshot of a generation: what was created up to it."""
    return objects.where(F.col("created_generation") <= generation)


def under(name: Column, prefix: str) -> Column:
    """name is the prefix itself or lies below it, on segment boundaries."""
    return (name == prefix) | name.startswith(prefix.rstrip("/") + "/")


def prefix_end(prefix: bytes) -> bytes | None:
    """The first key after all keys with a prefix: its last byte below 0xFF is raised; none if there is no such byte."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def key_page(rows: DataFrame, key: str, prefix: str, after: str | None, limit: int, size: Column | None = None, budget: int = 16 << 20) -> DataFrame:
    """The first limit rows with a key under prefix and above after; has_more tells whether there are others.

    With size, the bytes of a row, the page also ends before the row that would take it over budget.
    """
    picked = rows.where(F.col(key).startswith(prefix))
    if after is not None:
        picked = picked.where(F.col(key) > after)
    # one row more than asked for shows whether the page is the last
    looked = picked.orderBy(key).limit(limit + 1).withColumn("__n", F.row_number().over(Window.orderBy(key)))
    keeps = F.col("__n") <= limit
    if size is not None:
        keeps = keeps & (F.sum(size).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) <= budget)
    looked = looked.withColumn("__keeps", keeps)
    return looked.withColumn("has_more", ~F.min("__keeps").over(Window.partitionBy())).where("__keeps").drop("__n", "__keeps")


def shard_map(rows: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """(shard, first, last): the range of keys in each shard of rows, dealt by the first digits of their keys."""
    return rows.groupBy(F.substring(key, 1, digits).alias("shard")).agg(F.min(key).alias("first"), F.max(key).alias("last"))


def shard_lookup(requested: DataFrame, rows: DataFrame, key: str, columns: list[str], digits: int = 2) -> DataFrame:
    """requested (..., key) with the shard that can hold each key (null: none can) and the columns found in it.

    A key outside the range of its shard is answered by the map alone. Both joins are on the shard or on shard and key,
    so rows stored by shard are neither read nor shuffled beyond the shards asked for.
    """
    zones = shard_map(rows, key, digits)
    at = requested.withColumn("__zone", F.substring(key, 1, digits))
    inside = (at["__zone"] == zones["shard"]) & at[key].between(zones["first"], zones["last"])
    routed = at.join(zones, inside, "left").drop("__zone", "first", "last")
    held = rows.select(F.substring(key, 1, digits).alias("__shard"), F.col(key).alias("__key"), *columns)
    return routed.join(held, (routed["shard"] == held["__shard"]) & (routed[key] == held["__key"]), "left").drop("__shard", "__key")


def lookup(requested: DataFrame, rows: DataFrame, key: str, columns: list[str], found: Column | None = None) -> DataFrame:
    """requested (ordinal, key) left-joined to rows: order and repeats of the request stay, unknown keys give nulls."""
    right = rows.where(found) if found is not None else rows
    right = right.select(F.col(key).alias("__key"), *columns)
    return requested.join(right, requested[key] == right["__key"], "left").drop("__key")


def resolve_unique(objects: DataFrame, ids: DataFrame) -> DataFrame:
    """Short untyped ids to keys: the count of matches, and the key where it is one."""
    counts = objects.select(F.substring("native_id", 1, 4).alias("oid"), "namespace", "native_id").groupBy("oid").agg(F.count("*").alias("matches"), F.min("native_id").alias("one"))
    return ids.join(counts, "oid", "left").select("oid", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("one")).alias("native_id"))


def read_range(payload: Column, offset: int, size: int) -> Column:
    """Bytes [offset, offset + size) of a payload, cut at its end."""
    return F.substring(payload.cast("binary"), offset + 1, size)
