"""Import of several directory trees as one publication: files are hashed, directories are rolled up from the deepest."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.operators.folds import contribution
from digestlake.plans.workspace import checkpointed
from digestlake.streaming.ingest import SnapshotStore
from digestlake.streaming.publish import publish

#: What an earlier import knows of a file.
CACHE = "root string, path string, size long, modified timestamp, digest string"


def listed(spark: SparkSession, tops: dict[str, str], content: bool = False) -> DataFrame:
    """(root, path, size, modified[, digest]) of the files below each top, by its name; bytes are read only for digest.

    Files without bytes have the time 0.
    """
    out, names = None, []
    for name, top in tops.items():
        inside = top.rstrip("/") + "/"
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
        # Spark reads no rows from files without bytes, but has them in the file index that it keeps on the driver
        names += [(name, unquote(path).split(inside, 1)[1]) for path in rows.inputFiles()]
        relative = F.element_at(F.split(F.col("path"), F.concat(F.lit("\\Q"), F.lit(inside), F.lit("\\E")), 2), 2)
        digest = [F.sha2("content", 256).alias("digest")] if content else []
        rows = rows.select(F.lit(name).alias("root"), relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *digest)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no trees to import")
    if not names:
        return out
    every = spark.createDataFrame(names, "root string, path string")
    rest = every.join(out.select("root", "path"), ["root", "path"], "left_anti")
    digest = [F.sha2(F.lit(b""), 256).alias("digest")] if content else []
    return out.unionByName(rest.select("root", "path", F.lit(0).cast("long").alias("size"), F.timestamp_seconds(F.lit(0)).alias("modified"), *digest))


def hashed(spark: SparkSession, tops: dict[str, str], cache: DataFrame | None = None) -> DataFrame:
    """Rows of CACHE for all files below tops.

    A file that cache has with the same size and time keeps its digest. Bytes are read of files newer than all of cache,
    which the source can filter by, and of all files only if an older one is not in cache as it is.
    """
    newest = cache.agg(F.max("modified")).first()[0] if cache is not None else None
    if newest is None:
        return checkpointed(listed(spark, tops, content=True))
    same = ["root", "path", "size", "modified"]
    old = listed(spark, tops).where(F.col("modified") <= F.lit(newest))
    known = checkpointed(old.join(cache.select(*same, "digest").distinct(), same, "left"))
    read = listed(spark, tops, content=True)
    if known.where("digest IS NULL").isEmpty():
        return checkpointed(known.unionByName(read.where(F.col("modified") > F.lit(newest))))
    return checkpointed(read)


def rolled_up(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """objects (native_id, payload, size), links (src, dst) and roots (name, native_id) of files (root, path, size, digest).

    A directory's payload is its listing of kind, digest, size and name, in order of name, and its id the hash of that;
    its size counts the entries below it. One aggregate for each depth, deepest first; a directory is one object, so
    its own listing, and no more, is in one row. A path that is both a file and a directory raises ValueError.
    """
    parts = F.split("path", "/")
    rows = checkpointed(files.select("root", F.size(parts).alias("depth"), F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1)).alias("dir"), F.element_at(parts, -1).alias("name"), F.lit("f").alias("kind"), "digest", "size"))
    objects = rows.select(F.col("digest").alias("native_id"), F.col("digest").alias("payload"), "size").distinct()
    links, level = None, None
    for depth in range(rows.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0], 0, -1):
        entries = rows.where(F.col("depth") == depth).drop("depth")
        if level is not None:
            above = F.split("path", "/")
            upper = F.concat_ws("/", F.slice(above, 1, F.size(above) - 1)).alias("dir")
            entries = entries.unionByName(level.select("root", upper, F.element_at(above, -1).alias("name"), F.lit("d").alias("kind"), "digest", "size"))
        entries = checkpointed(entries)
        if not entries.groupBy("root", "dir", "name").count().where("count > 1").isEmpty():
            raise ValueError(f"two entries of one name at depth {depth}")
        line = F.concat_ws(" ", "kind", "digest", F.col("size").cast("string"), "name")
        listing = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n")
        folded = entries.groupBy("root", "dir").agg(F.sha2(listing, 256).alias("digest"), F.sum(contribution(F.col("kind"), F.col("size"))).cast("long").alias("size"))
        level = checkpointed(folded.withColumnRenamed("dir", "path"))
        held = entries.select("root", F.col("dir").alias("path"), F.col("digest").alias("dst"))
        made = held.join(level, ["root", "path"]).select(F.col("digest").alias("src"), "dst").distinct()
        links = made if links is None else links.unionByName(made)
        objects = objects.unionByName(level.select(F.col("digest").alias("native_id"), F.col("digest").alias("payload"), "size"))
    if level is None:
        raise ValueError("no files to import")
    return objects.distinct(), links.distinct(), level.select(F.col("root").alias("name"), F.col("digest").alias("native_id"))


def import_forest(store: SnapshotStore, tops: dict[str, str], cache: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """Publish the trees below tops (root name -> folder) in one commit; return its snapshot and the cache for the next.

    All roots move together or none does. Empty directories are not listed by the source and are left out, as are
    permissions and symbolic links.
    """
    files = hashed(store.spark, tops, cache)
    objects, links, roots = rolled_up(files)
    return publish(store, objects.select("native_id", "payload"), links, roots), files
