"""Writing trees out: a file per path, by tasks, on any store pyarrow knows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.operators import graph
from digestlake.plans.workspace import shipped
from digestlake.sources.archives import check_path


def checkout(files: DataFrame, top: str) -> DataFrame:
    """Write files (path, bytes) below top; return (path, size) of what was written.

    top must be absent or empty. Paths that would leave it, are absolute or have empty parts raise before anything of
    their batch is written. A file is written under a temporary name beside its own and then renamed, so no half-written
    file is ever seen under its path, and a task that runs again writes the same.
    """
    from pyarrow import fs

    shipped(files.sparkSession)
    uri = top if "://" in top else f"file://{top}"
    store, at = fs.FileSystem.from_uri(uri)
    if store.get_file_info(at).type != fs.FileType.NotFound and store.get_file_info(fs.FileSelector(at)):
        raise FileExistsError(f"{top} is not empty")
    store.create_dir(at, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, where = fs.FileSystem.from_uri(uri)
        for pdf in batches:
            paths, sizes = [check_path(path) for path in pdf["path"]], []
            for path, raw in zip(paths, pdf["bytes"]):
                raw = bytes(raw or b"")
                folder, _, name = f"{where}/{path}".rpartition("/")
                own.create_dir(folder, recursive=True)
                staged = f"{folder}/.{uuid.uuid4().hex}.part"
                with own.open_output_stream(staged, compression=None) as out:
                    out.write(raw)
                own.move(staged, f"{folder}/{name}")
                sizes.append(len(raw))
            yield pd.DataFrame({"path": paths, "size": sizes})

    return files.selectExpr("path", "cast(bytes as binary) as bytes").mapInPandas(write, "path string, size long")


def checkout_tree(entries: DataFrame, root: str, blobs: DataFrame, top: str) -> DataFrame:
    """Write the tree of directory root: entries (dir, name, kind, digest, size) and blobs (digest, bytes).

    Files and executables (f, x) are written with their bytes. A file without bytes raises, as half a tree is no tree.
    """
    start = entries.sparkSession.createDataFrame([("", root)], "root string, native_id string")
    files = graph.tree_paths(entries, start).where("kind IN ('f', 'x')")
    own = files.join(blobs.select("digest", "bytes"), "digest", "left")
    held = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("no bytes for "), F.col("path")))).otherwise(F.col("bytes"))
    return checkout(own.select("path", held.alias("bytes")), top)
