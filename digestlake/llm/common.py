"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/digestlake"
#: Row keys (two longs each) up to which a side is broadcast, as counted.
SMALL_ROWS = 1 << 18
#: Bytes of rows that go to a Python worker at once, where the session sets no bound.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Bytes of text that a worker turns into Python strings at once.
SLICE_BYTES = 2 << 20
_scratch: list[str] = []


def prepared(df: DataFrame) -> SparkSession:
    """The session of df, with this package sent to the Python workers once.

    Rows go to Python in batches bounded by bytes, as texts may be long; a bound set by the user stays.
    """
    import digestlake

    spark = df.sparkSession
    sc = spark.sparkContext
    if getattr(sc, "_digestlake_sent", None) is None:
        top = os.path.dirname(os.path.abspath(digestlake.__file__))
        path = os.path.join(tempfile.mkdtemp(), "digestlake_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in (n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
        sc._digestlake_sent = path
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")
    return spark


def released() -> None:
    """Give memory that a scan has freed back to the system, as its worker goes on to other stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local default in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = DEFAULT_CHECKPOINT_DIR
        os.makedirs(where, exist_ok=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. Lazy results may still read it, so it goes when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage is cut and any executor can be lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(filesystem, path) of a URI on any store pyarrow knows; a bare path is a local or mounted one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@atexit.register
def _remove_scratch() -> None:
    for path in _scratch:
        try:
            fs, at = file_system(path)
            fs.delete_dir(at)
        except Exception:  # noqa: BLE001  the folder may be gone, or its store out of reach at exit
            continue


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores put before it until no column has it, in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two columns that tell its rows apart and hold still from scan to scan, and their names.

    A row is known by the file it is read from and its place there. docs that are not a plain Parquet scan are written
    to the shared folder first. Files are told apart by a 64-bit hash of their path.
    """
    file, place = unused(docs.columns, "file_key", "file_row")
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, "rows")
    try:
        meta = docs.metadataColumn("_metadata")
        keyed = docs.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(place))
        keyed.schema  # noqa: B018  analysed here: a source without row places raises
    except AnalysisException:
        docs = written(docs, "rows")
        meta = docs.metadataColumn("_metadata")
        keyed = docs.select("*", F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(place))
    return keyed, file, place


def without_rows(keyed: DataFrame, file: str, place: str, dropped: DataFrame) -> DataFrame:
    """keyed without the rows of dropped (file, place), and without its two key columns.

    Up to SMALL_ROWS dropped rows, as counted, are broadcast, so that texts are not shuffled; beyond, rows are joined
    by their keys.
    """
    gone = written(dropped.select(F.col(file).alias("__f"), F.col(place).alias("__p")).distinct(), "dropped")
    side = F.broadcast(gone) if gone.count() <= SMALL_ROWS else gone
    same = (keyed[file] == side["__f"]) & (keyed[place] == side["__p"])
    return keyed.join(side, same, "left_anti").drop(file, place)


def slices(column: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of a text column that hold about most_bytes each, one row at least."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 64
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield at, end - at
        at = end


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
