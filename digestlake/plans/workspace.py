"""Cutting lineage in the folder that the cluster shares, and reading tables."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "/tmp/checkpoints/digestlake"
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_cuts: list[str] = []


def shipped(spark: SparkSession) -> SparkSession:
    """spark, with this package sent to its Python workers once. Rows go to Python in batches of bounded bytes, as
    payloads may be long; a bound set by the user stays."""
    import digestlake

    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")
    sc = spark.sparkContext
    if getattr(sc, "_digestlake_sent", None) is None:
        top = os.path.dirname(os.path.abspath(digestlake.__file__))
        path = os.path.join(tempfile.mkdtemp(), "digestlake_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in (n for n in names if n.endswith(".py")):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(top)))
        sc.addPyFile(path)
        sc._digestlake_sent = path
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once as Parquet in spark.checkpoint.dir (or a default in local mode where that is unset) and read back.

    An RDD checkpoint computes its input twice and hides its size; a table is computed once and its size lets the
    planner broadcast a small frontier. The folder goes when the driver ends.
    """
    path = _cut(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df written like checkpointed, dealt to buckets of key: joins and aggregates by key read it without a shuffle."""
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    write = df.write.format("parquet").option("compression", "zstd").option("path", _cut(spark))
    write.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name goes: what is read is known by now and the files are not the catalog's
    return out


def _cut(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = DEFAULT_DIR
    path = f"{top.rstrip('/')}/cut-{uuid.uuid4().hex}"
    _cuts.append(path)
    return path


@atexit.register
def _remove_cuts() -> None:
    from pyarrow import fs

    for path in _cuts:
        try:
            store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            store.delete_dir(at)
        except Exception:  # noqa: BLE001  the folder may be gone, or its store out of reach at exit
            continue


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
