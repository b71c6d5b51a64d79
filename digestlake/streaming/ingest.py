"""Snapshots with optimistic commits, and a stream that keeps the latest value of each key.

A repository is a folder of immutable snapshot tables and one pointer file. A commit writes its snapshot first and then
claims the next generation by creating that generation's pointer, which only one writer can do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from digestlake.operators.folds import last_writer


class StaleRevision(RuntimeError):
    """Another commit came first."""


class SnapshotStore:
    """Named tables under path, versioned together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        top = self._path(f"{self.path}/log")
        if not self._fs.exists(top):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(top) if s.getPath().getName().endswith(".json"))

    def head(self) -> dict:
        """generation, revision and tables of the newest snapshot; generation 0 is empty."""
        found = self._pointers()
        return self.at(found[-1]) if found else {"generation": 0, "revision": None, "tables": {}}

    def at(self, generation: int) -> dict:
        raw = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/log/{generation}.json").collect())
        return json.loads(raw)

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        """A table as of a generation; readers of an old one are not disturbed by commits."""
        head = self.head() if generation is None else self.at(generation)
        return self.spark.read.parquet(f"{self.path}/{head['tables'][table]}")

    def commit(self, expected: str | None, **tables: DataFrame) -> dict:
        """Write tables as a new snapshot if the newest revision is the expected one; the others are carried over."""
        head = self.head()
        if head["revision"] != expected:
            raise StaleRevision(f"expected {expected}, found {head['revision']}")
        revision = uuid.uuid4().hex
        placed = dict(head["tables"])
        for name, rows in tables.items():
            placed[name] = f"data/{name}-{revision}"
            rows.write.parquet(f"{self.path}/{placed[name]}")
        new = {"generation": head["generation"] + 1, "revision": revision, "tables": placed}
        try:
            self._point(new, False)
        except Exception as e:
            raise StaleRevision(f"generation {new['generation']} was taken") from e
        return new

    def _point(self, snapshot: dict, replace: bool) -> None:
        out = self._fs.create(self._path(f"{self.path}/log/{snapshot['generation']}.json"), replace)
        try:
            out.write(bytearray(json.dumps(snapshot).encode()))
        finally:
            out.close()

    def _snapshots(self) -> list[dict]:
        """All snapshots, oldest first, in one read."""
        if not self._pointers():
            return []
        rows = self.spark.read.text(f"{self.path}/log", wholetext=True, pathGlobFilter="*.json").collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda s: s["generation"])

    def unreferenced(self) -> list[str]:
        """Data folders that no snapshot names."""
        top = self._path(f"{self.path}/data")
        used = {t for s in self._snapshots() for t in s["tables"].values()}
        names = [f"data/{s.getPath().getName()}" for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(n for n in names if n not in used)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop the tables of all but the newest keep generations; return the data folders that go.

        Folders that no generation names may belong to a commit under way and stay. Readers of a dropped generation
        fail, so keep must cover the longest of them. A dropped generation keeps its pointer, without tables, so that
        no late commit can claim it again. Pointers change before data goes: a run that is cut short leaves folders
        behind, which unreferenced then lists, and never a generation that names lost data.
        """
        if keep < 1:
            raise ValueError("the newest generation must stay")
        found = self._snapshots()
        old, kept = [s for s in found[:-keep] if s["tables"]], found[-keep:]
        dead = sorted({t for s in old for t in s["tables"].values()} - {t for s in kept for t in s["tables"].values()})
        for s in old:
            self._point(s | {"tables": {}}, True)
        for name in dead:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return dead


def keep_latest(stream: DataFrame, store: SnapshotStore, table: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch into table: the last row of each key in order stays.

    The batch number is kept beside the table, so a batch that is delivered again after a failure changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        head = store.head()
        done = store.read(f"{table}_batch").first()[0] if f"{table}_batch" in head["tables"] else -1
        if number <= done:
            return
        rows = batch.unionByName(store.read(table)) if table in head["tables"] else batch
        mark = batch.sparkSession.range(number, number + 1)
        store.commit(head["revision"], **{table: last_writer(rows, key, order), f"{table}_batch": mark})

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
