"""Moving named closures from one repository to another: plan, receive, verify, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.operators.graph import closure
from digestlake.operators.sync import overlay
from digestlake.plans.workspace import checkpointed
from digestlake.streaming.ingest import SnapshotStore, StaleRevision
from digestlake.streaming.publish import Limits, Rejected, publish


def _refuse(kind: str, faults: DataFrame, column: str) -> None:
    least = faults.agg(F.min(column)).first()[0]
    if least is not None:
        raise Rejected(kind, least)


def _table(store: SnapshotStore, head: dict, name: str, schema: str) -> DataFrame:
    if name in head["tables"]:
        return store.read(name, head["generation"])
    return store.spark.createDataFrame([], schema)


def transfer(source: SnapshotStore, target: SnapshotStore, names: list[str] | None = None, limits: Limits = Limits(), attempts: int = 3) -> dict:
    """Bring the roots of names (all if None) and what they reach from source to target; return the new snapshot.

    Both stores hold objects (native_id, payload), links (src, dst), roots (name, native_id) and payloads (payload,
    bytes). What target has is not walked or sent again. Received bytes are hashed and held against their payload id
    before they are stored: a wrong one raises CorruptPayload, an absent one MissingPayload, an object without record
    MissingObject, and then target is as before. Bytes are committed first; nothing names them until the objects and
    roots are published, so a run that is cut short leaves only unreferenced payloads.
    """
    head = source.head()
    objects, links, roots, bytes_ = (_table(source, head, n, s) for n, s in (("objects", "native_id string, payload string"), ("links", "src string, dst string"), ("roots", "name string, native_id string"), ("payloads", "payload string, bytes binary")))
    wanted = checkpointed(roots if names is None else roots.where(F.col("name").isin(names)))
    if names is not None:
        lost = sorted(set(names) - {r.name for r in wanted.select("name").collect()})  # no more than were asked for
        if lost:
            raise Rejected("MissingRoot", lost[0])
    for attempt in range(attempts):
        now = target.head()
        have = _table(target, now, "objects", "native_id string, payload string")
        stored = _table(target, now, "payloads", "payload string, bytes binary")
        reached = closure(links, wanted, stop=have)
        need = checkpointed(reached.select("native_id").distinct().join(have, "native_id", "left_anti"))
        moved = checkpointed(objects.join(need, "native_id", "left_semi"))
        _refuse("MissingObject", need.join(moved, "native_id", "left_anti"), "native_id")
        asked = moved.select("payload").distinct().join(stored, "payload", "left_anti")
        received = checkpointed(bytes_.join(asked, "payload", "left_semi").dropDuplicates(["payload"]))
        _refuse("CorruptPayload", received.where(F.sha2("bytes", 256) != F.col("payload")), "payload")
        _refuse("MissingPayload", asked.join(received, "payload", "left_anti"), "payload")
        try:
            if not received.isEmpty():
                target.commit(now["revision"], payloads=overlay(received, stored, ["payload"]))
            edges = links.join(need.select(F.col("native_id").alias("src")), "src", "left_semi")
            return publish(target, moved.select("native_id", "payload"), edges, wanted.select("name", "native_id"), limits=limits, attempts=attempts)
        except StaleRevision:
            if attempt + 1 == attempts:
                raise
    raise ValueError("attempts must be at least 1")
