"""Publishing staged objects: limits, overlay, verification, an optimistic commit, and a new attempt if it came late."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.operators import sync
from digestlake.operators.graph import closure
from digestlake.plans.workspace import checkpointed
from digestlake.streaming.ingest import SnapshotStore, StaleRevision


class Rejected(RuntimeError):
    """A publication that may not become a snapshot; kind says why and subject names the first object or root."""

    def __init__(self, kind: str, subject: object):
        super().__init__(f"{kind}: {subject}")
        self.kind, self.subject = kind, subject


@dataclass(frozen=True)
class Limits:
    """The most that one publication may hold; the values are defaults that callers may change."""

    links_per_object: int = 1_000_000
    root_changes: int = 1024


def _refuse(kind: str, faults: DataFrame, column: str) -> None:
    """Raise if faults has a row, naming the least."""
    least = faults.agg(F.min(column)).first()[0]
    if least is not None:
        raise Rejected(kind, least)


def publish(store: SnapshotStore, objects: DataFrame, links: DataFrame, roots: DataFrame, removed: list[str] | None = None, expected: str | None = None, limits: Limits = Limits(), attempts: int = 3, expectations: DataFrame | None = None, targets: DataFrame | None = None) -> dict:
    """Commit objects (native_id, payload), links (src, dst) and roots (name, native_id); return the new snapshot.

    removed names roots that go. Staged records lie over those of the newest snapshot: one with equal
    payload and links changes nothing, a different one is an ImmutableConflict. Every object that a new root reaches must be there (MissingObject); targets
    of the roots that are there were checked when they were set and are not walked again. With an expected revision a
    later commit is a StaleRevision; without one the work is done anew over the newer snapshot, which also takes the
    place of pins: if a collection removed what was staged against, the new attempt finds it missing.

    expectations (name, native_id, null: no such root) are compared with the roots of the snapshot that the commit
    replaces; the first name that differs is a RootMismatch and nothing is committed. targets (native_id) are objects
    whose whole closure must be there, though no root names them; they are added to the table witnesses, on which later
    walks stop. Witnesses retain nothing.
    """
    staged, edges = checkpointed(objects.select("native_id", "payload").distinct()), checkpointed(links.select("src", "dst").distinct())
    named, removed = checkpointed(roots.select("name", "native_id").distinct()), removed or []
    _refuse("ConflictingRecords", staged.groupBy("native_id").count().where("count > 1"), "native_id")
    _refuse("ConflictingRoots", named.groupBy("name").count().where("count > 1"), "name")
    _refuse("TooManyLinks", edges.groupBy("src").count().where(F.col("count") > limits.links_per_object), "src")
    _refuse("UnstagedSource", edges.join(staged, edges["src"] == staged["native_id"], "left_anti"), "src")
    if (changes := named.count() + len(removed)) > limits.root_changes:
        raise Rejected("TooManyRoots", changes)
    for attempt in range(attempts):
        head = store.head()
        if expected is not None and head["revision"] != expected:
            raise StaleRevision(f"expected {expected}, found {head['revision']}")
        base = {name: store.read(name, head["generation"]) if name in head["tables"] else rows.where("false") for name, rows in (("objects", staged), ("links", edges), ("roots", named))}
        if expectations is not None:
            actual = base["roots"].select("name", F.col("native_id").alias("actual"))
            differs = expectations.join(actual, "name", "left").where(~F.col("native_id").eqNullSafe(F.col("actual")))
            _refuse("RootMismatch", differs, "name")
        outcome = sync.commit_objects(staged, base["objects"])
        _refuse("ImmutableConflict", outcome.where("outcome = 'ImmutableConflict'"), "native_id")
        again = outcome.where("outcome = 'NoOp'").select(F.col("native_id").alias("src"))
        new, old = (t.join(again, "src", "left_semi").select("src", "dst") for t in (edges, base["links"]))
        _refuse("ImmutableConflict", new.subtract(old).union(old.subtract(new)), "src")
        every = sync.overlay(staged, base["objects"], ["native_id"])
        walked = sync.overlay(edges, base["links"], ["src", "dst"])
        seeds, proven, tables = named.select("native_id"), base["roots"].select("native_id"), {}
        if "witnesses" in head["tables"]:
            witnesses = store.read("witnesses", head["generation"])
            # a collection may have taken a witness away since
            proven = proven.union(witnesses.join(base["objects"], "native_id", "left_semi"))
        if targets is not None:
            seeds = seeds.union(targets.select("native_id"))
            own = targets.select("native_id")
            tables["witnesses"] = (own.union(witnesses) if "witnesses" in head["tables"] else own).distinct()
        reached = closure(walked, seeds, stop=proven)
        _refuse("MissingObject", reached.join(every, "native_id", "left_anti"), "native_id")
        stay = base["roots"].where(~F.col("name").isin(removed)) if removed else base["roots"]
        try:
            return store.commit(head["revision"], objects=every, links=walked, roots=sync.overlay(named, stay, ["name"]), **tables)
        except StaleRevision:
            if expected is not None or attempt + 1 == attempts:
                raise
    raise ValueError("attempts must be at least 1")


def _no_roots(objects: DataFrame) -> DataFrame:
    return objects.select(F.lit("").alias("name"), "native_id").where("false")


def publish_unrooted(store: SnapshotStore, objects: DataFrame, links: DataFrame, **more) -> dict:
    """Publish records without naming them; a later publication may, and until then a collection may take them."""
    return publish(store, objects, links, _no_roots(objects), **more)


def publish_rooted(store: SnapshotStore, objects: DataFrame, links: DataFrame, name: str, target: str, **more) -> dict:
    """Publish records and set one root."""
    roots = objects.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(target).alias("native_id"))
    return publish(store, objects, links, roots, **more)


def publish_closures(store: SnapshotStore, objects: DataFrame, links: DataFrame, targets: DataFrame, **more) -> dict:
    """Publish records and prove the closures of targets (native_id), which no root needs to name."""
    return publish(store, objects, links, _no_roots(objects), targets=targets, **more)


def publish_if_roots_match(store: SnapshotStore, objects: DataFrame, links: DataFrame, roots: DataFrame, expectations: DataFrame, **more) -> dict:
    """Publish only while each root of expectations (name, native_id) is as expected."""
    return publish(store, objects, links, roots, expectations=expectations, **more)


def publish_at_revision(store: SnapshotStore, objects: DataFrame, links: DataFrame, roots: DataFrame, revision: str, **more) -> dict:
    """Publish only over the snapshot of revision, without another attempt."""
    return publish(store, objects, links, roots, expected=revision, **more)
