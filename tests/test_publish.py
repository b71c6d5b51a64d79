"""The publication of staged objects over a snapshot store."""

import hashlib

import pytest

from digestlake.streaming.ingest import SnapshotStore, StaleRevision
from digestlake.sources.forest import hashed, import_forest, rolled_up
from digestlake.streaming.publish import Limits, Rejected, publish, publish_at_revision, publish_closures, publish_if_roots_match, publish_rooted, publish_unrooted


@pytest.fixture
def stage(spark):
    def make(objects, links=(), roots=()):
        return (
            spark.createDataFrame(list(objects), "native_id string, payload string"),
            spark.createDataFrame(list(links), "src string, dst string"),
            spark.createDataFrame(list(roots), "name string, native_id string"),
        )

    return make


def test_publish(spark, tmp_path, stage):
    store = SnapshotStore(spark, str(tmp_path / "repo"))
    first = publish(store, *stage([("a", "1"), ("b", "2")], [("a", "b")], [("top", "a")]))
    assert first["generation"] == 1
    # an equal record is no change; the walk stops at what a root has
    second = publish(store, *stage([("c", "3"), ("b", "2")], [("c", "a")], [("next", "c")]), removed=["top"], expected=first["revision"])
    assert {r.native_id for r in store.read("objects").collect()} == {"a", "b", "c"}
    assert {tuple(r) for r in store.read("roots").collect()} == {("next", "c")}
    assert {tuple(r) for r in store.read("links").collect()} == {("a", "b"), ("c", "a")}
    for kind, staged, more in (
        ("ImmutableConflict", stage([("a", "9")]), {}),
        ("ImmutableConflict", stage([("c", "3")], [("c", "b")]), {}),
        ("MissingObject", stage([("d", "4")], [("d", "gone")], [("d", "d")]), {}),
        ("ConflictingRecords", stage([("e", "1"), ("e", "2")]), {}),
        ("ConflictingRoots", stage([], [], [("x", "a"), ("x", "b")]), {}),
        ("UnstagedSource", stage([], [("a", "c")]), {}),
        ("TooManyLinks", stage([("f", "1")], [("f", "a"), ("f", "b")]), {"limits": Limits(links_per_object=1)}),
        ("TooManyRoots", stage([], [], [("x", "a"), ("y", "b")]), {"limits": Limits(root_changes=1)}),
    ):
        with pytest.raises(Rejected) as e:
            publish(store, *staged, **more)
        assert e.value.kind == kind
    with pytest.raises(StaleRevision):
        publish(store, *stage([("g", "1")]), expected=first["revision"])
    assert store.head()["revision"] == second["revision"]


def test_a_late_publication_tries_again(spark, tmp_path, stage, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "repo"))
    publish(store, *stage([("a", "1")], [], [("top", "a")]))
    commit, late = store.commit, []

    def slow(expected, **tables):
        if not late:
            late.append(True)
            other = SnapshotStore(spark, store.path)
            publish(other, *stage([("b", "2")], [], [("other", "b")]))
        return commit(expected, **tables)

    monkeypatch.setattr(store, "commit", slow)
    done = publish(store, *stage([("c", "3")], [], [("mine", "c")]))
    assert done["generation"] == 3
    assert {r.name for r in store.read("roots").collect()} == {"top", "other", "mine"}


def test_transfer_end_to_end(spark, tmp_path):
    import hashlib

    from digestlake.streaming.transfer import transfer

    sha = lambda x: hashlib.sha256(x).hexdigest()
    frame = spark.createDataFrame
    body = {k: f"body of {k}".encode() for k in "abcdx"}

    def commit(store, bodies, links, roots):
        head = store.head()
        store.commit(
            head["revision"],
            objects=frame([(k, sha(body[k])) for k in body], "native_id string, payload string"),
            links=frame(links, "src string, dst string"),
            roots=frame(roots, "name string, native_id string"),
            payloads=frame([(sha(body[k]), v) for k, v in bodies.items()], "payload string, bytes binary"),
        )

    source, target = SnapshotStore(spark, str(tmp_path / "from")), SnapshotStore(spark, str(tmp_path / "to"))
    links = [("a", "b"), ("a", "c"), ("d", "c"), ("d", "x")]
    commit(source, body, links, [("one", "a"), ("two", "d")])
    transfer(source, target, ["one"])
    assert {r.native_id for r in target.read("objects").collect()} == {"a", "b", "c"}
    assert {(r.payload, bytes(r.bytes)) for r in target.read("payloads").collect()} == {(sha(body[k]), body[k]) for k in "abc"}
    before = target.head()
    for bodies, kind in ((body | {"x": b"damaged"}, "CorruptPayload"), ({k: v for k, v in body.items() if k != "x"}, "MissingPayload")):
        commit(source, bodies, links, [("one", "a"), ("two", "d")])
        with pytest.raises(Rejected) as e:
            transfer(source, target)
        assert e.value.kind == kind and target.head() == before
    commit(source, body, [*links, ("x", "gone")], [("two", "d")])
    with pytest.raises(Rejected) as e:
        transfer(source, target, ["two"])
    assert e.value.kind == "MissingObject"
    with pytest.raises(Rejected) as e:
        transfer(source, target, ["nowhere"])
    assert e.value.kind == "MissingRoot"
    commit(source, body, links, [("one", "a"), ("two", "d")])
    transfer(source, target)
    assert {r.name for r in target.read("roots").collect()} == {"one", "two"} and target.read("objects").count() == 5


def test_deep_trees_and_checkout(spark, tmp_path):
    from digestlake.operators import graph
    from digestlake.sources.checkout import checkout, checkout_tree

    entries = [(f"d{k}", f"n{k}", "d", f"d{k + 1}", 0) for k in range(40)] + [("d40", "leaf", "f", "blob", 4), ("d0", "run", "x", "blob", 4)]
    entries = spark.createDataFrame(entries, "dir string, name string, kind string, digest string, size long")
    top = spark.createDataFrame([("r", "d0")], "root string, native_id string")
    assert graph.tree_paths(entries, top).count() == 42
    with pytest.raises(graph.TraversalLimit):
        graph.tree_paths(entries, top, 32)
    spine = {r.path: r.spine for r in graph.path_spines(entries, top).collect()}
    assert spine["run"] == ["d0", "blob"] and spine["n0/n1"] == ["d0", "d1", "d2"]
    blobs = spark.createDataFrame([("blob", bytearray(b"data"))], "digest string, bytes binary")
    out = checkout_tree(entries, "d0", blobs, str(tmp_path / "out")).collect()
    assert len(out) == 2 and (tmp_path / "out" / "run").read_bytes() == b"data"
    assert not [p for p in (tmp_path / "out").rglob(".*")]
    for bad in ("../x", "/x", "a//b", "a/../../b"):
        with pytest.raises(Exception, match="no relative path"):
            checkout(spark.createDataFrame([(bad, bytearray(b"1"))], "path string, bytes binary"), str(tmp_path / "bad")).collect()
    assert not (tmp_path / "x").exists() and not (tmp_path / "b").exists()


def test_publish_variants(spark, tmp_path, stage):
    store = SnapshotStore(spark, str(tmp_path / "repo"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "native_id string")
    expect = lambda *x: spark.createDataFrame(list(x), "name string, native_id string")
    # records without a name need not be whole yet
    publish_unrooted(store, *stage([("a", "1")], [("a", "b")])[:2])
    with pytest.raises(Rejected, match="MissingObject: b"):
        publish_closures(store, *stage([("x", "0")])[:2], ids("a"))
    publish_closures(store, *stage([("b", "2")])[:2], ids("a"))
    assert {r.native_id for r in store.read("witnesses").collect()} == {"a"}
    publish_rooted(store, *stage([("c", "3")], [("c", "a")])[:2], "top", "c")
    head = store.head()["revision"]
    with pytest.raises(Rejected, match="RootMismatch: gone"):
        publish_if_roots_match(store, *stage([("d", "4")], [], [("top", "d")]), expect(("top", "a"), ("gone", "c"), ("none", None)))
    assert store.head()["revision"] == head
    after = publish_if_roots_match(store, *stage([("d", "4")], [], [("top", "d")]), expect(("top", "c"), ("none", None)))
    with pytest.raises(StaleRevision):
        publish_at_revision(store, *stage([("e", "5")]), revision=head)
    publish_at_revision(store, *stage([("e", "5")]), revision=after["revision"])
    assert {tuple(r) for r in store.read("roots").collect()} == {("top", "d")}
    assert {r.native_id for r in store.read("objects").collect()} == set("abcde")


def digest_of(top):
    """(digest, size) of a folder by recursion, as rolled_up has it."""
    lines, total = [], 0
    for p in sorted(top.iterdir(), key=lambda p: p.name):
        kind = "d" if p.is_dir() else "f"
        digest, size = digest_of(p) if p.is_dir() else (hashlib.sha256(p.read_bytes()).hexdigest(), p.stat().st_size)
        lines.append(f"{kind} {digest} {size} {p.name}")
        total += size + 1 if kind == "d" else 1
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), total


def test_import_forest(spark, tmp_path):
    tops = {"one": str(tmp_path / "t.1+"), "two": str(tmp_path / "two")}
    for path, text in (("t.1+/a", "1"), ("t.1+/d/e/f", "2"), ("t.1+/d/g", "2"), ("two/d/e/f", "2"), ("two/h i", "")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    store = SnapshotStore(spark, str(tmp_path / "repo"))
    _, cache = import_forest(store, tops)
    want = {(n, digest_of(tmp_path / t.rsplit("/", 1)[1])[0]) for n, t in tops.items()}
    assert {tuple(r) for r in store.read("roots").collect()} == want
    # files 1, 2 and the empty one; d/e is the same in both trees
    assert store.read("objects").count() == 3 + 5 and cache.count() == 5
    sizes = {r.native_id: r.size for r in rolled_up(cache)[0].collect()}
    assert all(sizes[digest] == digest_of(tmp_path / tops[n].rsplit("/", 1)[1])[1] for n, digest in want)
    # what the cache knows is not hashed again
    marked = cache.selectExpr("root", "path", "size", "modified", "concat('known-', path) AS digest")
    assert all(r.digest.startswith("known-") for r in hashed(spark, tops, marked).collect())
    (tmp_path / "two/d/new").write_text("9")
    _, again = import_forest(store, tops, cache)
    assert again.count() == 6 and {tuple(r) for r in store.read("roots").collect()} == {(n, digest_of(tmp_path / t.rsplit("/", 1)[1])[0]) for n, t in tops.items()}
    with pytest.raises(ValueError, match="one name"):
        rolled_up(spark.createDataFrame([("r", "a", 1, "x"), ("r", "a/b", 1, "y")], "root string, path string, size long, digest string"))
    with pytest.raises(ValueError, match="no files"):
        rolled_up(cache.where("false"))
