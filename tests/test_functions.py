"""Vectors, round trips and hostile inputs of the functions and sources."""

import hashlib
import io
import tarfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from digestlake.functions import codecs, hashing, text
from digestlake.operators import collect, folds, graph, scans, sync
from digestlake.plans import workspace
from digestlake.sources import archives, git
from digestlake.streaming.ingest import SnapshotStore, StaleRevision, keep_latest


def test_blake3_vectors():
    # published test vectors: bytes 0..250 repeated
    data = bytes(i % 251 for i in range(5000))
    want = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"}
    for n, digest in want.items():
        assert hashing.blake3(data[:n]).hex() == digest


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=20000))
def test_chunks_cover_the_data(data):
    ends = hashing.cut_points(data, 1024)
    assert (ends[-1] if ends else 0) == len(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(n <= 2048 for n in sizes) and all(n >= 512 for n in sizes[:-1])


def test_chunks_follow_content():
    body = hashlib.shake_256(b"x").digest(200_000)
    cut = lambda d: {d[a:b] for a, b in zip([0, *hashing.cut_points(d, 4096)], hashing.cut_points(d, 4096))}
    a, b = cut(body), cut(b"inserted" + body)
    assert len(a & b) > 0.8 * len(a)


entry = st.builds(
    codecs.Entry, name=st.binary(min_size=1, max_size=12).filter(lambda n: b"/" not in n and b"\0" not in n and n not in (b".", b"..")),
    kind=st.sampled_from([codecs.DIRECTORY, codecs.FILE]), digest=st.binary(min_size=32, max_size=32), size=st.integers(0, 10**6),
)


@settings(max_examples=50, deadline=None)
@given(st.lists(entry, max_size=8, unique_by=lambda e: e.name))
def test_directory_round_trip_and_truncation(entries):
    raw = codecs.encode_directory(entries)
    assert codecs.decode_directory(raw) == sorted(entries, key=lambda e: e.name)
    for n in range(len(raw)):
        with pytest.raises(codecs.Malformed):
            codecs.decode_directory(raw[:n])


def test_small_codecs():
    assert codecs.encode_directory([]) == bytes(8)
    keys = [("b.v1", b"2"), ("a.v1", b"1"), ("b.v1", b"2")]
    assert codecs.decode_linked(codecs.encode_linked(keys, b"body")) == ([("a.v1", b"1"), ("b.v1", b"2")], b"body")
    cid = codecs.encode_cid(codecs.LINKED_CODEC, bytes(32))
    assert codecs.decode_cid(cid) == (codecs.LINKED_CODEC, bytes(32))
    with pytest.raises(codecs.Malformed):
        codecs.decode_cid(cid[:-1])
    raw = b"abc" * 1000
    assert codecs.decompress(codecs.compress(raw), 3000) == raw
    with pytest.raises(codecs.Malformed):
        codecs.decompress(codecs.compress(raw), 2999)


def test_prefix_end():
    assert scans.prefix_end(b"ab") == b"ac"
    assert scans.prefix_end(b"a\xff") == b"b"
    assert scans.prefix_end(b"\xff\xff") is None


def test_text_functions(spark):
    rows = spark.createDataFrame([("/a/b",), ("team:x/y",), ("bare",), ("a/b",)], "n string")
    got = [r[0] for r in rows.select(text.resolve_shortcut(F.col("n"), "home")).collect()]
    assert got == ["a/b", "team/x/y", "home/bare", "a/b"]
    links = spark.createDataFrame([("a/b", "../c"), ("a", "../c"), ("a/b/c", "x/../../../.."), ("a", "/etc")], "p string, t string")
    assert [r[0] for r in links.select(text.link_stays_inside(F.col("p"), F.col("t"))).collect()] == [True, False, False, False]
    assert spark.range(1).select(folds.compaction_level(F.lit(11))).first()[0] == 2


def tar_of(*members) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, kind, body in members:
            info = tarfile.TarInfo(name)
            info.type = kind
            if kind == tarfile.REGTYPE:
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
            else:
                info.linkname = body
                tar.addfile(info)
    return out.getvalue()


def test_tar(spark, tmp_path):
    raw = tar_of(("d", tarfile.DIRTYPE, ""), ("d/f", tarfile.REGTYPE, b"hi"), ("h2", tarfile.LNKTYPE, "h1"), ("h1", tarfile.LNKTYPE, "d/f"), ("d/l", tarfile.SYMTYPE, "../h1"))
    (tmp_path / "a.tar").write_bytes(raw)
    assert archives.detect(raw[:512]) == "tar" and archives.detect(b"x" * 512) == "blob"
    got = {r.path: r.digest for r in archives.importer("tar")(spark, str(tmp_path)).collect()}
    assert got["h1"] == got["h2"] == hashlib.sha256(b"hi").hexdigest()
    for bad in (("/x", tarfile.REGTYPE, b""), ("a/../x", tarfile.REGTYPE, b""), ("l", tarfile.SYMTYPE, "../x"), ("c", tarfile.CHRTYPE, "")):
        with pytest.raises(ValueError):
            archives.tar_rows(tar_of(bad))
    with pytest.raises(ValueError):
        archives.tar_rows(tar_of(("a", tarfile.REGTYPE, b""), ("a", tarfile.REGTYPE, b"")))
    cycle = spark.createDataFrame([("a", "h", "b", 0, None), ("b", "h", "a", 0, None)], archives.FILES)
    with pytest.raises(ValueError):
        archives.resolve_hardlinks(cycle, 6)


def test_image_layers():
    raw = tar_of(("a/.wh.gone", tarfile.REGTYPE, b""), ("a/new", tarfile.REGTYPE, b"1"))
    want = "sha256:" + hashlib.sha256(raw).hexdigest()
    assert [(r[1], r[2]) for r in archives.layer_rows([raw], [want])] == [("a/gone", True), ("a/new", False)]
    with pytest.raises(ValueError):
        archives.layer_rows([raw], ["sha256:0"])
    index = [{"platform": {"os": "linux", "architecture": "arm64"}}, {"platform": {"os": "linux", "architecture": "amd64"}, "n": 1}, {"platform": {"os": "linux", "architecture": "amd64"}}]
    assert archives.select_platform(index, "linux/amd64")["n"] == 1


def test_archive_round_trip():
    body = b"payload"
    p = hashlib.sha256(body).hexdigest()
    raw = archives.write_archive([("r", "a")], [(p, body)], [("a", p, ["b"]), ("b", p, [])])
    roots, payloads, records = archives.read_archive(raw)
    assert (roots, payloads, len(records)) == ([("r", "a")], {p: body}, 2)
    for n in range(0, len(raw), 7):
        with pytest.raises(ValueError):
            archives.read_archive(raw[:n])
    with pytest.raises(ValueError):
        archives.read_archive(archives.write_archive([("r", "a")], [(p, body)], [("a", p, []), ("b", p, [])]))


def test_git_tree(spark):
    raw = b"100644 a\0" + bytes(20) + b"160000 m\0" + bytes(20) + b"40000 z\0" + bytes([1] * 20)
    rows = spark.createDataFrame([("t", bytearray(raw))], "oid string, body binary")
    assert [(r.name, r.mode) for r in git.tree_links(rows).orderBy("name").collect()] == [("a", "100644"), ("z", "40000")]
    with pytest.raises(ValueError):
        git.parse_tree(b"40000 z\0" + bytes(20) + b"100644 a\0" + bytes(20))


GRAPHS = st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25)


@settings(max_examples=6, deadline=None)
@given(GRAPHS, st.sets(st.integers(0, 9), max_size=3))
def test_closure_against_a_model(spark, edges, seeds):
    want, todo = set(), list(seeds)
    while todo:
        if (x := todo.pop()) not in want:
            want.add(x)
            todo += [b for a, b in edges if a == x]
    links = spark.createDataFrame(edges, "src int, dst int")
    start = spark.createDataFrame([(s,) for s in seeds], "native_id int")
    assert {r[0] for r in graph.closure(links, start).select("native_id").collect()} == want


def test_deep_closure_keeps_few_tables(spark, monkeypatch):
    monkeypatch.setattr(graph, "FAN", 2)
    seen = graph.Seen(spark.range(1))
    for i in range(1, 8):
        seen.add(spark.range(i, i + 1))
    assert sum(map(len, seen.classes)) <= 3 and sorted(r.id for r in seen.rows().collect()) == list(range(8))
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 4)], "src int, dst int")
    got = graph.closure(links, spark.createDataFrame([(0,)], "native_id int"))
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(10)]


def test_compaction(spark):
    from digestlake.operators import packs

    rows = [("a", "1", 10, True), ("a", "2", 4, False), ("a", "3", 5, False), ("b", "4", 9, False), ("b", "5", 1, True), ("c", "6", 3, True)]
    entries = spark.createDataFrame(rows, "pack string, chunk string, framed_len long, dead boolean")
    got = sorted(tuple(r) for r in packs.compacted(entries).collect())
    assert [g[:4] for g in got] == [("a+", "2", 4, "a"), ("a+", "3", 5, "a"), ("b", "4", 9, "b"), ("b", "5", 1, "b")]
    assert [g[4] for g in got] == [0, 4, None, None]
    assert packs.compacted(entries.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 5, 6, 8])
def test_carried_runs_against_a_counter(spark, n):
    from digestlake.operators import packs

    levels = {}
    for run in range(n):
        merged, level = [run], 0
        while level in levels:
            merged, level = levels.pop(level) + merged, level + 1
        levels[level] = merged
    runs = spark.createDataFrame([(i, 0) for i in range(n)], "run long, k int")
    assert {r.level: r.run for r in packs.carried_runs(runs, ["k"], ["run"]).collect()} == {k: max(v) for k, v in levels.items()}


def test_closure_limit(spark):
    links = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    with pytest.raises(graph.TraversalLimit):
        graph.closure(links, spark.createDataFrame([(1,)], "native_id int"), limit=2)


def test_batches_and_greedy_order(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 5, 20, 1, 1])], "k string, o int, n int")
    got = [r.batch for r in sync.batches(rows, "k", "o", "n", 10, 2).orderBy("o").collect()]
    assert got == [0, 0, 1, 2, 3, 3]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 12))), max_size=40), st.integers(1, 4))
def test_batches_against_a_loop(spark, items, count):
    want, state = [], {}
    for i, (k, n) in enumerate(items):
        batch, held, many = state.get(k, (0, 0, 0))
        if many and (held + (n or 0) > 10 or many >= count):
            batch, held, many = batch + 1, 0, 0
        state[k] = batch, held + (n or 0), many + 1
        want.append((k, i, n, batch))
    rows = spark.createDataFrame([(k, i, n) for i, (k, n) in enumerate(items)], "k string, o int, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, sync.batches(rows, "k", "o", "n", 10, count).collect()), key=lambda r: r[1]) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_eviction_stops_when_pressure_ends(spark):
    roots = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, native_id int")
    policy = spark.createDataFrame([("a", "evictable", 2), ("b", "evictable", 1), ("c", "permanent", 0)], "name string, retention string, last_use int")
    sizes = spark.createDataFrame([(1, 10), (2, 10), (3, 90)], "native_id int, size int")
    assert [r.name for r in collect.eviction(roots, policy, sizes, 80, 100).collect()] == ["b"]


def test_running_sums_over_ranges(spark):
    rows = [(i // 3, f"n{i}", None if i % 7 == 0 else i) for i in range(100)]
    got = folds.running(spark.createDataFrame(rows, "a long, b string, v long"), ["a", "b"], F.col("v"), "before")
    at, want = 0, {}
    for a, b, v in sorted(rows, key=lambda r: r[:2]):
        want[b], at = at, at + (v or 0)
    assert got.columns == ["a", "b", "v", "before"] and {r.b: r.before for r in got.collect()} == want
    assert folds.running(got.limit(0), ["a", "b"], F.col("v"), "before").count() == 0


def test_no_local_folder_on_a_cluster():
    class Frame:
        class sparkSession:
            class sparkContext:
                master = "local-cluster[2,1,1024]"

            class conf:
                get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.checkpointed(Frame)


def test_store_and_stream(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "repo"))
    first = store.commit(None, objects=spark.range(3))
    with pytest.raises(StaleRevision):
        store.commit(None, objects=spark.range(4))
    second = store.commit(first["revision"], objects=spark.range(5))
    assert second["generation"] == 2 and store.read("objects", 1).count() == 3 and store.read("objects").count() == 5
    assert store.unreferenced() == []
    spark.range(1).write.parquet(str(tmp_path / "repo" / "data" / "under-way"))
    dropped = store.vacuum()
    assert dropped == [first["tables"]["objects"]] and store.read("objects").count() == 5
    assert store.unreferenced() == ["data/under-way"] and store.vacuum() == []
    with pytest.raises(KeyError):
        store.read("objects", 1)
    with pytest.raises(StaleRevision):
        store.commit(first["revision"], objects=spark.range(1))
    source = str(tmp_path / "in")
    schema = "key int, ts int, value string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(source)
        keep_latest(stream, store, "latest", ["key"], ["ts"], str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(1, 2, "c"), (2, 0, "old")], schema).write.mode("append").parquet(source)
    assert {(r.key, r.value) for r in store.read("latest").collect()} == {(1, "c"), (2, "b")}


def test_checkout(spark, tmp_path):
    from digestlake.sources.checkout import checkout

    files = spark.createDataFrame([("a/b.txt", "hi"), ("c.gz", "raw")], "path string, bytes string")
    assert {tuple(r) for r in checkout(files, str(tmp_path / "out")).collect()} == {("a/b.txt", 2), ("c.gz", 3)}
    assert (tmp_path / "out/a/b.txt").read_text() == "hi" and (tmp_path / "out/c.gz").read_bytes() == b"raw"
    with pytest.raises(FileExistsError):
        checkout(files, str(tmp_path / "out"))
    listed = archives.importer("files")(spark, str(tmp_path / "out"))
    assert {r.path: r.size for r in listed.collect()} == {"a/b.txt": 2, "c.gz": 3}


def test_requested_status(spark):
    objects = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "p"), ("e", "p")], "native_id string, payload string")
    links = spark.createDataFrame([("a", "b"), ("d", "c"), ("e", "gone"), ("e", "c"), ("gone", "c")], "src string, dst string")
    asked = spark.createDataFrame([(x, x) for x in ("a", "b", "c", "d", "e", "gone")], "name string, native_id string")
    got = sync.requested_status(objects, links, asked, spark.createDataFrame([("p",)], "payload string"))
    assert dict(map(tuple, got.collect())) == {"a": "Complete", "b": "Complete", "c": "Invalid", "d": "Invalid", "e": "Incomplete", "gone": "Missing"}
    assert sync.requested_status(objects, links, asked.where("false"), objects).count() == 0
