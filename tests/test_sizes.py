"""Plans and steps that must hold on tables larger than the fixtures."""

import shutil
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from digestlake.functions import proofs
from digestlake.llm import suffix_dedup
from digestlake.operators import graph, sync
from digestlake.operators.keys import packed, unpacked
from digestlake.plans.derive import Repo


@pytest.mark.parametrize("odd", ["none", "lines without orders", "an order without a number", "no orders"])
def test_entries_deal_out_orders(spark, sf_dir, tmp_path, odd):
    for path in Path(sf_dir).iterdir():
        if path.suffix == ".parquet":
            shutil.copy(path, tmp_path)
    con = duckdb.connect()
    if odd != "none":
        lines = f"SELECT CASE WHEN l_orderkey % 9 = 4 THEN NULL WHEN l_orderkey % 9 = 5 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, * EXCLUDE (l_orderkey) FROM '{sf_dir}/lineitem.parquet'"
        con.execute(f"COPY ({lines}) TO '{tmp_path}/lineitem.parquet'")
    if odd == "an order without a number":
        con.execute(f"COPY (SELECT nullif(o_orderkey, 7) AS o_orderkey, * EXCLUDE (o_orderkey) FROM '{sf_dir}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    if odd == "no orders":
        con.execute(f"COPY (SELECT * FROM '{sf_dir}/orders.parquet' LIMIT 0) TO '{tmp_path}/orders.parquet'")
    repo = Repo(spark, str(tmp_path))
    assert "LeftAnti, BuildRight, true" not in repo.entries._jdf.queryExecution().executedPlan().toString()  # NOT IN by broadcast
    got, want = ([tuple(r) for r in rows.select("dir", "name", "kind", "digest", "size").collect()] for rows in (repo.entries, repo._derived("entries")))
    assert sorted(got, key=str) == sorted(want, key=str) and (bool(got) or odd == "an order without a number")


def test_a_level_moves_no_links(spark):
    links = spark.createDataFrame([(f"{a:064x}", f"{b:064x}") for a in range(40) for b in (2 * a + 1, 2 * a + 2)], "src string, dst string")
    walk = graph.Walk(links, spark.createDataFrame([("0" * 64,)], "native_id string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = walk.unmet(walk.seen.tables()[0].join(walk.edges, "__key"))
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert walk.met().count() == 81


@pytest.mark.parametrize("good", [1, 9])
def test_walk_with_equal_hashes(spark, monkeypatch, good):
    """Ids that share a hash are told by the next salt, or by themselves where no salt helps."""
    monkeypatch.setattr(graph, "SALTS", 2)
    own = graph._key
    monkeypatch.setattr(graph, "_key", lambda salt: own(salt) if salt >= min(good, 2) else (lambda c: F.lit(7).cast("long") + F.octet_length(c) * 0))
    links = spark.createDataFrame([("a", "b"), ("b", None), ("b", "c"), ("x", "y"), (None, "z"), ("c", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "x")], "name string, native_id string")
    got = graph.closure(links, seeds, by=["name"], via=True, facts=seeds.select("native_id", F.lit(1).alias("told")))
    want = {("r", "a", 0, None, 1), ("r", "b", 0, None, 1), ("r", None, 1, "b", None), ("r", "c", 1, "b", None), ("s", "x", 0, None, 1), ("s", "y", 1, "x", None)}
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    kept = graph.closure(links, seeds.where("name = 'r'"), within=spark.createDataFrame([("a",)], "native_id string"))
    assert {tuple(r) for r in kept.collect()} == {("a", 0), ("b", 0)}


@pytest.mark.parametrize("kind, values", [("string", ["", "a", "ab" * 32, "AB" * 32, "x" * 31, "x" * 32, "x" * 33, None, "\x01" * 33]), ("long", [0, -5, None]), ("binary", [b"", bytes(32), b"\xff", None])])
def test_packed_ids(spark, kind, values):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}").withColumn("p", packed("v", spark.createDataFrame([], f"v {kind}").schema["v"].dataType))
    assert rows.select("p").distinct().count() == len(values)
    back = [r[0] for r in rows.select(unpacked("p", rows.schema["v"].dataType)).collect()]
    assert back == [bytearray(v) if isinstance(v, bytes) else v for v in values]


def test_op9_sorts_bounded_parts(monkeypatch):
    """A hash that very many segments share is sorted in parts, with the answers of one sort."""
    rng = np.random.default_rng(5)
    data = rng.choice(list(b"ab"), 400).tobytes() * 4 + b"x" * 300 + rng.integers(0, 256, 900, dtype="uint8").tobytes()
    at = rng.permutation(len(data) - 50)[:2000]
    low = rng.integers(0, 99, len(at))
    want = {}
    for p, v in zip(at.tolist(), low.tolist()):
        want[data[p : p + 50]] = min(v, want.get(data[p : p + 50], 99))
    most, whole = [], suffix_dedup.suffix_classes
    monkeypatch.setattr(suffix_dedup, "SORTED", 64)
    monkeypatch.setattr(suffix_dedup, "suffix_classes", lambda d, a, n: most.append(len(a)) or whole(d, a, n))
    assert suffix_dedup.window_lows(data, at, low, 50).tolist() == [want[data[p : p + 50]] for p in at.tolist()]
    assert max(most) <= 4 * 64 and sum(most) >= len(at)
    group = rng.integers(0, 40, 500)
    parts = list(suffix_dedup.grouped(np.ones(500, dtype=np.int64), np.unique(group, return_inverse=True)[1]))
    assert sorted(np.concatenate(parts).tolist()) == list(range(500)) and len(parts) > 5
    assert all(len(x) <= 64 for x in parts) and sum(len(set(group[x])) for x in parts) == len(set(group))


def test_op9_whole_with_small_parts(monkeypatch):
    docs = [(i, f"{i} " * 9 + "the very same sentence, which is long enough to be found again " * (1 + i % 3) + f" {i * i}" * 30) for i in range(40)]
    held = {}
    for k in (1 << 19, 30):
        monkeypatch.setattr(suffix_dedup, "SORTED", k)
        monkeypatch.setattr(suffix_dedup, "_read", lambda where, block: ([i for i, _ in docs], [t.encode() for _, t in docs]))
        told = suffix_dedup._shared(suffix_dedup._hashes("", 50, 1)((7,), None))
        found = suffix_dedup._segments("", 50, 1)((7,), told)
        found = found[found["kind"] == "segments"].assign(data=found["data"].dropna().map(suffix_dedup.squeezed))
        held[k] = suffix_dedup._sorted(50)(found)
    assert held[30].equals(held[1 << 19])


def test_proofs_hash_bounded_parts(monkeypatch):
    monkeypatch.setattr(proofs, "PART", 100)
    rows = pd.DataFrame({"k": range(9), "bytes": [bytes(n) for n in (0, 0, 40, 60, 1, 500, 99, 2, 3)]})
    parts = list(proofs._parts(rows, "bytes"))
    assert pd.concat(parts).equals(rows)
    assert len(parts) > 3 and all(len(p) == 1 or p["bytes"].map(len).sum() <= 100 for p in parts)


@pytest.mark.parametrize("count, budget", [(5, 12), (1, 100), (300, 40), (4, 0)])
def test_batches_over_ranges(spark, count, budget):
    rng = np.random.default_rng(3)
    items = [(k, i, None if n == 13 else int(n)) for k, many in (("a", 700), ("b", 3), ("c", 300), (None, 40)) for i, n in enumerate(rng.integers(0, 14, many))]
    want, state = [], {}
    for k, i, n in items:
        batch, held, many = state.get(k, (0, 0, 0))
        if many and (held + (n or 0) > budget or many >= count):
            batch, held, many = batch + 1, 0, 0
        state[k] = batch, held + (n or 0), many + 1
        want.append((k, i, n, batch))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = sync.batches(spark.createDataFrame(items, "k string, o int, n long"), "k", "o", "n", budget, count)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert got.where("k = 'a'").select(F.spark_partition_id()).distinct().count() > 2  # before, a key was cut in one task
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
