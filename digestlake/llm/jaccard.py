"""Near copies by true Jaccard similarity of word shingles, with SimHash fingerprints for candidates.

Each text's set of shingles becomes a fingerprint of 256 bits. At similarity 0.8 a bit differs with probability 0.15 at
most, so RADIUS keeps such pairs (0.999 and more of them, 0.995 for texts of eight or nine words). Comparing every pair
of a corpus is quadratic, so fingerprints are dealt to tasks by bands of MinHash minima: two texts at similarity s share
one of BANDS bands of ROWS minima with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.9993 at 0.8. Inside a band
value tiles are compared as in simhash. Fingerprints only estimate, so links are then verified by shingles: inside a
component of candidates each pair is compared, unless verified links connect it already.

A component of more than a tile is cut into tiles. In a first round each is compared in itself and with the
component's first text, which connects most of a large group of near copies; in a second round only pairs of tiles that
hold texts not yet connected are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.llm.common import SMALL_ROWS, partitions, prepared, quoted, released, slices, with_row_keys, written
from digestlake.llm.components import components
from digestlake.llm.simhash import link_edges, set_fingerprint

BANDS, ROWS = 24, 6
#: 64-bit words of a fingerprint, and the bits in which candidates may differ.
WORDS, RADIUS = 4, 64
#: Texts, and shingles of them, of one component that one task compares as a whole; pairs of tiles hold twice that.
TILE = 256
TILE_SHINGLES = 400_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(42)
_TIMES = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
_MIX = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending. A text of fewer words is one shingle."""
    from xxhash import xxh64_digest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(parts) < shingle:
        found = [b" ".join(parts)]
    else:
        found = map(b" ".join, zip(*(parts[i:] for i in range(shingle))))
    return np.unique(np.frombuffer(b"".join([xxh64_digest(s, 42) for s in found]), dtype=">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed 64-bit integers, one per band of minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024] * _TIMES + _PLUS).min(axis=1), out=least)
    return ((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def true_links(sets: list[np.ndarray], least: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that connect the sets just as all pairs of similarity least or more do.

    known: a number per set; sets with the same one are connected already.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    start = np.concatenate([[0], np.cumsum(size)])
    vocabulary, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark = np.zeros(len(vocabulary), dtype=np.int32)
    label = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1][order]
    got_a, got_b = [], []
    # a set more than 1 / least times as large cannot be so similar
    ends = np.searchsorted(size, np.floor(size / least) + 1, side="right")
    for i, end in enumerate(ends):
        others = np.arange(i + 1, end)
        others = others[label[others] != label[i]]
        own = ids[start[i] : start[i + 1]]
        mark[own] = 1
        for k in range(0, len(others), 256):
            some = others[k : k + 256]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            n = size[some]
            first = np.cumsum(n) - n
            shared = np.add.reduceat(mark[ids[np.repeat(start[some] - first, n) + np.arange(n.sum())]], first)
            linked = some[shared / (size[i] + n - shared) >= least]
            if not len(linked):
                continue
            for of in np.unique(label[linked], return_index=True)[1]:
                got_a.append(order[i])
                got_b.append(order[linked[of]])
            label[np.isin(label, label[linked])] = label[i]
        mark[own] = 0
    return np.array(got_a, dtype=np.int64), np.array(got_b, dtype=np.int64)


def _verify(shingle: int, least: float):
    """For mapInArrow over (task, node, known, text) sorted by task: verified links (u, v)."""

    def links(nodes: list[int], known: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        a, b = true_links(sets, least, np.array(known))
        node = np.array(nodes, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, known, sets = None, [], [], []
        for b in batches:
            for task, node, of, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if task != now:
                    if len(nodes) > 1:
                        yield links(nodes, known, sets)
                    now, nodes, known, sets = task, [], [], []
                nodes.append(node)
                known.append(of)
                sets.append(shingles(text.as_py(), shingle))
        if len(nodes) > 1:
            yield links(nodes, known, sets)
        del nodes, known, sets
        released()

    return scan


def _linked(tasks: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Verified links of tasks (task, node, known, f, p), whose texts are those of rows (f, p)."""
    tasks = written(tasks, "near-tasks")
    side = F.broadcast(tasks) if tasks.count() <= SMALL_ROWS else tasks
    rows = texts.join(side, ["f", "p"]).select("task", "node", "known", "text")
    dealt = rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task")
    return written(dealt.mapInArrow(_verify(shingle, least), "u long, v long").distinct(), "near-links")


def _grouped(rows: DataFrame, shingle: int, least: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(prints, labels): a row per row (f, p, doc_id, text) of rows with a doc_id, with its digest (d0, d1); and per
    digest the first of its rows by (doc_id, f, p), that of its group, and whether it is alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names = ["f", "p", "doc_id", "d0", "d1", "n", *(f"w{k}" for k in range(WORDS)), "keys"]
        for b in batches:
            for at, many in slices(b.column(3)):
                sets = [shingles(t.as_py(), shingle) for t in b.column(3).slice(at, many)]
                same = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
                prints = np.stack([set_fingerprint(s, WORDS) for s in sets])
                keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                own = [b.column(k).slice(at, many) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(prints[:, k]) for k in range(WORDS)), keys], names)
        released()

    words = [f"w{k}" for k in range(WORDS)]
    rows = rows.where("doc_id is not null")
    schema = "f long, p long, doc_id long, d0 long, d1 long, n long, " + ", ".join(f"{w} long" for w in words) + ", keys array<long>"
    prints = written(rows.select("f", "p", "doc_id", "text").mapInArrow(scan, schema), "prints")
    # texts with equal shingles are one node; the first of them stands for it
    first = F.min(F.struct("doc_id", "f", "p", "n", *words, "keys")).alias("first")
    nodes = prints.groupBy("d0", "d1").agg(first).select("d0", "d1", "first.*").withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    found = written(components(link_edges(nodes, WORDS, RADIUS)), "near-candidates")
    members = found.join(nodes.select("node", "doc_id", "f", "p", "n"), "node")
    size = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    sizes = members.groupBy("component").agg(size.alias("tiles"), F.min("node").alias("head"))
    placed = members.join(sizes, "component")
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    # the head of a component is in all its tiles
    tile_of = F.explode(F.when((F.col("tiles") > 1) & (F.col("node") == F.col("head")), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(own)))
    tasks = placed.select("component", "node", "f", "p", tile_of.alias("tile"))
    texts = rows.select("f", "p", "text")
    links = _linked(tasks.select(F.xxhash64("component", "tile").alias("task"), "node", F.col("node").alias("known"), "f", "p"), texts, shingle, least)
    cut = written(placed.where("tiles > 1"), "near-large")
    if not cut.isEmpty():
        links = links.unionByName(_across(cut, components(links), texts, shingle, least, tile))
    linked = components(links)
    labels = nodes.select("d0", "d1", "node", "doc_id", "f", "p").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = labels.groupBy("component").agg(F.min(F.struct("doc_id", "f", "p")).alias("head"))
    return prints.select("f", "p", "doc_id", "d0", "d1"), labels.select("d0", "d1", "component").join(heads, "component").select("d0", "d1", "head")


def _across(cut: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, least: float, tile: int) -> DataFrame:
    """Links between the tiles of large components cut (component, node, f, p, n), as far as classes do not connect them.

    A large class has tiles of its own, of which no two are compared; small classes share tiles.
    """
    members = cut.join(classes.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    size = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    per = members.groupBy("component", "class").agg(F.count("*").alias("many"), F.sum("n").alias("held"), size.alias("own_tiles"))
    per = per.withColumn("large", F.col("many") * 4 >= tile)
    small = F.when(~F.col("large"), F.col("many")), F.when(~F.col("large"), F.col("held"))
    shared = F.greatest(F.lit(1), F.ceil(F.sum(small[0]) / tile), F.ceil(F.sum(small[1]) / TILE_SHINGLES)).cast("int")
    whole = per.groupBy("component").agg(F.count("*").alias("classes"), shared.alias("shared_tiles")).where("classes > 1")
    dealt = members.join(per.select("component", "class", "large", "own_tiles"), ["component", "class"]).join(whole, "component")
    number = F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("own_tiles")).otherwise(F.col("shared_tiles")))
    dealt = written(dealt.select("component", "node", "f", "p", "class", F.when(F.col("large"), F.col("class")).alias("pure"), F.xxhash64(F.when(F.col("large"), F.col("class")), number).alias("tile")), "near-dealt")
    tiles = dealt.select("component", "tile", "pure").distinct()
    left, right = tiles.alias("l"), tiles.alias("r")
    pairs = left.join(right, F.expr("l.component = r.component AND l.tile <= r.tile AND (l.pure IS NULL OR r.pure IS NULL OR l.pure <> r.pure)"))
    task = F.xxhash64("l.component", "l.tile", "r.tile").alias("task")
    ends = pairs.select(F.col("l.component").alias("component"), task, F.explode(F.array_distinct(F.array("l.tile", "r.tile"))).alias("tile"))
    return _linked(dealt.join(ends, ["component", "tile"]).select("task", "node", F.col("class").alias("known"), "f", "p"), texts, shingle, least)


def near_rows(rows: DataFrame, shingle: int = 5, least: float = 0.8, tile: int = TILE) -> DataFrame:
    """(f, p, doc_id, head_id, kept) of each row (f, p, doc_id, text) of rows with a doc_id.

    kept: the row is the first of its group by (doc_id, f, p); head_id is the doc_id of that first one.
    """
    prepared(rows)
    prints, labels = _grouped(rows, shingle, least, tile)
    out = prints.join(labels, ["d0", "d1"])
    kept = (F.col("f") == F.col("head.f")) & (F.col("p") == F.col("head.p"))
    return out.select("f", "p", "doc_id", F.col("head.doc_id").alias("head_id"), kept.alias("kept"))


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row per row of docs with a doc_id: doc_id, component_id.

    Rows are linked when the Jaccard similarity of their shingles is least or more; component_id is the smallest doc_id
    that links reach. Texts without words are linked to each other. Each row is linked by its own text, also where
    others have its doc_id. An empty table gives an empty result.
    """
    keyed, file, place = with_row_keys(docs)
    rows = keyed.select(F.col(file).alias("f"), F.col(place).alias("p"), F.col("doc_id").cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return near_rows(rows, shingle, least, tile).select("doc_id", F.col("head_id").alias("component_id"))
