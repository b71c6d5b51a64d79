"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Documents become fingerprints of 64-bit words in the scan; only fingerprints move. Distinct fingerprints are dealt to
tiles by bit bands: with radius r and r + 1 bands that cover all bits, two fingerprints within r bits agree in one
band at least, so no link is lost. Inside a band's value a task compares tile against tile with numpy exclusive-or and
bit counts, tiles being runs in order of population count; a pair of tiles whose population counts differ by more
than the radius is skipped. A band value held by many fingerprints is cut into tiles beforehand and its tile pairs
are dealt out as separate tasks. A task returns a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.llm.common import partitions, prepared, quoted, slices, with_row_keys, without_rows, written
from digestlake.llm.components import components

#: Members of one band value that one task compares as a whole; above it the value is cut into tiles.
TILE_ROWS = 16384
#: Rows of a numpy tile.
BLOCK = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.random.default_rng(64).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> list[int]:
    """words signed 64-bit integers. A text without words gives zeros."""
    from xxhash import xxh64_digest

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return [0] * words
    if len(parts) < shingle:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*(parts[i:] for i in range(shingle)))))
    out = []
    for k in range(words):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(shingles), 4096):
            some = shingles[at : at + 4096]
            raw = np.frombuffer(b"".join([xxh64_digest(s, 42 + k) for s in some]), dtype=np.uint8)
            ones += np.unpackbits(raw.reshape(len(some), 8), axis=1).sum(axis=0, dtype=np.int64)
        bits = np.packbits(ones * 2 > len(shingles)).tobytes()
        out.append(int.from_bytes(bits, "big", signed=True))
    return out


def set_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """words signed 64-bit integers for a set of 64-bit hashes: a bit is 1 if set in over half of them, after mixing."""
    out = np.empty(words, dtype=np.int64)
    for k in range(words):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 4096):
            h = hashes[at : at + 4096]
            if k:  # further words come from the same hashes, mixed anew
                h = (h ^ (h >> np.uint64(29))) * _MIX[k]
                h = (h ^ (h >> np.uint64(32))) * _MIX[k + 4]
                h ^= h >> np.uint64(29)
            ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, text_col: str = "text") -> DataFrame:
    """(doc_id, w0, w1, ...), a row per row of docs. Null text has no words."""
    prepared(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fingerprint(t, shingle, words) for at, n in slices(b.column(1)) for t in b.column(1).slice(at, n).to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(words)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *(f"w{k}" for k in range(words))])

    schema = "doc_id long, " + ", ".join(f"w{k} long" for k in range(words))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(scan, schema)


def exact_bands(radius: int) -> list[tuple[int, int, int]]:
    """radius + 1 bands (word, first bit, bits) that cover one 64-bit word: no pair within radius is lost."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(0, a, b - a) for a, b in zip(cuts, cuts[1:])]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between positions a and b."""
    parent: dict[int, int] = {}
    keep_a, keep_b = [], []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            keep_a.append(x)
            keep_b.append(y)
    return np.array(keep_a, dtype=np.int64), np.array(keep_b, dtype=np.int64)


def _dense(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and per column the least row that links reach, or -1 where there is no link."""
    rows = near.shape[0]
    label = np.arange(rows)
    while True:
        col = np.where(near, label[:, None], rows).min(axis=0)
        new = np.minimum(label, np.where(near, col[None, :], rows).min(axis=1))
        if (new == label).all():
            return np.where(near.any(axis=1), label, -1), np.where(near.any(axis=0), col, -1)
        label = new


def near_links(words: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links that connect the fingerprints just as all links within radius do.

    words: one row per fingerprint, one column per 64-bit word. side: 0 and 1 where only pairs between the two sides
    are to be compared, -1 where every pair is.
    """
    pop = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    order = np.argsort(pop, kind="stable")
    if (side >= 0).any():
        left, right = order[side[order] == 0], order[side[order] == 1]
    else:
        left = right = order
    got_a, got_b = [], []
    for i in range(0, len(left), BLOCK):
        x = left[i : i + BLOCK]
        for j in range(i if right is left else 0, len(right), BLOCK):
            y = right[j : j + BLOCK]
            if pop[y[0]] - pop[x[-1]] > radius:
                break
            if pop[x[0]] - pop[y[-1]] > radius:
                continue
            far = np.bitwise_count(words[x, 0][:, None] ^ words[y, 0][None, :]).astype(np.int16)
            for k in range(1, words.shape[1]):
                far += np.bitwise_count(words[x, k][:, None] ^ words[y, k][None, :])
            near = far <= radius
            if right is left and i == j:
                near &= np.tri(len(x), len(y), -1, dtype=bool)
            count = int(near.sum())
            if not count:
                continue
            if count <= 4 * (len(x) + len(y)):
                p, q = np.nonzero(near)
                got_a.append(x[p])
                got_b.append(y[q])
            else:
                for label, own in zip(_dense(near), (x, y)):
                    linked = np.nonzero(label >= 0)[0]
                    got_a.append(x[label[linked]])
                    got_b.append(own[linked])
            if sum(map(len, got_a)) > 200_000:
                f = _forest(np.concatenate(got_a), np.concatenate(got_b))
                got_a, got_b = [f[0]], [f[1]]
    if not got_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(got_a), np.concatenate(got_b))


def _compare(words: int, radius: int):
    """For mapInArrow over rows sorted by task: links (u, v) of the nodes of each task."""

    def links(node: np.ndarray, side: np.ndarray, w: np.ndarray, cuts: np.ndarray):
        size = np.diff(cuts)
        out = []
        small = (size > 1) & (size <= 32)
        of = np.repeat(np.arange(len(size)), size)
        rows = np.repeat(small, size)
        pop = np.bitwise_count(w).sum(axis=1, dtype=np.int64)
        for step in range(1, int(size[small].max()) if small.any() else 0):
            # every pair of small tasks at this distance at once
            left = np.nonzero((of[:-step] == of[step:]) & rows[:-step] & (np.abs(pop[:-step] - pop[step:]) <= radius))[0]
            right = left + step
            total = sum(np.bitwise_count(w[left, k] ^ w[right, k]).astype(np.int64) for k in range(words))
            ok = (total <= radius) & ((side[left] < 0) | (side[left] != side[right]))
            out.append((node[left[ok]], node[right[ok]]))
        for a, b in zip(cuts[:-1][size > 32], cuts[1:][size > 32]):
            p, q = near_links(w[a:b], side[a:b], radius)
            out.append((node[a:b][p], node[a:b][q]))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in (*batches, None):
            if b is not None:
                if not b.num_rows:
                    continue
                held.append(b)
                task = b.column("task")
                if held[0].column("task")[0].as_py() == task[b.num_rows - 1].as_py() or sum(h.num_rows for h in held) < 50_000:
                    continue
            if not held:
                continue
            t = pa.Table.from_batches(held)
            tasks = t.column("task").to_numpy()
            cuts = np.concatenate([[0], np.nonzero(tasks[1:] != tasks[:-1])[0] + 1, [len(tasks)]])
            if b is not None:  # the last task may go on in the next batch
                rest = int(cuts[-2])
                held = t.slice(rest).combine_chunks().to_batches()
                t, cuts = t.slice(0, rest), cuts[:-1]
            w = np.stack([t.column(f"w{k}").to_numpy().view(np.uint64) for k in range(words)], axis=1)
            for u, v in links(t.column("node").to_numpy(), t.column("side").to_numpy(), w, cuts):
                for i in range(0, len(u), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 50_000]), pa.array(v[i : i + 50_000])], ["u", "v"])

    return scan


def link_edges(nodes: DataFrame, words: int, radius: int, bands: list[tuple[int, int, int]] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) that connect nodes (node, w0, ...) with distinct fingerprints within radius bits.

    Nodes are compared if they share a band of bits, or without bands one of the values in their array column keys.
    """
    spark = prepared(nodes)
    cols = [f"w{k}" for k in range(words)]
    if bands is None:
        keys = F.col("keys")
    else:
        keys = F.array(*[F.shiftrightunsigned(f"w{k}", a).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(i << 56) for i, (k, a, n) in enumerate(bands)])
    pop = sum((F.bit_count(c) for c in cols[1:]), F.bit_count(cols[0]))
    if words == 1:
        members = nodes.select("node", *cols, pop.alias("pop"), F.explode(keys).alias("key"))
    else:  # long fingerprints are put to the members of shared values only
        slim = nodes.select("node", F.explode(keys).alias("key"))
        shared = slim.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        slim = written(slim.join(shared, "key", "left_semi"), "members")
        members = slim.join(nodes.select("node", *cols, pop.alias("pop")), "node")
    # a row per band value and population count; only values that two fingerprints share are kept
    classes = members.groupBy("key", "pop").agg(F.count("*").alias("n"))
    sizes = classes.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1")
    sized = members.join(sizes, "key")
    whole = sized.where(F.col("total") <= tile_rows).select(F.xxhash64("key").alias("task"), F.lit(-1).alias("side"), "node", *cols)
    # large values: the members of a population count are cut into tiles, and pairs of tiles become tasks
    big = classes.join(sizes.where(F.col("total") > tile_rows), "key")
    tiles = big.select("key", "pop", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / tile_rows).cast("int") - 1)).alias("tile"), F.ceil(F.col("n") / tile_rows).cast("int").alias("tiles"))
    left, right = tiles.alias("l"), tiles.alias("r")
    pairs = left.join(right, F.expr(f"l.key = r.key AND r.pop - l.pop BETWEEN 0 AND {radius} AND (r.pop > l.pop OR r.tile >= l.tile)"))
    same = F.expr("l.pop = r.pop AND l.tile = r.tile")
    task = F.xxhash64("l.key", "l.pop", "l.tile", "r.pop", "r.tile")
    ends = pairs.select(
        F.col("l.key").alias("key"),
        task.alias("task"),
        F.explode(
            F.when(same, F.array(F.struct(F.col("l.pop").alias("pop"), F.col("l.tile").alias("tile"), F.lit(-1).alias("side")))).otherwise(
                F.array(F.struct(F.col("l.pop").alias("pop"), F.col("l.tile").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("r.pop").alias("pop"), F.col("r.tile").alias("tile"), F.lit(1).alias("side")))
            )
        ).alias("e"),
    ).select("key", "task", "e.*")
    counts = tiles.select("key", "pop", "tiles").distinct()
    cut = sized.where(F.col("total") > tile_rows).join(counts, ["key", "pop"])
    cut = cut.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    split = cut.join(ends, ["key", "pop", "tile"]).select("task", "side", "node", *cols)
    tasks = whole.unionByName(split)
    dealt = tasks.repartition(partitions(spark), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(_compare(words, radius), "u long, v long").distinct()


def near_groups(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 2, bands: list | None = None, text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, w0, w1, ..., component_id.

    Rows are linked when their fingerprints differ in at most radius bits; component_id is the smallest doc_id that
    links reach. Null text and texts without words have a fingerprint of zeros and are linked like any other. Rows
    with a null doc_id link nothing and get a null component_id. Repeated rows share a component. An empty table
    gives an empty result; other columns are not read.
    """
    prepared(docs)
    bands = bands or exact_bands(radius)
    prints = written(fingerprints(docs, shingle, words, text_col), "fingerprints")
    cols = [f"w{k}" for k in range(words)]
    nodes = written(prints.where("doc_id is not null").groupBy(*cols).agg(F.min("doc_id").alias("node")), "nodes")
    found = components(link_edges(nodes, words, radius, bands))
    labels = nodes.join(found, "node", "left").select(*cols, F.coalesce("component", "node").alias("component_id"))
    out = prints.join(labels, cols, "left")
    return out.select("doc_id", *cols, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest doc_id.

    Shingles of five words and a Jaccard similarity of 0.8. Fingerprints within a wide radius, compared in tiles, are
    candidates, and shingles decide; see jaccard. Each row is judged for itself: of rows with the same doc_id in one
    group one stays, and rows with the same doc_id in other groups are not touched. Rows with a null doc_id stay.
    Columns as in docs, whatever their names.
    """
    from digestlake.llm.jaccard import near_rows

    keyed, file, place = with_row_keys(docs)
    rows = keyed.select(F.col(file).alias("f"), F.col(place).alias("p"), F.col("doc_id").cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    dropped = near_rows(rows, shingle, least).where("not kept").select(F.col("f").alias(file), F.col("p").alias(place))
    return without_rows(keyed, file, place, dropped)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")
