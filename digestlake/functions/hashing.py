"""BLAKE3 and content-defined chunks, which Spark lacks, as Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.plans.workspace import checkpointed, shipped

#: Fixed values of the published BLAKE3 specification: initial state and message order.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_MASK = 0xFFFFFFFF


def _turn(x, n: int):
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The compression function over many blocks at once: cv (n, 8), words (n, 16) -> chaining values (n, 8)."""
    n = len(cv)
    v = [cv[:, i].copy() for i in range(8)] + [np.full(n, IV[i], dtype=np.uint32) for i in range(4)]
    v += [(counter & _MASK).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = [words[:, i] for i in range(16)]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_COLUMNS):
            for half, (r, s) in enumerate(((16, 12), (8, 7))):
                v[a] = v[a] + v[b] + m[2 * k + half]
                v[d] = _turn(v[d] ^ v[a], r)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], s)
        m = [m[i] for i in ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def subtrees(parts: list[bytes], first: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The chaining value of each part: a subtree whose first chunk has the number first, a whole tree where root.

    The 1 KiB chunks of all parts advance side by side, then the parents of all parts, level by level.
    """
    if not parts:
        return np.empty((0, 8), dtype=np.uint32)
    length = np.array([len(p) for p in parts], dtype=np.int64)
    count = np.maximum(1, -(-length // 1024))
    words = np.frombuffer(b"".join(p.ljust(c * 1024, b"\0") for p, c in zip(parts, count.tolist())), dtype="<u4").reshape(-1, 16, 16)
    owner = np.repeat(np.arange(len(parts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(1024, length[owner] - 1024 * at)
    blocks = np.maximum(1, -(-size // 64))
    top = np.where((count == 1) & root, ROOT, 0)[owner]
    cv = np.tile(np.array(IV, dtype=np.uint32), (len(owner), 1))
    number = first[owner] + at
    for k in range(int(blocks.max())):
        on = np.nonzero(blocks > k)[0]
        flags = np.where(blocks[on] == k + 1, CHUNK_END | top[on], 0) | (CHUNK_START if k == 0 else 0)
        cv[on] = compress(cv[on], words[on, k], number[on], np.minimum(64, size[on] - 64 * k), flags)
    while len(owner) > len(parts):
        # full left subtrees pair up; an odd node waits for the next level
        left = np.nonzero((at % 2 == 0) & (at + 1 < count[owner]))[0]
        cv[left] = parents(np.concatenate([cv[left], cv[left + 1]], axis=1), ((count == 2) & root)[owner[left]])
        stay = at % 2 == 0
        cv, owner, at, count = cv[stay], owner[stay], at[stay] // 2, (count + 1) // 2
    return cv


def parents(pairs: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The chaining values of parents, from their two children side by side (n, 16)."""
    n = len(pairs)
    start = np.tile(np.array(IV, dtype=np.uint32), (n, 1))
    return compress(start, pairs, np.zeros(n, dtype=np.int64), np.full(n, 64), np.where(root, PARENT | ROOT, PARENT))


#: Bytes that advance side by side at most, unless one payload is longer.
SIDE_BY_SIDE = 16 << 20


def groups(sizes: list[int]) -> Iterator[slice]:
    """Runs of positions whose sizes add up to SIDE_BY_SIDE or are one."""
    low = total = 0
    for i, n in enumerate(sizes):
        if i > low and total + n > SIDE_BY_SIDE:
            yield slice(low, i)
            low, total = i, 0
        total += n
    if sizes:
        yield slice(low, len(sizes))


def blake3_many(payloads: list[bytes]) -> list[bytes]:
    """The 32-byte BLAKE3 digests."""
    out = []
    for some in groups([len(p) for p in payloads]):
        n = len(payloads[some])
        out += [v.tobytes() for v in subtrees(payloads[some], np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)).astype("<u4")]
    return out


def blake3(data: bytes) -> bytes:
    return blake3_many([data])[0]


def blake3_hex(col: Column) -> Column:
    if (spark := SparkSession.getActiveSession()) is not None:
        shipped(spark)

    @F.pandas_udf("string")
    def digest(parts: pd.Series) -> pd.Series:
        found = iter(blake3_many([bytes(x) for x in parts if x is not None]))
        return pd.Series([None if x is None else next(found).hex() for x in parts], dtype=object)

    return digest(col.cast("binary"))


@lru_cache(maxsize=4)
def gear(seed: int = 1) -> np.ndarray:
    """256 random 64-bit numbers, made from a seed."""
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)


def cut_points(data: bytes, average: int = 256 << 10) -> list[int]:
    """Ends of content-defined chunks between average / 2 and 2 * average bytes; less data is one chunk.

    A cut falls where the gear hash of the 64 bytes before it has log2(average) + 1 zero bits below the average size,
    one bit fewer above it, so sizes gather around the average. The hash at a byte depends on 64 bytes alone and is
    computed for all positions at once.
    """
    least, most, n = average // 2, average * 2, len(data)
    if n <= least:
        return [n] if n else []
    g = gear()[np.frombuffer(data, dtype=np.uint8)]
    h = g.copy()
    width = 1
    while width < 64:  # the sum of the last 2 * width shifted values from two sums of width
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] << np.uint64(width)
        h = h + moved
        width *= 2
    bits = average.bit_length() - 1
    top = lambda k: np.uint64(((1 << k) - 1) << (64 - k))
    strict, loose = np.nonzero((h & top(bits + 1)) == 0)[0] + 1, np.nonzero((h & top(bits - 1)) == 0)[0] + 1
    out, at = [], 0
    while n - at > least:
        k = np.searchsorted(strict, at + least)
        if k < len(strict) and strict[k] <= min(n, at + average):
            end = int(strict[k])
        else:
            k = np.searchsorted(loose, at + average)
            end = min(n, at + most, int(loose[k]) if k < len(loose) else n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunk_payloads(payloads: DataFrame, average: int = 256 << 10) -> DataFrame:
    """(payload, seq, offset, chunk, size, bytes) of payloads (payload, bytes); chunk is the SHA-256 of the bytes."""
    import hashlib

    shipped(payloads.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for payload, raw in zip(pdf["payload"], pdf["bytes"]):
                raw, at, rows = bytes(raw or b""), 0, []
                for seq, end in enumerate(cut_points(raw, average)):
                    part = raw[at:end]
                    rows.append((payload, seq, at, hashlib.sha256(part).hexdigest(), len(part), part))
                    at = end
                if rows:
                    yield pd.DataFrame(rows, columns=["payload", "seq", "offset", "chunk", "size", "bytes"])

    return payloads.select("payload", F.col("bytes").cast("binary")).mapInPandas(cut, "payload string, seq int, offset long, chunk string, size long, bytes binary")


def merkle_root(leaves: DataFrame) -> DataFrame:
    """(payload, root) over chunk hashes (payload, seq, chunk): pairs are hashed level by level, an odd one moves up."""
    from pyspark.sql.window import Window

    level = leaves.select("payload", F.col("seq").cast("long").alias("seq"), F.col("chunk").alias("h"))
    while True:
        many = level.agg(F.max("seq")).first()[0]
        if not many:
            return level.select("payload", F.col("h").alias("root"))
        pair = Window.partitionBy("payload", F.floor(F.col("seq") / 2))
        level = checkpointed(level)
        both = level.withColumn("right", F.max(F.when(F.col("seq") % 2 == 1, F.col("h"))).over(pair)).where("seq % 2 = 0")
        level = both.select("payload", F.floor(F.col("seq") / 2).alias("seq"), F.when(F.col("right").isNull(), F.col("h")).otherwise(F.sha2(F.concat("h", "right"), 256)).alias("h"))
