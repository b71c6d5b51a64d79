"""Proofs that a byte range belongs to a BLAKE3 digest, and digests of overwritten payloads from such a proof.

The tree has blocks of 16 KiB as leaves. A proof lists, parents first, the two child hashes of every parent above a
wanted block and the bytes of every wanted block, so a reader checks the range with the digest alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.functions.hashing import groups, parents, subtrees
from digestlake.plans.workspace import shipped

BLOCK = 16 << 10
#: Bytes of payloads or proofs that a worker hashes at once.
PART = 2 << 20


class ProofError(ValueError):
    """A proof that the digest does not confirm, or a range past the end."""


def _blocks(total: int) -> int:
    return max(1, -(-total // BLOCK))


def _checked(total: int, offset: int, size: int) -> tuple[int, int]:
    """The first block of a range and the one after its last."""
    if offset < 0 or size < 0 or offset + size > total:
        raise ProofError(f"range {offset}..{offset + size} is not in {total} bytes")
    return offset // BLOCK, _blocks(offset + size)


def _middle(low: int, high: int) -> int:
    """Where a subtree of blocks splits: the left side is the largest power of two below its count."""
    return low + (1 << (high - low - 1).bit_length() - 1)


def _leaves(blocks: list[tuple[bytes, int, bool]]) -> list[bytes]:
    """The hashes of blocks (bytes, number, whether it is the root), side by side."""
    out = []
    for some in groups([len(raw) for raw, _, _ in blocks]):
        part = blocks[some]
        first = np.array([at * (BLOCK >> 10) for _, at, _ in part], dtype=np.int64)
        out += [v.tobytes() for v in subtrees([raw for raw, _, _ in part], first, np.array([top for _, _, top in part])).astype("<u4")]
    return out


def _joined(pairs: list[tuple[bytes, bool]]) -> list[bytes]:
    """The hashes of parents (both children's hashes, whether it is the root), side by side."""
    if not pairs:
        return []
    words = np.frombuffer(b"".join(both for both, _ in pairs), dtype="<u4").reshape(-1, 16).astype(np.uint32)
    return [v.tobytes() for v in parents(words, np.array([top for _, top in pairs])).astype("<u4")]


def _trees(payloads: list[bytes]) -> list[dict[tuple[int, int], bytes]]:
    """For each payload the hash of every subtree of blocks [low, high)."""
    counts = [_blocks(len(p)) for p in payloads]
    made = iter(_leaves([(p[i * BLOCK : (i + 1) * BLOCK], i, n == 1) for p, n in zip(payloads, counts) for i in range(n)]))
    out = []
    for n in counts:
        level = {(i, i + 1): next(made) for i in range(n)}
        found = dict(level)
        while len(level) > 1:
            nodes = list(level)
            pairs = list(zip(nodes[::2], nodes[1::2]))
            up = dict(zip([(a[0], b[1]) for a, b in pairs], _joined([(level[a] + level[b], len(nodes) == 2) for a, b in pairs])))
            found |= up
            level = up | ({nodes[-1]: level[nodes[-1]]} if len(nodes) % 2 else {})
        out.append(found)
    return out


def outboard(data: bytes) -> tuple[bytes, bytes]:
    """The digest, and the child hashes of all parents, parents first."""
    found = _trees([data])[0]
    return found[0, _blocks(len(data))], _listed(data, found, 0, 0, False)


def prove_many(payloads: list[bytes], offset: int, size: int) -> list[tuple[bytes, bytes]]:
    """The digest of each payload, and its proof of bytes [offset, offset + size). An empty range has an empty proof."""
    out = []
    for data, found in zip(payloads, _trees(payloads)):
        first, last = _checked(len(data), offset, size)
        out.append((found[0, _blocks(len(data))], _listed(data, found, first, last, True) if size else b""))
    return out


def prove(data: bytes, offset: int, size: int) -> tuple[bytes, bytes]:
    return prove_many([data], offset, size)[0]


def _listed(data: bytes, found: dict[tuple[int, int], bytes], first: int, last: int, leaves: bool) -> bytes:
    out, todo = [], [(0, _blocks(len(data)))]
    while todo:
        low, high = todo.pop()
        if leaves and (high <= first or low >= last):
            continue
        if high - low == 1:
            out.append(data[low * BLOCK : high * BLOCK] if leaves else b"")
            continue
        at = _middle(low, high)
        out.append(found[low, at] + found[at, high])
        todo += [(at, high), (low, at)]
    return b"".join(out)


class _Parsed:
    """The nodes of a proof by blocks [low, high), in its order, and the hash that each must have."""

    def __init__(self, proof: bytes, digest: bytes, total: int, offset: int, size: int):
        first, last = _checked(total, offset, size)
        self.blocks, self.top = {}, _blocks(total)
        self.pairs: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        self.want = {(0, self.top): digest}
        place, todo = 0, [(0, self.top)] if size else []
        while todo:
            low, high = todo.pop()
            if high <= first or low >= last:
                continue
            n = min(BLOCK, total - low * BLOCK) if high - low == 1 else 64
            part, place = proof[place : place + n], place + n
            if len(part) < n:
                raise ProofError("the proof ends early")
            if high - low == 1:
                self.blocks[low] = part
                continue
            at = _middle(low, high)
            self.pairs[low, high] = self.want[low, at], self.want[at, high] = part[:32], part[32:]
            todo += [(at, high), (low, at)]
        if place != len(proof):
            raise ProofError("bytes after the proof")

    def leaves(self) -> list[tuple[bytes, int, bool]]:
        return [(raw, k, self.top == 1) for k, raw in self.blocks.items()]

    def parents(self) -> list[tuple[bytes, bool]]:
        return [(a + b, node == (0, self.top)) for node, (a, b) in self.pairs.items()]

    def confirmed(self, leaves: list[bytes], joined: list[bytes]) -> bool:
        return all(self.want[k, k + 1] == h for k, h in zip(self.blocks, leaves)) and all(self.want[n] == h for n, h in zip(self.pairs, joined))


Proof = tuple[bytes, bytes, int]


def _open(proofs: list[Proof], offset: int, size: int) -> list[_Parsed | None]:
    """Proofs (proof, digest, length) that their digests confirm; None for the others."""
    parsed: list[_Parsed | None] = []
    for proof, digest, total in proofs:
        try:
            parsed.append(_Parsed(proof, digest, total, offset, size))
        except ProofError:
            parsed.append(None)
    good = [p for p in parsed if p is not None]
    leaves, joined = iter(_leaves([x for p in good for x in p.leaves()])), iter(_joined([x for p in good for x in p.parents()]))
    return [p if p is not None and p.confirmed([next(leaves) for _ in p.blocks], [next(joined) for _ in p.pairs]) else None for p in parsed]


def proven_many(proofs: list[Proof], offset: int, size: int) -> list[bytes | None]:
    """The bytes [offset, offset + size) of each payload from (proof, digest, length); None where a proof fails."""
    low = offset % BLOCK
    return [None if p is None else b"".join(p.blocks.values())[low : low + size] for p in _open(proofs, offset, size)]


def overwritten_many(proofs: list[Proof], offset: int, piece: bytes) -> list[bytes | None]:
    """The digest of each payload after piece replaces as many bytes at offset; unchanged subtrees are not read."""
    opened = _open(proofs, offset, len(piece))

    def patch(block: int, raw: bytes) -> bytes:
        low, high = max(0, offset - block * BLOCK), min(len(raw), offset + len(piece) - block * BLOCK)
        at = block * BLOCK + low - offset
        return raw[:low] + piece[at : at + high - low] + raw[high:]

    new = iter(_leaves([(patch(k, raw), k, top) for p in opened if p is not None for raw, k, top in p.leaves()]))
    out: list[bytes | None] = []
    for p in opened:
        if p is None:
            out.append(None)
            continue
        now = p.want | {(k, k + 1): next(new) for k in p.blocks}
        for low, high in reversed(p.pairs):  # children come after their parents
            at = _middle(low, high)
            now[low, high] = _joined([(now[low, at] + now[at, high], (low, high) == (0, p.top))])[0]
        out.append(now[0, p.top])
    return out


def _refused(value: bytes | None) -> bytes:
    if value is None:
        raise ProofError("the digest does not confirm the proof")
    return value


def proven(proof: bytes, digest: bytes, total: int, offset: int, size: int) -> bytes:
    return _refused(proven_many([(proof, digest, total)], offset, size)[0])


def overwritten(proof: bytes, digest: bytes, total: int, offset: int, piece: bytes) -> bytes:
    return _refused(overwritten_many([(proof, digest, total)], offset, piece)[0])


def _parts(rows: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """rows in runs that hold about PART bytes of column each, one row at least."""
    ends, at = np.cumsum(rows[column].map(len).to_numpy(dtype=np.int64)), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, side="right")))
        yield rows.iloc[at:end]
        at = end


def range_proofs(payloads: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    """(key, digest, total, proof) of payloads (key, bytes) that hold the range; shorter ones give no row."""
    shipped(payloads.sparkSession)
    schema = f"{payloads.select(key).schema[0].simpleString().replace(':', ' ')}, digest binary, total long, proof binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in _parts(whole, "bytes")):
            raws = [bytes(raw) for raw in pdf["bytes"]]
            rows = [(k, digest, len(raw), proof) for k, raw, (digest, proof) in zip(pdf[key], raws, prove_many(raws, offset, size))]
            yield pd.DataFrame(rows, columns=[key, "digest", "total", "proof"])

    rows = payloads.select(key, F.col("bytes").cast("binary").alias("bytes")).where(F.octet_length("bytes") >= offset + size)
    return rows.mapInPandas(run, schema)


def open_proofs(proofs: DataFrame, key: str, offset: int, size: int, piece: bytes | None = None) -> DataFrame:
    """(key, bytes, digest_after) of the proven ranges; digest_after is the digest with piece in place, or null.

    A proof that does not hold gives null bytes.
    """
    shipped(proofs.sparkSession)
    schema = f"{proofs.select(key).schema[0].simpleString().replace(':', ' ')}, bytes binary, digest_after binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in _parts(whole, "proof")):
            given = [(bytes(proof), bytes(digest), int(total)) for proof, digest, total in zip(pdf["proof"], pdf["digest"], pdf["total"])]
            after = [None] * len(given) if piece is None else overwritten_many(given, offset, piece)
            rows = list(zip(pdf[key], proven_many(given, offset, size), after))
            yield pd.DataFrame(rows, columns=[key, "bytes", "digest_after"])

    return proofs.select(key, "digest", "total", "proof").mapInPandas(run, schema)
