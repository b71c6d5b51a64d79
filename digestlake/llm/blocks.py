"""Blocks: bounded runs of documents that a task met in its scan, and byte columns that describe them.

Operators that need an answer for each distinct item of the corpus (a pre-token, an anchor) send each block's distinct
items to buckets, let a bucket answer each item once, and send the answers back to the blocks. A hot item then costs a
row per block, not a row per document.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text after which a task starts a new block.
BLOCK_BYTES = 16 << 20


def block_id(part: int, number: int) -> int:
    return (part << 24) | number


def varints(values: np.ndarray) -> bytes:
    """Unsigned integers below 2**35 as little-endian base-128 numbers."""
    v = np.asarray(values, dtype=np.uint64)
    if not len(v):
        return b""
    shifts = np.arange(5, dtype=np.uint64) * np.uint64(7)
    groups = (v[:, None] >> shifts) & np.uint64(127)
    used = np.maximum(1, 5 - (groups[:, ::-1] != 0).argmax(axis=1) * (v != 0))
    used = np.where(v == 0, 1, used)
    place = np.arange(5)[None, :]
    out = groups.astype(np.uint8) | np.where(place < used[:, None] - 1, 128, 0).astype(np.uint8)
    return out[place < used[:, None]].tobytes()


def unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    last = np.nonzero(raw < 128)[0]
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)
