"""Payloads as copies from a held payload plus literals, and tree deltas in the pack format of Git."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.functions.codecs import Malformed, compress, decompress
from digestlake.functions.hashing import cut_points
from digestlake.plans.workspace import shipped

MAGIC = b"digestlake-delta-1\0"
#: Average length of the pieces by which equal content is found, and the most plain bytes of one literal.
PIECE, LITERAL = 1024, 1 << 20
LITERAL_TOKEN, COPY_TOKEN, END_TOKEN = 0, 1, 2


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading bytes are equal; blocks grow, so long equal runs are cheap."""
    n, at, step = min(len(a), len(b)), 0, 256
    while at < n:
        differ = np.nonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])[0]
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def copies(new: bytes, old: bytes) -> list[tuple[int, int, int]]:
    """(start in new, start in old, length) of runs taken from old, in order and apart.

    Pieces with content-defined ends are looked up among those of old, confirmed byte for byte and grown both ways.
    """
    held: dict[bytes, int] = {}
    at = 0
    for end in cut_points(old, PIECE):
        held.setdefault(old[at:end], at)
        at = end
    a, b, out, done, at = np.frombuffer(new, np.uint8), np.frombuffer(old, np.uint8), [], 0, 0
    for end in cut_points(new, PIECE):
        start, at = at, end
        if start < done or (there := held.get(new[start:end])) is None:
            continue
        back = _same(a[done:start][::-1], b[:there][::-1])
        ahead = _same(a[end:], b[there + end - start :])
        out.append((start - back, there - back, back + end - start + ahead))
        done = end + ahead
    return out


def encode_delta(new: bytes, old: bytes) -> bytes:
    """A frame that turns old into new: the length, then literals (compressed) and copies in order, then an end."""
    out, at = [MAGIC, struct.pack("<Q", len(new))], 0
    for start, there, size in [*copies(new, old), (len(new), 0, 0)]:
        for low in range(at, start, LITERAL):
            plain = new[low : min(start, low + LITERAL)]
            packed = compress(plain)
            out.append(struct.pack("<BQQ", LITERAL_TOKEN, len(plain), len(packed)) + packed)
        if size:
            out.append(struct.pack("<BQQ", COPY_TOKEN, there, size))
        at = start + size
    return b"".join([*out, struct.pack("<B", END_TOKEN)])


def tokens(frame: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """("literal", 0, length, bytes) and ("copy", start in old, length, b"") of a frame, which must be whole."""
    def number(form: str) -> int:
        nonlocal at
        if at + struct.calcsize(form) > len(frame):
            raise Malformed("the frame ends early")
        at += struct.calcsize(form)
        return struct.unpack_from(form, frame, at - struct.calcsize(form))[0]

    at = len(MAGIC)
    if not frame.startswith(MAGIC):
        raise Malformed("no frame of this kind")
    left = number("<Q")
    while (kind := number("<B")) != END_TOKEN:
        if kind == LITERAL_TOKEN:
            size, packed = number("<Q"), number("<Q")
            if not 0 < size <= min(left, LITERAL) or at + packed > len(frame):
                raise Malformed("a literal is outside its bounds")
            plain = decompress(frame[at : at + packed], size)
            at += packed
            if len(plain) != size:
                raise Malformed("a literal has another length")
            yield "literal", 0, size, plain
        elif kind == COPY_TOKEN:
            start, size = number("<Q"), number("<Q")
            if not 0 < size <= left:
                raise Malformed("a copy is outside its bounds")
            yield "copy", start, size, b""
        else:
            raise Malformed("no token of this kind")
        left -= size
    if left or at != len(frame):
        raise Malformed("the frame does not give the length it names")


def apply_delta(frame: bytes, old: bytes) -> bytes:
    out = []
    for _, start, size, plain in tokens(frame):
        if not plain and start + size > len(old):
            raise Malformed("a copy reaches past the end of its source")
        out.append(plain or old[start : start + size])
    return b"".join(out)


def deltas(pairs: DataFrame, key: str) -> DataFrame:
    """(key, frame, literals, literal_bytes, copies, copy_bytes) of pairs (key, new, old); null counts as empty."""
    shipped(pairs.sparkSession)
    names = [key, "frame", "literals", "literal_bytes", "copies", "copy_bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, new, old in zip(pdf[key], pdf["new"], pdf["old"]):
                frame = encode_delta(bytes(new or b""), bytes(old or b""))
                parts = [(kind, size) for kind, _, size, _ in tokens(frame)]
                of = {w: [n for kind, n in parts if kind == w] for w in ("literal", "copy")}
                rows.append((k, frame, len(of["literal"]), sum(of["literal"]), len(of["copy"]), sum(of["copy"])))
            yield pd.DataFrame(rows, columns=names)

    kind = pairs.select(key).schema[0].dataType.simpleString()
    rows = pairs.select(key, F.col("new").cast("binary").alias("new"), F.col("old").cast("binary").alias("old"))
    return rows.mapInPandas(run, f"{key} {kind}, frame binary, literals long, literal_bytes long, copies long, copy_bytes long")


def patched_from(frames: DataFrame, key: str) -> DataFrame:
    """(key, bytes) rebuilt from frames (key, frame, old)."""
    shipped(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "bytes": [apply_delta(bytes(f), bytes(o or b"")) for f, o in zip(pdf["frame"], pdf["old"])]})

    kind = frames.select(key).schema[0].dataType.simpleString()
    return frames.select(key, "frame", F.col("old").cast("binary").alias("old")).mapInPandas(run, f"{key} {kind}, bytes binary")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def tree_delta(new: bytes, old: bytes, least: int = 16) -> bytes:
    """A Git pack delta that copies runs equal at the same offset, of least bytes or more, and inserts the rest."""
    n = min(len(new), len(old))
    equal = np.zeros(n + 2, dtype=np.int8)
    equal[1:-1] = np.frombuffer(new, np.uint8, n) == np.frombuffer(old, np.uint8, n)
    edge = np.diff(equal)
    runs = [(int(a), int(b)) for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]) if b - a >= least]
    out, at = [_varint(len(old)), _varint(len(new))], 0
    for a, b in [*runs, (len(new), len(new))]:
        out += [bytes([len(x)]) + x for i in range(at, a, 127) if (x := new[i : min(a, i + 127)])]
        for low in range(a, b, 0xFFFFFF):
            fields = struct.pack("<I", low) + struct.pack("<I", min(b - low, 0xFFFFFF))[:3]
            out.append(bytes([128 | sum(1 << i for i, x in enumerate(fields) if x)]) + bytes(x for x in fields if x))
        at = b
    return b"".join(out)


def apply_tree_delta(delta: bytes, old: bytes) -> bytes:
    at = 0

    def byte() -> int:
        nonlocal at
        if at >= len(delta):
            raise Malformed("the delta ends early")
        at += 1
        return delta[at - 1]

    def length() -> int:
        n = shift = 0
        while True:
            x = byte()
            n |= (x & 127) << shift
            shift += 7
            if x < 128:
                return n

    have, want, out = length(), length(), []
    if have != len(old):
        raise Malformed("the delta is for another base")
    while at < len(delta):
        op = byte()
        if op & 128:
            fields = bytes(byte() if op >> i & 1 else 0 for i in range(7))
            start, size = int.from_bytes(fields[:4], "little"), int.from_bytes(fields[4:], "little") or 0x10000
            if start + size > len(old):
                raise Malformed("a copy reaches past the end of its base")
            out.append(old[start : start + size])
        elif op:
            if at + op > len(delta):
                raise Malformed("the delta ends early")
            out.append(delta[at : at + op])
            at += op
        else:
            raise Malformed("no instruction")
    whole = b"".join(out)
    if len(whole) != want:
        raise Malformed("the delta gives another length")
    return whole
