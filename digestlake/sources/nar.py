"""Nix archives: reading, writing, and the archive of a single file as a column."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.functions.codecs import Malformed
from digestlake.plans.workspace import shipped

#: Fixed value of the published format.
MAGIC = b"nix-archive-1"
SCHEMA = "path string, kind string, target string, size long, digest string"
#: Parts nested deeper than this are refused.
DEPTH = 256


def text(raw: bytes) -> bytes:
    """A string of the format: its length, its bytes, and zeros up to eight."""
    return struct.pack("<Q", len(raw)) + raw + b"\0" * (-len(raw) % 8)


def write_nar(tree: dict | bytes | tuple) -> bytes:
    """The archive of a node: a dict of names is a directory, bytes are a file, ("x", bytes) an executable one, ("l", bytes) a symlink."""
    def node(x: dict | bytes | tuple) -> list[bytes]:
        if isinstance(x, dict):
            out = [b"(", b"type", b"directory"]
            for name in sorted(x):
                out += [b"entry", b"(", b"name", name, b"node", *node(x[name]), b")"]
            return [*out, b")"]
        if isinstance(x, tuple) and x[0] == "l":
            return [b"(", b"type", b"symlink", b"target", x[1], b")"]
        mode = [b"executable", b""] if isinstance(x, tuple) else []
        return [b"(", b"type", b"regular", *mode, b"contents", x[1] if isinstance(x, tuple) else x, b")"]

    return b"".join(map(text, [MAGIC, *node(tree)]))


def nodes(raw: bytes) -> list[tuple[str, str, str | None, bytes]]:
    """(path, kind, target, contents) of every node, parents first; kinds are d, f, x and l. The root has an empty path.

    Names must ascend and be proper, padding must be zero, and nothing may follow the root.
    """
    out, at = [], 0

    def take() -> bytes:
        nonlocal at
        if at + 8 > len(raw):
            raise Malformed("the archive ends early")
        n = struct.unpack_from("<Q", raw, at)[0]
        end = at + 8 + n + -n % 8
        if end > len(raw) or any(raw[at + 8 + n : end]):
            raise Malformed("the archive ends early or has a bad padding")
        value = raw[at + 8 : at + 8 + n]
        at = end
        return value

    def want(*values: bytes) -> None:
        for v in values:
            if (got := take()) != v:
                raise Malformed(f"{v!r} is due, not {got[:20]!r}")

    def node(path: str, depth: int) -> None:
        if depth > DEPTH:
            raise Malformed("the archive is nested too deeply")
        want(b"(", b"type")
        kind = take()
        if kind == b"directory":
            out.append((path, "d", None, b""))
            last = None
            while (key := take()) == b"entry":
                want(b"(", b"name")
                name = take()
                if name in (b"", b".", b"..") or b"/" in name or b"\0" in name or (last is not None and name <= last):
                    raise Malformed("names are not proper or not in order")
                last = name
                want(b"node")
                node(f"{path}/{name.decode('utf-8', 'surrogateescape')}".lstrip("/"), depth + 1)
                want(b")")
            if key != b")":
                raise Malformed("no entry of a directory")
        elif kind == b"regular":
            key, mode = take(), "f"
            if key == b"executable":
                want(b"")
                key, mode = take(), "x"
            body = b""
            if key == b"contents":
                body, key = take(), take()
            if key != b")":
                raise Malformed("no part of a file")
            out.append((path, mode, None, body))
        elif kind == b"symlink":
            want(b"target")
            out.append((path, "l", take().decode("utf-8", "surrogateescape"), b""))
            want(b")")
        else:
            raise Malformed("no kind of a node")

    want(MAGIC)
    node("", 0)
    if at != len(raw):
        raise Malformed("data after the root")
    return out


def read_nar(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, target, size, digest) of every node of the archives under path."""
    shipped(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                rows = [(p, k, t, len(b), hashlib.sha256(b).hexdigest() if k in "fx" else None) for p, k, t, b in nodes(bytes(raw))]
                yield pd.DataFrame(rows, columns=["path", "kind", "target", "size", "digest"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, SCHEMA)


def file_prefix() -> bytes:
    """What stands before the length of a plain file's body."""
    return b"".join(map(text, [MAGIC, b"(", b"type", b"regular", b"contents"]))


def file_nar(body: Column) -> Column:
    """The archive of a plain file with this body, as binary; the JVM builds it."""
    raw = body.cast("binary")
    n = F.octet_length(raw).cast("long")
    big = F.lpad(F.hex(n), 16, "0")
    little = F.unhex(F.concat(*[F.substring(big, i, 2) for i in range(15, 0, -2)]))
    pad = F.unhex(F.repeat(F.lit("00"), F.pmod(-n, F.lit(8)).cast("int")))
    return F.concat(F.lit(file_prefix()), little, raw, pad, F.lit(text(b")")))
