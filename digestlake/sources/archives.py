"""Files, tar and image layers as rows, and a deterministic archive of a repository."""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import struct
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.plans.workspace import checkpointed, shipped
from digestlake.sources import nar

FILES = "path string, kind string, target string, size long, digest string"
_REGISTRY: dict[str, Callable] = {}


def register_importer(name: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
    """An importer turns a path into rows of FILES."""
    _REGISTRY[name] = read


def importer(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return _REGISTRY[name]


def detect(head: bytes) -> str:
    """What a file is, by its first 512 bytes: archive, nar, tar, or blob."""
    if head.startswith(MAGIC):
        return "archive"
    if head.startswith(nar.text(nar.MAGIC)):
        return "nar"
    if len(head) >= 512 and head[148:156].strip(b" \0"):
        try:
            want = int(head[148:156].strip(b" \0"), 8)
        except ValueError:
            return "blob"
        if want == sum(head[:148]) + 8 * 32 + sum(head[156:512]):
            return "tar"
    return "blob"


def check_path(path: str) -> str:
    """A tar member's path without its last slash; refused if absolute or with odd components."""
    clean = path[:-1] if path.endswith("/") else path
    parts = clean.split("/")
    if not clean or any(p in ("", ".", "..") or len(p.encode()) > 255 or "\0" in p for p in parts):
        raise ValueError(f"no relative path: {path!r}")
    return clean


def tar_rows(raw: bytes) -> list[tuple[str, str, str | None, int, str | None]]:
    """(path, kind, target, size, digest) of a tar: d, f, x, l, h. Duplicates and other kinds are refused."""
    out, seen = [], set()
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        for m in tar:
            path = check_path(m.name.removeprefix("./")) if m.name not in (".", "./") else ""
            if not path:
                continue
            if path in seen:
                raise ValueError(f"{path} is there twice")
            seen.add(path)
            if m.isdir():
                out.append((path, "d", None, 0, None))
            elif m.issym():
                if m.linkname.startswith("/") or posixpath.normpath(posixpath.join(posixpath.dirname(path), m.linkname)).startswith(".."):
                    raise ValueError(f"{path} points outside")
                out.append((path, "l", m.linkname, 0, None))
            elif m.islnk():
                out.append((path, "h", check_path(m.linkname.removeprefix("./")), 0, None))
            elif m.isreg() and not m.issparse():
                body = tar.extractfile(m).read()
                out.append((path, "x" if m.mode & 0o111 else "f", None, len(body), hashlib.sha256(body).hexdigest()))
            else:
                raise ValueError(f"{path} is of a kind that is not taken")
    return out


def resolve_hardlinks(files: DataFrame, rounds: int = 32) -> DataFrame:
    """files with hard links replaced by the file they end at; a cycle or another end raises.

    Each round points every link at its target's target, so chains halve.
    """
    plain, links = files.where("kind != 'h'"), checkpointed(files.where("kind = 'h'").select("path", "target"))
    for _ in range(rounds):
        step = links.select(F.col("path").alias("__p"), F.col("target").alias("__t"))
        links = checkpointed(links.join(step, links["target"] == step["__p"], "left").select("path", F.coalesce("__t", "target").alias("target"), F.col("__t").isNotNull().alias("open")))
        if links.where("open").isEmpty():
            break
        links = links.drop("open")
    else:
        raise ValueError("hard links without an end")
    ends = plain.where("kind IN ('f', 'x')").select(F.col("path").alias("__p"), "kind", "size", "digest")
    found = links.join(ends, links["target"] == ends["__p"], "left")
    if not found.where("__p IS NULL").isEmpty():
        raise ValueError("hard links without a file at their end")
    return plain.unionByName(found.select("path", "kind", F.lit(None).cast("string").alias("target"), "size", "digest"))


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FILES of every tar under path, a task per archive."""
    shipped(spark)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                yield pd.DataFrame(tar_rows(bytes(raw)), columns=["path", "kind", "target", "size", "digest"])

    return resolve_hardlinks(spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, FILES))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FILES of a directory tree."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    top = F.lit(path.rstrip("/") + "/")
    relative = F.element_at(F.split(F.col("path"), top, 2), 2)
    return rows.select(relative.alias("path"), F.lit("f").alias("kind"), F.lit(None).cast("string").alias("target"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"))


register_importer("tar", read_tar)
register_importer("files", read_files)
register_importer("nar", nar.read_nar)


def select_platform(index: list[dict], platform: str) -> dict:
    """The first manifest of an image index for OS/ARCH[/VARIANT]."""
    want = dict(zip(("os", "architecture", "variant"), platform.split("/")))
    return next(m for m in index if all(m.get("platform", {}).get(k) == v for k, v in want.items()))


def layer_rows(layers: list[bytes], diff_ids: list[str]) -> list[tuple[int, str, bool, str | None]]:
    """(layer, path, whiteout, node) of image layers, whose hashes must be the given ones."""
    out = []
    for n, (raw, want) in enumerate(zip(layers, diff_ids, strict=True)):
        if "sha256:" + hashlib.sha256(raw).hexdigest() != want:
            raise ValueError(f"layer {n} does not match its id")
        for path, kind, target, _, digest in tar_rows(raw):
            top, _, name = path.rpartition("/")
            if name == ".wh..wh..opq":
                out.append((n, f"{top}/*", True, None))
            elif name.startswith(".wh."):
                out.append((n, f"{top}/{name[4:]}".lstrip("/"), True, None))
            else:
                out.append((n, path, False, f"{kind}:{digest or target or ''}"))
    return out


#: First bytes of an archive written here.
MAGIC = b"DLAKE\0\1\n"


def write_archive(roots: list[tuple[str, str]], payloads: list[tuple[str, bytes]], records: list[tuple[str, str, list[str]]]) -> bytes:
    """Sorted roots, payloads and records as one deterministic byte string that ends in its own hash.

    A driver-side format for one closure; larger exports stay tables.
    """
    def frame(tag: bytes, head: object, body: bytes = b"") -> bytes:
        text = json.dumps(head, sort_keys=True, separators=(",", ":")).encode()
        return tag + struct.pack("<QQ", len(text), len(body)) + text + body

    out = [MAGIC, frame(b"R", sorted(set(roots)))]
    out += [frame(b"P", p, raw) for p, raw in sorted(payloads)]
    out += [frame(b"O", [i, p, sorted(links)]) for i, p, links in sorted(records)]
    whole = b"".join(out)
    return whole + b"E" + hashlib.sha256(whole).digest()


def read_archive(data: bytes) -> tuple[list[tuple[str, str]], dict[str, bytes], list[tuple[str, str, list[str]]]]:
    """roots, payloads and records of an archive; refused if a byte, a payload hash or the membership is wrong."""
    if not data.startswith(MAGIC) or data[-33:-32] != b"E" or hashlib.sha256(data[:-33]).digest() != data[-32:]:
        raise ValueError("no whole archive")
    at, end = len(MAGIC), len(data) - 33
    roots, payloads, records = [], {}, []
    while at < end:
        tag, (n, size) = data[at : at + 1], struct.unpack("<QQ", data[at + 1 : at + 17])
        head, body = json.loads(data[at + 17 : at + 17 + n]), data[at + 17 + n : at + 17 + n + size]
        at += 17 + n + size
        if tag == b"R":
            roots = [tuple(r) for r in head]
        elif tag == b"P":
            if hashlib.sha256(body).hexdigest() != head:
                raise ValueError(f"payload {head} does not match its hash")
            payloads[head] = body
        else:
            records.append((head[0], head[1], head[2]))
    links = {i: x for i, _, x in records}
    todo, reached = [i for _, i in roots], set()
    while todo:
        if (i := todo.pop()) not in reached:
            if i not in links:
                raise ValueError(f"record {i} is missing")
            reached.add(i)
            todo += links[i]
    if reached != set(links) or {p for _, p, _ in records} != set(payloads):
        raise ValueError("the archive holds more than its roots reach")
    return roots, payloads, records


def needles(texts: DataFrame, key: str, body: str, wanted: list[str]) -> DataFrame:
    """(key, index) of every needle that a body holds. The needles are a short list, repeats included."""
    found = F.filter(F.array(*[F.when(F.col(body).contains(n), F.lit(i)) for i, n in enumerate(wanted)]), lambda x: x.isNotNull())
    return texts.select(key, F.explode(found).alias("index"))
