"""Scalar functions over identifiers, names and paths, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64url(raw: Column) -> Column:
    """Unpadded base64url of bytes."""
    return F.rtrim(F.translate(F.base64(raw), "+/", "-_"), F.lit("="))


def key_text(namespace: Column, native_id_hex: Column) -> Column:
    """The text form namespace:base64url of an object key."""
    return F.concat(namespace, F.lit(":"), base64url(F.unhex(native_id_hex)))


def valid_namespace(name: Column) -> Column:
    """ASCII labels joined by dots and a version, 64 bytes at most."""
    return name.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.v[0-9]+$") & (F.octet_length(name) <= 64)


def valid_root(name: Column) -> Column:
    """1 to 1024 bytes; segments of 1 to 255 bytes between slashes."""
    return F.octet_length(name).between(1, 1024) & F.forall(F.split(name, "/"), lambda s: F.octet_length(s).between(1, 255))


def valid_component(name: Column) -> Column:
    """1 to 255 bytes without a slash; neither . nor .. ."""
    return F.octet_length(name).between(1, 255) & ~name.contains("/") & ~name.isin(".", "..")


def git_oid(kind: str, body: Column, algorithm: str = "sha1") -> Column:
    """Git's id: the hash of type, size and body."""
    whole = F.concat(F.lit(kind + " ").cast("binary"), F.octet_length(body).cast("string").cast("binary"), F.lit(b"\0"), body.cast("binary"))
    return F.sha1(whole) if algorithm == "sha1" else F.sha2(whole, 256)


def link_stays_inside(path: Column, target: Column) -> Column:
    """A relative symlink at path never climbs above the root. A lexical walk keeps the lowest depth."""
    start = F.size(F.split(path, "/")) - 1
    step = lambda a, s: F.struct(
        (d := a["depth"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("depth"), F.least(a["low"], d).alias("low")
    )
    walked = F.aggregate(F.split(target, "/"), F.struct(start.alias("depth"), start.alias("low")), step)
    return ~target.startswith("/") & (walked["low"] >= 0)


def resolve_shortcut(name: Column, default_scope: str | None = None) -> Column:
    """Root names from what a user types: /literal, scope:rest, a bare name in the default scope, else the name."""
    first = F.split(name, "/")[0]
    scoped = F.concat(F.split(first, ":")[0], F.lit("/"), F.substring(name, F.instr(name, ":") + 1, 100_000))
    out = F.when(name.startswith("/"), F.substring(name, 2, 100_000)).when(first.contains(":"), scoped)
    if default_scope is not None:
        out = out.when(~name.contains("/"), F.concat(F.lit(default_scope + "/"), name))
    return out.otherwise(name)


def under_pressure(used: Column, total: Column, percent: int) -> Column:
    """used is at or above the percentage of total; decimals keep the products from overflowing."""
    return used.cast("decimal(20,0)") * 100 >= total.cast("decimal(20,0)") * percent


def patched(body: Column, at: int, piece: Column) -> Column:
    """body with piece written over it from byte position at (0-based); the length stays."""
    return F.overlay(body, piece, F.lit(at + 1))
