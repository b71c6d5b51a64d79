"""Git objects as rows: commits, tags and trees to links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestlake.plans.workspace import shipped


def header(body: Column) -> Column:
    """Everything before the first blank line."""
    return F.split(body, "\n\n")[0]


def commit_links(commits: DataFrame) -> DataFrame:
    """(oid, kind, target) for the tree and the parents that a commit body (oid, body) names."""
    lines = commits.select("oid", F.explode(F.split(header(F.col("body")), "\n")).alias("line"))
    found = lines.where(F.col("line").rlike("^(tree|parent) [0-9a-f]{40}([0-9a-f]{24})?$"))
    parts = F.split("line", " ")
    return found.select("oid", parts[0].alias("kind"), parts[1].alias("target")).distinct()


def tag_links(tags: DataFrame) -> DataFrame:
    """(oid, kind, target) of the object that a tag body names; a tag needs one object and one type."""
    head = F.split(header(F.col("body")), "\n")
    objects, types = F.filter(head, lambda x: x.startswith("object ")), F.filter(head, lambda x: x.startswith("type "))
    valid = tags.where((F.size(objects) == 1) & (F.size(types) == 1))
    return valid.select("oid", F.substring(types[0], 6, 100).alias("kind"), F.substring(objects[0], 8, 100).alias("target"))


def parse_tree(raw: bytes, width: int = 20) -> list[tuple[str, bytes, str]]:
    """(mode, name, oid) of a tree body, refused unless the names are in Git's order."""
    out, at, last = [], 0, None
    while at < len(raw):
        space, zero = raw.index(b" ", at), raw.index(b"\0", at)
        mode, name, oid = raw[at:space].decode(), raw[space + 1 : zero], raw[zero + 1 : zero + 1 + width]
        if len(oid) != width or not name:
            raise ValueError("a tree ends early")
        key = name + (b"/" if mode == "40000" else b"")
        if last is not None and last >= key:
            raise ValueError("a tree is not in order")
        out.append((mode, name, oid.hex()))
        last, at = key, zero + 1 + width
    return out


def tree_links(trees: DataFrame, width: int = 20) -> DataFrame:
    """(oid, mode, name, target) of tree bodies (oid, body); submodules are no links."""
    shipped(trees.sparkSession)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(oid, mode, name.decode("utf-8", "surrogateescape"), target) for oid, body in zip(pdf["oid"], pdf["body"]) for mode, name, target in parse_tree(bytes(body), width) if mode != "160000"]
            yield pd.DataFrame(rows, columns=["oid", "mode", "name", "target"])

    return trees.select("oid", F.col("body").cast("binary")).mapInPandas(parse, "oid string, mode string, name string, target string")


def inventory_errors(reached: DataFrame, inventory: DataFrame) -> DataFrame:
    """Where a view's inventory and what its refs reach differ, in both directions."""
    missing = reached.select("native_id").join(inventory, "native_id", "left_anti").select(F.lit("NotListed").alias("kind"), "native_id")
    extra = inventory.select("native_id").join(reached, "native_id", "left_anti").select(F.lit("NotReached").alias("kind"), "native_id")
    return missing.unionByName(extra)
