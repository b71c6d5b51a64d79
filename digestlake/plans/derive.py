"""A content-addressed repository derived from the driver's tables, as one SQL text for both engines.

SHA(x) and BLEN(x) stand for the SHA-256 in hex and the byte length of a string, TS(x) for microseconds. Regions hold
nations, nations hold customers and suppliers, customers hold orders, and orders link to the suppliers of their lines,
so suppliers are shared. Documents are further objects, named by roots lang/<lang>/<source>. Regions 3 and 4 have no
root, so what only they reach is garbage; the destination repository lacks every third object.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.operators.keys import packed, unpacked
from digestlake.plans.workspace import checkpointed

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

DERIVED: dict[str, str] = {
    "nodes": """
        SELECT 'region' AS kind, CAST(r_regionkey AS BIGINT) AS k, r_name AS body FROM region
        UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), n_name FROM nation
        UNION ALL SELECT 'customer', CAST(c_custkey AS BIGINT), concat(c_name, '|', c_mktsegment) FROM customer
        UNION ALL SELECT 'order', CAST(o_orderkey AS BIGINT), concat(o_orderstatus, '|', o_orderpriority, '|', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)) FROM orders
        UNION ALL SELECT 'supplier', CAST(s_suppkey AS BIGINT), s_name FROM supplier
        UNION ALL SELECT 'doc', doc_id, text FROM documents""",
    "objects": """
        SELECT CASE WHEN kind = 'doc' THEN 'doc.v1' WHEN kind = 'supplier' THEN 'blob.v1' ELSE 'tree.v1' END AS namespace,
               SHA(concat(kind, ':', CAST(k AS STRING))) AS native_id, kind, k, SHA(body) AS payload, CAST(BLEN(body) AS BIGINT) AS payload_size,
               k % 8 AS created_generation, k % 5 = 0 AS validated FROM nodes""",
    "links": """
        SELECT SHA(concat('region:', CAST(n_regionkey AS STRING))) AS src, SHA(concat('nation:', CAST(n_nationkey AS STRING))) AS dst, CAST(n_nationkey AS BIGINT) AS ordinal FROM nation
        UNION ALL SELECT SHA(concat('nation:', CAST(c_nationkey AS STRING))), SHA(concat('customer:', CAST(c_custkey AS STRING))), CAST(c_custkey AS BIGINT) FROM customer
        UNION ALL SELECT SHA(concat('nation:', CAST(s_nationkey AS STRING))), SHA(concat('supplier:', CAST(s_suppkey AS STRING))), 100000000 + CAST(s_suppkey AS BIGINT) FROM supplier
        UNION ALL SELECT SHA(concat('customer:', CAST(o_custkey AS STRING))), SHA(concat('order:', CAST(o_orderkey AS STRING))), CAST(o_orderkey AS BIGINT) FROM orders
        UNION ALL SELECT SHA(concat('order:', CAST(l_orderkey AS STRING))), SHA(concat('supplier:', CAST(l_suppkey AS STRING))), CAST(l_suppkey AS BIGINT)
                  FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) AS pairs""",
    "roots": """
        SELECT concat('regions/', r_name) AS name, 'tree.v1' AS namespace, SHA(concat('region:', CAST(r_regionkey AS STRING))) AS native_id FROM region WHERE r_regionkey < 3
        UNION ALL SELECT concat('lang/', lang, '/', source), 'doc.v1', SHA(concat('doc:', CAST(min(doc_id) AS STRING))) FROM documents GROUP BY lang, source""",
    "policy": "SELECT name, CASE WHEN BLEN(name) % 2 = 0 THEN 'evictable' ELSE 'permanent' END AS retention, CAST(BLEN(name) * 7919 % 1000 AS BIGINT) AS last_use FROM roots",
    "dst_objects": "SELECT * FROM objects WHERE k % 3 <> 0",
    "dst_roots": "SELECT name, namespace, CASE WHEN BLEN(name) % 3 = 0 THEN SHA(name) ELSE native_id END AS native_id FROM roots WHERE BLEN(name) % 5 <> 0",
    "payloads": "SELECT payload, max(payload_size) AS size FROM objects GROUP BY payload",
    "manifest": """
        SELECT payload, seq, SHA(substring(body, seq * 256 + 1, 256)) AS chunk, CAST(BLEN(substring(body, seq * 256 + 1, 256)) AS BIGINT) AS size, substring(body, seq * 256 + 1, 256) AS bytes
        FROM (SELECT SHA(text) AS payload, text AS body, SEQ((greatest(length(text), 1) - 1) DIV 256) AS seq FROM (SELECT DISTINCT text FROM documents) AS t) AS s""",
    "stored_chunks": """
        SELECT chunk, CASE WHEN substring(chunk, 3, 2) = '0a' THEN concat('~', substring(bytes, 2)) WHEN substring(chunk, 3, 2) = '0b' THEN concat(bytes, '~') ELSE bytes END AS bytes
        FROM (SELECT chunk, min(bytes) AS bytes FROM manifest GROUP BY chunk) AS m WHERE substring(chunk, 5, 2) <> 'c0'""",
    "replica_chunks": "SELECT chunk, CASE WHEN substring(chunk, 7, 2) = '01' THEN concat('~', bytes) ELSE bytes END AS bytes FROM (SELECT chunk, min(bytes) AS bytes FROM manifest GROUP BY chunk) AS m",
    "offline": "SELECT DISTINCT chunk FROM manifest WHERE substring(chunk, 1, 2) = '7f'",
    "root_states": """
        SELECT name, CASE WHEN BLEN(name) % 7 = 0 THEN substring(concat('r1 ', native_id, ' ', substring(SHA(native_id), 1, 8)), 1, 40)
                          WHEN BLEN(name) % 11 = 0 THEN concat('r1 ', SHA(native_id), ' ', substring(SHA(native_id), 1, 8))
                          ELSE concat('r1 ', native_id, ' ', substring(SHA(native_id), 1, 8)) END AS state FROM roots""",
    "pack_entries": """
        SELECT substring(chunk, 1, 2) AS pack, chunk, max(size) AS raw_len, CAST(floor(max(size) / 2) AS BIGINT) + 16 AS framed_len, substring(chunk, 64, 1) IN ('0', '1', '2', '3', '4', '5', '6') AS dead
        FROM manifest GROUP BY chunk""",
    "entries": """
        SELECT l.src AS dir, concat(o.kind, '-', CAST(o.k AS STRING)) AS name,
               CASE WHEN o.kind IN ('region', 'nation', 'customer') THEN 'd' WHEN o.k % 11 = 0 THEN 'l' WHEN o.k % 7 = 0 THEN 'x' ELSE 'f' END AS kind,
               o.native_id AS digest, o.payload_size AS size
        FROM links l JOIN objects o ON l.dst = o.native_id WHERE l.src NOT IN (SELECT native_id FROM objects WHERE kind = 'order')""",
    "kv": "SELECT 'doc.meta' AS namespace, concat(source, '/', CAST(doc_id AS STRING)) AS key, lang AS value FROM documents",
    "pins": """
        SELECT concat('pin', CAST(user_id AS STRING)) AS token, CASE user_id % 4 WHEN 0 THEN 'snapshot' WHEN 1 THEN 'closures' WHEN 2 THEN 'object' ELSE 'blob' END AS scope,
               user_id % 2 AS generation, SHA(concat('order:', CAST(user_id AS STRING))) AS native_id
        FROM (SELECT DISTINCT user_id FROM events) AS u""",
    "cached": "SELECT CAST(p_size AS BIGINT) AS device, p_partkey AS inode, CAST(floor(p_retailprice) AS BIGINT) AS size, p_partkey * 10 AS mtime, p_partkey * 10 AS ctime, SHA(p_name) AS blob FROM part",
    "seen": "SELECT device, inode, size, mtime + CASE WHEN inode % 10 = 0 THEN 1 ELSE 0 END AS mtime, ctime FROM cached WHERE inode % 4 <> 0",
    "runs": "SELECT user_id AS key, event_id % 5 AS generation, ts, event_id, event_type AS value FROM events",
    "files": "SELECT page_id, CAST(page_id % 3 AS INT) AS layer, CASE WHEN page_id % 7 = 0 THEN regexp_extract(url, '^https?://([^/?#]+/[^/?#]+)', 1) ELSE regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') END AS path, page_id % 7 = 0 AS whiteout, SHA(html) AS node FROM pages",
}


def _balanced(text: str, name: str, make) -> str:
    """Replace name(argument) by make(argument), innermost last."""
    while (at := re.search(rf"\b{name}\(", text)) is not None:
        depth, i = 1, at.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[: at.start()] + make(text[at.end() : i - 1]) + text[i:]
    return text


def spark_sql(text: str) -> str:
    text = _balanced(text, "SHA", lambda x: f"sha2({x}, 256)")
    text = _balanced(text, "BLEN", lambda x: f"octet_length({x})")
    return _balanced(text, "SEQ", lambda x: f"explode(sequence(0, {x}))")


def duck_sql(text: str) -> str:
    text = _balanced(text, "SHA", lambda x: f"sha256({x})")
    text = _balanced(text, "BLEN", lambda x: f"strlen({x})")
    return _balanced(text, "SEQ", lambda x: f"unnest(generate_series(0, {x}))").replace(" DIV ", " // ")


def _needed(text: str, found: list[str]) -> list[str]:
    for name in DERIVED:
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(DERIVED[name], found)
            found.append(name)
    return found


def with_derived(body: str) -> str:
    """DuckDB SQL for body over the derived tables that it names. body may itself begin with WITH [RECURSIVE]."""
    parts = [f"{name} AS ({duck_sql(DERIVED[name])})" for name in _needed(body, [])]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    rest = body[own.end() :] if own else body
    if not parts:
        return duck_sql(body)
    return "WITH RECURSIVE " + ",\n".join(parts) + (",\n" if own else "\n") + duck_sql(rest)


class Repo:
    """The derived tables as DataFrames, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made, self._settled = spark, sf_dir, {}, set()

    def settle(self, *names: str) -> Repo:
        """This repository with derived tables written once, for queries that read them often. Chunk bytes stay behind."""
        for name in names:
            if name not in self._settled:
                self._settled.add(name)
                self._made[name] = checkpointed(getattr(self, name).drop("bytes"))
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*BASE, *DERIVED):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "entries":
                self._made[name] = self._entries()
            elif name == "links":  # one exchange serves the DISTINCT and leaves the links of an order in one task
                self._made[name] = self._derived(name, lineitem=self.lineitem.repartition("l_orderkey"))
            else:
                self._made[name] = self._derived(name)
        return self._made[name]

    def _derived(self, name: str, **given: DataFrame) -> DataFrame:
        """The table from its SQL, over given tables where there are any and this repository's others."""
        text = spark_sql(DERIVED[name])
        used = [t for t in (*BASE, *DERIVED) if t != name and re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
        for t in used:
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return self.spark.sql(text, **{t: given[t] if t in given else getattr(self, t) for t in used})

    def _entries(self) -> DataFrame:
        """The table entries. Spark runs the NOT IN of its SQL by sending every order's id to the driver and on to each
        executor. Here the lines of orders are taken out by their number before links are made of the rest, as no other
        link comes from an order. What NOT IN makes of nulls stays: an order without a number leaves no entry, and a
        link without a source is one only if there are no orders."""
        lines = self.lineitem.join(self.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
        orders = self.orders.agg(F.count("*").alias("__n"), F.count("o_orderkey").alias("__keyed"))  # one row
        links = self._derived("links", lineitem=lines).join(F.broadcast(orders)).where("__n = 0 OR (__n = __keyed AND src IS NOT NULL)")
        links = links.where("dst IS NOT NULL").select(packed("src").alias("dir"), packed("dst").alias("digest"))
        kind = F.when(F.col("kind").isin("region", "nation", "customer"), "d").when(F.col("k") % 11 == 0, "l").when(F.col("k") % 7 == 0, "x").otherwise("f")
        name = F.concat("kind", F.lit("-"), F.col("k").cast("string"))
        named = self.objects.select(packed("native_id").alias("digest"), name.alias("name"), kind.alias("kind"), F.col("payload_size").alias("size"))
        return links.join(named, "digest").select(unpacked("dir").alias("dir"), "name", "kind", unpacked("digest").alias("digest"), "size")
