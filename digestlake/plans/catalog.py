"""The queries of the reference's operators and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from digestlake.functions import deltas, hashing, proofs, text
from digestlake.operators import collect, folds, graph, packs, pins, scans, sync
from digestlake.plans.derive import Repo, with_derived
from digestlake.sources import archives, git, nar

Query = Callable[[Repo], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}
NAMESPACES = ["tree.v1", "blob.v1"]


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(make: Query) -> Query:
        _QUERIES[name] = (make, sql)
        return make

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, make=make: make(Repo(spark, sf_dir))) for name, (make, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_derived(sql) for name, (_, sql) in _QUERIES.items() if sql is not None}


def region(k: int) -> str:
    import hashlib

    return hashlib.sha256(f"region:{k}".encode()).hexdigest()


def asked(r: Repo) -> DataFrame:
    """A request with an order, repeats, and keys that are not there."""
    rows = r.orders.select((F.col("o_orderkey") * 2).alias("ordinal"), F.sha2(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")), 256).alias("native_id"))
    again = rows.select((F.col("ordinal") + 1).alias("ordinal"), "native_id")
    gone = rows.select((-F.col("ordinal")).alias("ordinal"), F.sha2("native_id", 256).alias("native_id"))
    return rows.unionByName(again).unionByName(gone)


ASKED = """asked AS (SELECT o_orderkey * 2 AS ordinal, SHA(concat('order:', CAST(o_orderkey AS STRING))) AS native_id FROM orders
  UNION ALL SELECT o_orderkey * 2 + 1, SHA(concat('order:', CAST(o_orderkey AS STRING))) FROM orders
  UNION ALL SELECT -o_orderkey * 2, SHA(SHA(concat('order:', CAST(o_orderkey AS STRING)))) FROM orders)"""
REACH = "reach AS (SELECT native_id FROM roots UNION SELECT links.dst FROM reach JOIN links ON links.src = reach.native_id)"
MARK = """seed AS (SELECT native_id FROM roots UNION SELECT native_id FROM objects WHERE created_generation <= (SELECT max(generation) FROM pins WHERE scope = 'snapshot')
  UNION SELECT native_id FROM pins WHERE scope IN ('closures', 'object')),
walk AS (SELECT native_id FROM seed UNION SELECT links.dst FROM walk JOIN links ON links.src = walk.native_id),
marked AS (SELECT DISTINCT native_id FROM walk WHERE native_id IN (SELECT native_id FROM objects))"""


def tree(objects: DataFrame) -> DataFrame:
    return objects.where("kind != 'doc'")


def region_roots(r: Repo) -> DataFrame:
    return r.roots.where("name LIKE 'regions/%'")


# ---- reads ---------------------------------------------------------------------------------------------------------


@add("scan_objects", "SELECT namespace, native_id, payload, payload_size FROM objects")
def _(r):
    return r.objects.select("namespace", "native_id", "payload", "payload_size").orderBy("namespace", "native_id")


@add("scan_objects_unordered", "SELECT native_id, validated FROM objects")
def _(r):
    return r.objects.select("native_id", "validated")


@add("scan_objects_created_through", "SELECT native_id, created_generation FROM objects WHERE created_generation <= 3")
def _(r):
    return scans.created_through(r.objects, 3).select("native_id", "created_generation")


@add("scan_roots", "SELECT name, namespace, native_id FROM roots")
def _(r):
    return r.roots.orderBy("name")


@add("scan_roots_under", "SELECT name, native_id FROM roots WHERE name = 'lang/en' OR name LIKE 'lang/en/%'")
def _(r):
    return r.roots.where(scans.under(F.col("name"), "lang/en")).select("name", "native_id")


@add("lookup_object", f"SELECT namespace, native_id, payload FROM objects WHERE native_id = '{region(1)}'")
def _(r):
    return r.objects.where(F.col("native_id") == region(1)).select("namespace", "native_id", "payload")


@add("lookup_object_batch", f"WITH {ASKED} SELECT a.ordinal, a.native_id, o.namespace, o.payload, CAST(o.created_generation AS VARCHAR) AS created_generation FROM asked a LEFT JOIN objects o ON a.native_id = o.native_id")
def _(r):
    found = scans.lookup(asked(r), r.objects, "native_id", ["namespace", "payload", "created_generation"])
    return found.withColumn("created_generation", F.col("created_generation").cast("string"))


@add("lookup_payload_batch", f"WITH {ASKED} SELECT a.ordinal, o.payload, CAST(o.payload_size AS VARCHAR) AS payload_size FROM asked a LEFT JOIN objects o ON a.native_id = o.native_id")
def _(r):
    return scans.lookup(asked(r), r.objects, "native_id", ["payload", "payload_size"]).select("ordinal", "payload", F.col("payload_size").cast("string"))


@add("lookup_validated_payload_batch", f"WITH {ASKED} SELECT a.ordinal, o.payload, CAST(o.payload_size AS VARCHAR) AS payload_size FROM asked a LEFT JOIN objects o ON a.native_id = o.native_id AND o.validated")
def _(r):
    return scans.lookup(asked(r), r.objects, "native_id", ["payload", "payload_size"], F.col("validated")).select("ordinal", "payload", F.col("payload_size").cast("string"))


@add("lookup_validated_closures", f"WITH {ASKED} SELECT a.ordinal, coalesce(o.validated, false) AS validated FROM asked a LEFT JOIN objects o ON a.native_id = o.native_id")
def _(r):
    return scans.lookup(asked(r), r.objects, "native_id", ["validated"]).select("ordinal", F.coalesce("validated", F.lit(False)).alias("validated"))


@add("lookup_root", "SELECT name, native_id FROM roots WHERE name = 'regions/ASIA'")
def _(r):
    return r.roots.where("name = 'regions/ASIA'").select("name", "native_id")


@add("kv_get_batch", "SELECT q.ordinal, q.key, kv.value FROM (SELECT doc_id AS ordinal, concat('src0/', CAST(doc_id AS STRING)) AS key FROM documents) q LEFT JOIN kv ON q.key = kv.key")
def _(r):
    want = r.documents.select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("src0/"), F.col("doc_id").cast("string")).alias("key"))
    return scans.lookup(want, r.kv, "key", ["value"])


@add("kv_scan_page", "SELECT key, value, count(*) OVER () > 20 AS has_more FROM (SELECT key, value FROM kv WHERE key LIKE 'src0/%' AND key > 'src0/2' ORDER BY key LIMIT 21) ORDER BY key LIMIT 20")
def _(r):
    return scans.key_page(r.kv.select("key", "value"), "key", "src0/", "src0/2", 20)


@add("kv_scan_page_budget", """SELECT key, value, count(*) FILTER (WHERE NOT keeps) OVER () > 0 AS has_more FROM (
  SELECT key, value, n <= 40 AND bytes <= 300 AS keeps FROM (SELECT key, value, row_number() OVER (ORDER BY key) AS n, sum(strlen(key) + coalesce(strlen(value), 0)) OVER (ORDER BY key) AS bytes
    FROM (SELECT key, value FROM kv WHERE key LIKE 'src1/%' AND key > 'src1/1' ORDER BY key LIMIT 41))) QUALIFY keeps""")
def _(r):
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return scans.key_page(r.kv.select("key", "value"), "key", "src1/", "src1/1", 40, size, 300)


@add("facts_page", "SELECT blob, size, count(*) OVER () > 15 AS has_more FROM (SELECT blob, max(size) AS size FROM cached WHERE blob > '8' GROUP BY blob ORDER BY blob LIMIT 16) ORDER BY blob LIMIT 15")
def _(r):
    return scans.key_page(r.cached.groupBy("blob").agg(F.max("size").alias("size")), "blob", "", "8", 15)


@add("facts_edit_and_clear", "SELECT key, max_by(value, (ts, event_id)) AS value FROM (SELECT * FROM runs WHERE generation >= 2) GROUP BY key")
def _(r):
    return folds.last_writer(r.runs.where("generation >= 2").select("key", "ts", "event_id", "value"), ["key"], ["ts", "event_id"]).select("key", "value")


_FACTS = "(SELECT blob AS identity, CASE WHEN min(inode) % 7 = 0 THEN '' ELSE CAST(min(inode) AS VARCHAR) END AS facts FROM cached GROUP BY blob UNION ALL SELECT 'generation', '41')"


def facts(r: Repo) -> DataFrame:
    """A verification store: a number or nothing for each blob, and the generation."""
    least = F.min("inode")
    own = r.cached.groupBy(F.col("blob").alias("identity")).agg(F.when(least % 7 == 0, "").otherwise(least.cast("string")).alias("facts"))
    return own.unionByName(r.spark.range(1).select(F.lit("generation").alias("identity"), F.lit("41").alias("facts")))


@add("facts_edit", f"""WITH f AS (SELECT * FROM {_FACTS}), keys AS (SELECT DISTINCT CASE WHEN inode % 2 = 0 THEN blob ELSE SHA(blob) END AS identity FROM cached WHERE inode % 3 = 0)
  SELECT * FROM (SELECT coalesce(f.identity, keys.identity) AS identity, CASE WHEN keys.identity IS NULL THEN facts WHEN f.identity IS NULL THEN 'new' WHEN facts = '' THEN NULL ELSE concat(facts, '+') END AS facts
  FROM f FULL JOIN keys ON f.identity = keys.identity) WHERE facts IS NOT NULL""")
def _(r):
    keys = r.cached.where("inode % 3 = 0").select(F.when(F.col("inode") % 2 == 0, F.col("blob")).otherwise(F.sha2("blob", 256)).alias("identity"))
    return folds.edit_facts(facts(r), keys, lambda fact: F.when(fact.isNull(), "new").when(fact != "", F.concat(fact, F.lit("+"))))


@add("facts_clear", f"SELECT * FROM {_FACTS} WHERE facts = '' UNION ALL SELECT 'generation', '42' UNION ALL SELECT 'tombstone', ''")
def _(r):
    return folds.clear_facts(facts(r), "tombstone", "generation")


@add("list_blobs", "SELECT DISTINCT payload FROM manifest")
def _(r):
    return r.manifest.select("payload").distinct()


@add("list_chunks", "SELECT DISTINCT chunk FROM pack_entries")
def _(r):
    return r.pack_entries.select("chunk").distinct()


@add("payload_chunks", "SELECT payload, seq, chunk, size FROM manifest")
def _(r):
    return r.manifest.select("payload", "seq", "chunk", "size")


@add("snapshot_view", "SELECT created_generation, count(*) AS objects, CAST(sum(payload_size) AS BIGINT) AS bytes FROM objects WHERE created_generation <= 5 GROUP BY created_generation")
def _(r):
    return scans.created_through(r.objects, 5).groupBy("created_generation").agg(F.count("*").alias("objects"), F.sum("payload_size").alias("bytes"))


@add("log_replay", "SELECT key, arg_max(value, (generation, ts, event_id)) AS value FROM runs GROUP BY key")
def _(r):
    return folds.last_writer(r.runs.select("key", "generation", "ts", "event_id", "value"), ["key"], ["generation", "ts", "event_id"]).select("key", "value")


@add("shard_lookup", "SELECT substring(native_id, 1, 2) AS shard, count(*) AS objects, min(native_id) AS least FROM objects GROUP BY 1")
def _(r):
    return r.objects.groupBy(F.substring("native_id", 1, 2).alias("shard")).agg(F.count("*").alias("objects"), F.min("native_id").alias("least"))


@add("shard_routed_lookup", f"""WITH {ASKED}, zones AS (SELECT substring(native_id, 1, 2) AS shard, min(native_id) AS low, max(native_id) AS high FROM objects GROUP BY 1)
  SELECT a.ordinal, a.native_id, z.shard, o.payload FROM asked a LEFT JOIN zones z ON substring(a.native_id, 1, 2) = z.shard AND a.native_id BETWEEN z.low AND z.high LEFT JOIN objects o ON a.native_id = o.native_id""")
def _(r):
    return scans.shard_lookup(asked(r), r.objects, "native_id", ["payload"]).select("ordinal", "native_id", "shard", "payload")


@add("chunk_locations", "SELECT m.chunk, min(p.pack) AS pack, count(*) AS uses FROM manifest m LEFT JOIN pack_entries p ON m.chunk = p.chunk GROUP BY m.chunk")
def _(r):
    uses = r.manifest.groupBy("chunk").agg(F.count("*").alias("uses"))
    return uses.join(r.pack_entries.select("chunk", "pack"), "chunk", "left").select("chunk", "pack", "uses")


@add("resolve_oid", """WITH c AS (SELECT substring(native_id, 1, 4) AS oid, count(*) AS n, min(native_id) AS one FROM objects GROUP BY 1)
  SELECT q.oid, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN one END AS native_id FROM (SELECT DISTINCT substring(payload, 1, 4) AS oid FROM objects WHERE kind = 'doc') q LEFT JOIN c ON q.oid = c.oid""")
def _(r):
    return scans.resolve_unique(r.objects, r.objects.where("kind = 'doc'").select(F.substring("payload", 1, 4).alias("oid")).distinct())


@add("view_read_clamped", "SELECT doc_id, sha256(unhex(substring(hex(encode(text)), 201, 100))) AS part FROM documents WHERE text IS NOT NULL")
def _(r):
    return doc_bytes(r).select("doc_id", F.sha2(scans.read_range(F.col("bytes"), 100, 50), 256).alias("part"))


@add("view_lookup_entries", f"SELECT name, kind, digest, size FROM entries WHERE dir = '{region(2)}'")
def _(r):
    return r.entries.where(F.col("dir") == region(2)).select("name", "kind", "digest", "size")


@add("object_show", """SELECT o.native_id, o.payload, o.payload_size, count(l.dst) AS links, min(l.dst) AS first_link, o.validated FROM objects o LEFT JOIN links l ON o.native_id = l.src
  GROUP BY o.native_id, o.payload, o.payload_size, o.validated""")
def _(r):
    links = r.links.groupBy(F.col("src").alias("native_id")).agg(F.count("*").alias("links"), F.min("dst").alias("first_link"))
    return r.objects.join(links, "native_id", "left").select("native_id", "payload", "payload_size", F.coalesce("links", F.lit(0)).alias("links"), "first_link", "validated")


@add("holds_inventory", """SELECT token, concat('{"scope":"', scope, '","generation":', CAST(generation AS STRING), ',"native_id":"', native_id, '"}') AS hold FROM pins""")
def _(r):
    return r.pins.select("token", F.to_json(F.struct("scope", "generation", "native_id")).alias("hold"))


@add("sidecar_inventory", "SELECT payload, count(*) AS chunks FROM manifest GROUP BY payload HAVING count(*) > 1")
def _(r):
    return r.manifest.groupBy("payload").agg(F.count("*").alias("chunks")).where("chunks > 1")


# ---- imports -------------------------------------------------------------------------------------------------------

_SAME = "c.device = s.device AND c.inode = s.inode AND c.size = s.size AND c.mtime = s.mtime AND c.ctime = s.ctime"


@add("import_unchanged_files", f"SELECT c.inode, c.blob FROM cached c JOIN seen s ON {_SAME}")
def _(r):
    return r.cached.join(r.seen, ["device", "inode", "size", "mtime", "ctime"]).select("inode", "blob")


@add("import_changed_files", f"SELECT s.device, s.inode FROM seen s WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE {_SAME})")
def _(r):
    return r.seen.join(r.cached, ["device", "inode", "size", "mtime", "ctime"], "left_anti").select("device", "inode")


@add("import_blobs", "SELECT DISTINCT sha256(text) AS payload, CAST(strlen(text) AS BIGINT) AS size FROM conversations")
def _(r):
    return r.conversations.select(F.sha2("text", 256).alias("payload"), F.octet_length("text").cast("long").alias("size")).distinct()


@add("import_tar_conflicts", """WITH p AS (SELECT DISTINCT path FROM files), a AS (SELECT path AS below, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path
  FROM (SELECT path, unnest(generate_series(1, greatest(len(string_split(path, '/')) - 1, 1))) AS n FROM p))
  SELECT DISTINCT a.path, a.below FROM a JOIN p ON a.path = p.path WHERE a.path <> a.below""")
def _(r):
    return folds.path_conflicts(r.files).select("path", "below")


@add("import_layers", """WITH f AS (SELECT DISTINCT layer, path, whiteout, node FROM files),
  live AS (SELECT * FROM f WHERE NOT whiteout AND NOT EXISTS (SELECT 1 FROM f w WHERE w.whiteout AND w.layer > f.layer AND (f.path = w.path OR starts_with(f.path, w.path || '/')))),
  kept AS (SELECT * FROM live WHERE NOT EXISTS (SELECT 1 FROM live u WHERE u.layer > live.layer AND starts_with(live.path, u.path || '/')))
  SELECT path, max(layer) AS layer, max_by(node, (layer, node)) AS node FROM kept GROUP BY path""")
def _(r):
    return folds.merge_layers(r.files.select("layer", "path", "whiteout", "node").distinct())


@add("import_repository_copy", "SELECT o.native_id, o.payload FROM objects o WHERE o.native_id NOT IN (SELECT native_id FROM dst_objects)")
def _(r):
    return r.objects.join(r.dst_objects, "native_id", "left_anti").select("native_id", "payload")


_ARCHIVE = """reach AS (SELECT native_id FROM roots WHERE name LIKE 'regions/%' UNION SELECT links.dst FROM reach JOIN links ON links.src = reach.native_id)"""


@add("export_archive_plan", f"WITH RECURSIVE {_ARCHIVE} SELECT payload, min(native_id) AS native_id, max(payload_size) AS size, count(*) AS shared FROM objects WHERE native_id IN (SELECT native_id FROM reach) GROUP BY payload")
def _(r):
    reached = graph.closure(r.links, region_roots(r)).select("native_id")
    kept = r.objects.join(reached, "native_id", "left_semi").withColumn("namespace", F.lit(""))
    return folds.collapse(kept).select("payload", "native_id", "size", "shared")


@add("import_archive_membership", f"""WITH RECURSIVE {_ARCHIVE}, own AS (SELECT * FROM dst_objects WHERE kind <> 'doc'), sent AS (SELECT DISTINCT payload FROM objects WHERE kind <> 'doc' AND k % 5 <> 1)
  SELECT 'MissingRecord' AS kind, native_id AS id FROM reach WHERE native_id NOT IN (SELECT native_id FROM own)
  UNION ALL SELECT 'ExtraRecord', native_id FROM own WHERE native_id NOT IN (SELECT native_id FROM reach)
  UNION ALL SELECT DISTINCT 'MissingPayload', payload FROM own WHERE payload NOT IN (SELECT payload FROM sent)
  UNION ALL SELECT 'ExtraPayload', payload FROM sent WHERE payload NOT IN (SELECT payload FROM own)""")
def _(r):
    return sync.archive_errors(tree(r.dst_objects), r.links, region_roots(r), tree(r.objects).where("k % 5 != 1"))


@add("cat_payload", "SELECT DISTINCT sha256(text) AS payload, text AS bytes FROM documents WHERE length(text) > 0")
def _(r):
    return folds.reassemble(r.manifest).where("bytes != ''")


@add("near_or_far_read", """SELECT o.native_id, CASE WHEN d.native_id IS NOT NULL THEN d.payload ELSE f.payload END AS payload, CASE WHEN d.native_id IS NOT NULL THEN 'near' WHEN f.native_id IS NOT NULL THEN 'far' ELSE 'none' END AS place
  FROM objects o LEFT JOIN dst_objects d ON o.native_id = d.native_id LEFT JOIN (SELECT * FROM objects WHERE k % 2 = 0) f ON o.native_id = f.native_id""")
def _(r):
    return sync.near_or_far(r.objects.select("native_id"), r.dst_objects, r.objects.where("k % 2 = 0"), "native_id", "payload")


# ---- scalar functions ----------------------------------------------------------------------------------------------


@add("key_text_forms", """SELECT native_id, concat(namespace, ':', rtrim(translate(to_base64(unhex(native_id)), '+/', '-_'), '=')) AS key_text,
  concat('blake3-', rtrim(translate(to_base64(unhex(payload)), '+/', '-_'), '=')) AS payload_text FROM objects""")
def _(r):
    return r.objects.select("native_id", text.key_text(F.col("namespace"), F.col("native_id")).alias("key_text"), F.concat(F.lit("blake3-"), text.base64url(F.unhex("payload"))).alias("payload_text"))


@add("validators", """SELECT name, regexp_full_match(replace(name, '/', '.') || '.v1', '[a-z0-9-]+(\\.[a-z0-9-]+)*\\.v[0-9]+') AND strlen(name) + 3 <= 64 AS ok_namespace,
  strlen(name) BETWEEN 1 AND 1024 AND len(list_filter(string_split(name, '/'), lambda x: strlen(x) NOT BETWEEN 1 AND 255)) = 0 AS ok_root, strlen(name) BETWEEN 1 AND 255 AND NOT contains(name, '/') AND name NOT IN ('.', '..') AS ok_component FROM roots""")
def _(r):
    return r.roots.select(
        "name", text.valid_namespace(F.concat(F.replace(F.col("name"), F.lit("/"), F.lit(".")), F.lit(".v1"))).alias("ok_namespace"),
        text.valid_root(F.col("name")).alias("ok_root"), text.valid_component(F.col("name")).alias("ok_component"),
    )


@add("hash_identities", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(r):
    return r.documents.select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@add("blake3_identity")
def _(r):
    return r.pages.select("page_id", hashing.blake3_hex(F.col("html")).alias("blake3"))


@add("git_blob_ids", "SELECT doc_id, sha1(concat('blob ', CAST(strlen(text) AS VARCHAR), chr(0), text)) AS oid, sha256(concat('blob ', CAST(strlen(text) AS VARCHAR), chr(0), text)) AS oid256 FROM documents")
def _(r):
    return r.documents.select("doc_id", text.git_oid("blob", F.col("text")).alias("oid"), text.git_oid("blob", F.col("text"), "sha256").alias("oid256"))


@add("tree_list", "SELECT dir, name, kind, digest FROM entries")
def _(r):
    return r.entries.select("dir", "name", "kind", "digest").orderBy("dir", "name")


@add("run_discovery", "SELECT dir, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(name) END AS chosen, string_agg(name, ',' ORDER BY name) AS listed FROM entries WHERE kind = 'x' GROUP BY dir")
def _(r):
    names = F.array_sort(F.collect_list("name"))
    return r.entries.where("kind = 'x'").groupBy("dir").agg(F.count("*").alias("candidates"), F.when(F.count("*") == 1, F.min("name")).alias("chosen"), F.array_join(names, ",").alias("listed"))


@add("run_shortcuts", """SELECT name, t AS typed, CASE WHEN starts_with(t, '/') THEN substr(t, 2) WHEN contains(string_split(t, '/')[1], ':') THEN concat(string_split(string_split(t, '/')[1], ':')[1], '/', substr(t, instr(t, ':') + 1))
  WHEN NOT contains(t, '/') THEN concat('home/', t) ELSE t END AS resolved
  FROM (SELECT name, CASE strlen(name) % 4 WHEN 0 THEN '/' || name WHEN 1 THEN regexp_replace(name, '/', ':') WHEN 2 THEN replace(name, '/', '-') ELSE name END AS t FROM roots)""")
def _(r):
    n, size = F.col("name"), F.octet_length("name") % 4
    typed = F.when(size == 0, F.concat(F.lit("/"), n)).when(size == 1, F.regexp_replace(n, "^([^/]*)/", "$1:")).when(size == 2, F.replace(n, F.lit("/"), F.lit("-"))).otherwise(n)
    return r.roots.select("name", typed.alias("typed")).withColumn("resolved", text.resolve_shortcut(F.col("typed"), "home"))


@add("workspace_scoping", "SELECT name, concat('ws-1/', name) AS scoped, regexp_replace(concat('ws-1/', name), '^ws-1/', '') AS plain FROM roots")
def _(r):
    scoped = F.concat(F.lit("ws-1/"), F.col("name"))
    return r.roots.select("name", scoped.alias("scoped"), F.regexp_replace(scoped, "^ws-1/", "").alias("plain"))


@add("is_under", "SELECT a.name, b.name AS above FROM roots a JOIN (SELECT DISTINCT regexp_extract(name, '^[^/]+/[^/]+') AS name FROM roots) b ON a.name = b.name OR starts_with(a.name, b.name || '/')")
def _(r):
    above = r.roots.select(F.regexp_extract("name", "^[^/]+/[^/]+", 0).alias("above")).distinct()
    spots = r.roots.select("name", F.explode(F.array_distinct(F.concat(folds.ancestors(F.col("name")), F.array("name")))).alias("above"))
    return spots.join(above, "above").select("name", "above")


@add("symlink_depth", """SELECT page_id, NOT starts_with(target, '/') AND list_min(list_prepend(d0, list_transform(range(1, len(p) + 1), lambda i: d0 + list_sum(list_transform(p[1:i], lambda s: CASE WHEN s = '..' THEN -1 WHEN s IN ('', '.') THEN 0 ELSE 1 END))))) >= 0 AS inside
  FROM (SELECT page_id, target, string_split(target, '/') AS p, len(string_split(path, '/')) - 1 AS d0 FROM (SELECT page_id, path, concat(repeat('../', CAST(page_id % 5 AS INTEGER)), 'a/../b/./c') AS target FROM files))""")
def _(r):
    target = F.concat(F.expr("repeat('../', cast(page_id % 5 as int))"), F.lit("a/../b/./c"))
    return r.files.select("page_id", text.link_stays_inside(F.col("path"), target).alias("inside"))


@add("disk_pressure", "SELECT pack, dead_bytes, body_bytes, CAST(dead_bytes AS HUGEINT) * 100 >= CAST(body_bytes AS HUGEINT) * 30 AS pressed FROM (SELECT pack, CAST(sum(CASE WHEN dead THEN framed_len ELSE 0 END) AS BIGINT) AS dead_bytes, CAST(sum(framed_len) AS BIGINT) AS body_bytes FROM pack_entries GROUP BY pack)")
def _(r):
    return folds.pack_garbage(r.pack_entries).select("pack", "dead_bytes", "body_bytes", text.under_pressure(F.col("dead_bytes"), F.col("body_bytes"), 30).alias("pressed"))


def commits(r: Repo) -> DataFrame:
    """Orders as commits: a tree, parents one and two customers back, and a message that looks like a header."""
    oid = lambda c: F.sha1(c.cast("string"))
    k = F.col("o_orderkey")
    body = F.concat(F.lit("tree "), oid(-k), F.when(k > 1, F.concat(F.lit("\nparent "), oid(k - 1))).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit("\nparent "), oid(k - 2))).otherwise(""), F.lit("\nauthor a\n\nparent "), oid(k))
    return r.orders.select(oid(k).alias("oid"), body.alias("body"), k.alias("k"))


@add("git_commit_links", """SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS oid, 'tree' AS kind, sha1(CAST(-o_orderkey AS VARCHAR)) AS target FROM orders
  UNION ALL SELECT sha1(CAST(o_orderkey AS VARCHAR)), 'parent', sha1(CAST(o_orderkey - 1 AS VARCHAR)) FROM orders WHERE o_orderkey > 1
  UNION ALL SELECT sha1(CAST(o_orderkey AS VARCHAR)), 'parent', sha1(CAST(o_orderkey - 2 AS VARCHAR)) FROM orders WHERE o_orderkey % 5 = 0""")
def _(r):
    return git.commit_links(commits(r))


@add("git_tag_links", "SELECT sha1(concat('tag', CAST(s_suppkey AS VARCHAR))) AS oid, 'commit' AS kind, sha1(CAST(s_suppkey AS VARCHAR)) AS target FROM supplier")
def _(r):
    body = F.concat(F.lit("object "), F.sha1(F.col("s_suppkey").cast("string")), F.lit("\ntype commit\ntag v\n\nobject none"))
    return git.tag_links(r.supplier.select(F.sha1(F.concat(F.lit("tag"), F.col("s_suppkey").cast("string"))).alias("oid"), body.alias("body")))


@add("symbolic_refs", """WITH RECURSIVE refs AS (SELECT concat('r', CAST(s_suppkey AS VARCHAR)) AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'oid' || CAST(s_suppkey AS VARCHAR) ELSE concat('r', CAST(s_suppkey + CASE WHEN s_suppkey % 20 = 5 THEN -1 ELSE 1 END AS VARCHAR)) END AS next FROM supplier),
  walk AS (SELECT name, next AS target, 1 AS hops FROM refs UNION ALL SELECT w.name, refs.next, hops + 1 FROM walk w JOIN refs ON w.target = refs.name WHERE hops < 40)
  SELECT name, max(CASE WHEN target NOT IN (SELECT name FROM refs) THEN target END) AS target, CASE WHEN max(CASE WHEN target NOT IN (SELECT name FROM refs) THEN 1 ELSE 0 END) = 1 THEN 'Resolved' WHEN max(CASE WHEN target = name THEN 1 ELSE 0 END) = 1 THEN 'Cycle' ELSE 'TooDeep' END AS status FROM walk GROUP BY name""")
def _(r):
    k = F.col("s_suppkey")
    name = lambda c: F.concat(F.lit("r"), c.cast("string"))
    after = F.when(k % 10 == 0, F.concat(F.lit("oid"), k.cast("string"))).otherwise(name(k + F.when(k % 20 == 5, -1).otherwise(1)))
    return graph.chase(r.supplier.select(name(k).alias("name"), after.alias("next")))


@add("node_size_contribution", "SELECT dir, name, CAST(CASE WHEN kind = 'd' THEN 1 + size ELSE 1 END AS BIGINT) AS adds FROM entries")
def _(r):
    return r.entries.select("dir", "name", folds.contribution(F.col("kind"), F.col("size")).alias("adds"))


# ---- joins and sets ------------------------------------------------------------------------------------------------


@add("join_unknown_retained", f"WITH {ASKED} SELECT DISTINCT native_id FROM asked WHERE native_id NOT IN (SELECT native_id FROM objects)")
def _(r):
    return asked(r).select("native_id").distinct().join(r.objects, "native_id", "left_anti")


@add("join_omitted_roots", "SELECT name FROM roots WHERE native_id NOT IN (SELECT native_id FROM dst_objects)")
def _(r):
    return r.roots.join(r.dst_objects, "native_id", "left_anti").select("name")


@add("join_dangling_links", "SELECT DISTINCT l.dst FROM links l WHERE l.src IN (SELECT native_id FROM dst_objects) AND l.dst NOT IN (SELECT native_id FROM dst_objects)")
def _(r):
    kept = r.dst_objects.select("native_id")
    return r.links.join(kept, r.links["src"] == kept["native_id"], "left_semi").select("dst").distinct().join(kept, F.col("dst") == F.col("native_id"), "left_anti")


@add("join_retained_records", f"WITH {ASKED} SELECT o.native_id, o.payload FROM objects o JOIN (SELECT DISTINCT native_id FROM asked) a ON o.native_id = a.native_id")
def _(r):
    return r.objects.join(asked(r).select("native_id").distinct(), "native_id").select("native_id", "payload")


@add("join_retained_semi", "SELECT inode FROM cached WHERE blob IN (SELECT blob FROM cached WHERE inode % 2 = 0)")
def _(r):
    return r.cached.join(r.cached.where("inode % 2 = 0").select("blob").distinct(), "blob", "left_semi").select("inode")


@add("join_validated_root_targets", "SELECT native_id FROM objects o WHERE validated AND EXISTS (SELECT 1 FROM roots r WHERE r.native_id = o.native_id)")
def _(r):
    return r.objects.where("validated").join(r.roots, "native_id", "left_semi").select("native_id")


@add("join_frontier", f"SELECT l.src, l.ordinal, l.dst, o.namespace FROM links l JOIN objects o ON l.dst = o.native_id WHERE l.src = '{region(0)}'")
def _(r):
    front = r.links.where(F.col("src") == region(0))
    return front.join(r.objects, front["dst"] == r.objects["native_id"]).select("src", "ordinal", "dst", "namespace")


@add("join_overlay", "SELECT native_id, SHA(payload) AS payload FROM objects WHERE k % 4 = 0 UNION ALL SELECT native_id, payload FROM dst_objects WHERE native_id NOT IN (SELECT native_id FROM objects WHERE k % 4 = 0)")
def _(r):
    staged = r.objects.where("k % 4 = 0").select("native_id", F.sha2("payload", 256).alias("payload"))
    return sync.overlay(staged, r.dst_objects.select("native_id", "payload"), ["native_id"])


@add("join_record_diff", """SELECT coalesce(a.native_id, b.native_id) AS native_id, CASE WHEN b.native_id IS NULL THEN 'New' WHEN a.native_id IS NULL THEN 'TargetOnly' WHEN a.payload = b.payload THEN 'Same' ELSE 'Conflict' END AS status
  FROM (SELECT * FROM objects WHERE k % 7 <> 0) a FULL JOIN (SELECT native_id, CASE WHEN k % 10 = 1 THEN SHA(payload) ELSE payload END AS payload FROM dst_objects) b ON a.native_id = b.native_id""")
def _(r):
    target = r.dst_objects.select("native_id", F.when(F.col("k") % 10 == 1, F.sha2("payload", 256)).otherwise(F.col("payload")).alias("payload"))
    return sync.record_diff(r.objects.where("k % 7 != 0"), target, ["native_id"], "payload")


_HAVE = "(SELECT DISTINCT chunk FROM pack_entries WHERE NOT dead)"


@add("chunks_present", f"SELECT DISTINCT chunk FROM manifest WHERE chunk IN {_HAVE}")
def _(r):
    return r.manifest.select("chunk").distinct().join(r.pack_entries.where("NOT dead"), "chunk", "left_semi")


@add("chunks_missing", f"SELECT DISTINCT chunk FROM manifest WHERE chunk NOT IN {_HAVE}")
def _(r):
    return r.manifest.select("chunk").distinct().join(r.pack_entries.where("NOT dead"), "chunk", "left_anti")


@add("roots_with_policy", "SELECT r.name, p.retention, p.last_use FROM roots r JOIN policy p ON r.name = p.name WHERE p.retention = 'evictable'")
def _(r):
    return r.roots.join(r.policy.where("retention = 'evictable'"), "name").select("name", "retention", "last_use")


@add("layer_whiteouts", "SELECT DISTINCT f.layer, f.path FROM files f WHERE NOT whiteout AND EXISTS (SELECT 1 FROM files w WHERE w.whiteout AND w.layer > f.layer AND (f.path = w.path OR starts_with(f.path, w.path || '/')))")
def _(r):
    spots = r.files.where("NOT whiteout").select("layer", "path", F.explode(F.array_distinct(F.concat(folds.ancestors(F.col("path")), F.array("path")))).alias("a"))
    wiped = r.files.where("whiteout").select(F.col("path").alias("a"), F.col("layer").alias("above"))
    return spots.join(wiped, "a").where("above > layer").select("layer", "path").distinct()


@add("set_difference", "SELECT native_id FROM objects EXCEPT SELECT native_id FROM dst_objects")
def _(r):
    return r.objects.select("native_id").subtract(r.dst_objects.select("native_id"))


@add("set_membership", f"WITH {ASKED} SELECT ordinal, native_id IN (SELECT native_id FROM dst_objects) AS there FROM asked")
def _(r):
    held = r.dst_objects.select("native_id", F.lit(True).alias("held"))
    return scans.lookup(asked(r), held, "native_id", ["held"]).select("ordinal", F.col("held").isNotNull().alias("there"))


@add("set_root_union", "SELECT name FROM roots UNION SELECT name FROM dst_roots")
def _(r):
    return r.roots.select("name").union(r.dst_roots.select("name")).distinct()


@add("set_unreferenced_chunks", "SELECT DISTINCT chunk FROM pack_entries WHERE chunk NOT IN (SELECT chunk FROM manifest WHERE payload IN (SELECT payload FROM dst_objects))")
def _(r):
    used = r.manifest.join(r.dst_objects, "payload", "left_semi").select("chunk")
    return r.pack_entries.select("chunk").distinct().join(used, "chunk", "left_anti")


@add("set_retained_complement", f"WITH RECURSIVE {REACH} SELECT native_id FROM objects WHERE native_id NOT IN (SELECT native_id FROM reach)")
def _(r):
    return r.objects.join(graph.closure(r.links, r.roots), "native_id", "left_anti").select("native_id")


@add("set_intersection", f"WITH {ASKED} SELECT native_id FROM asked INTERSECT SELECT native_id FROM dst_objects")
def _(r):
    return asked(r).select("native_id").intersect(r.dst_objects.select("native_id"))


# ---- aggregates and windows ----------------------------------------------------------------------------------------


@add("merkle_roll_up", """WITH leaf AS (SELECT o_custkey, SHA(concat_ws('|', o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)))) AS h FROM orders),
  c AS (SELECT o_custkey, sha256(string_agg(h, ',' ORDER BY h)) AS h, count(*) AS n FROM leaf GROUP BY 1),
  n AS (SELECT c_nationkey, sha256(string_agg(h, ',' ORDER BY h)) AS h, CAST(sum(n + 1) AS BIGINT) AS n FROM c JOIN customer ON o_custkey = c_custkey GROUP BY 1)
  SELECT CAST(n_regionkey AS BIGINT) AS region, sha256(string_agg(h, ',' ORDER BY h)) AS digest, CAST(sum(n + 1) AS BIGINT) AS size FROM n JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(r):
    leaf = F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)")), 256)
    one, below = F.lit(1), F.col("size") + 1
    c = folds.roll_up(r.orders, "o_custkey", leaf, one).join(r.customer, F.col("o_custkey") == F.col("c_custkey"))
    n = folds.roll_up(c, "c_nationkey", F.col("digest"), below).join(r.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return folds.roll_up(n, "n_regionkey", F.col("digest"), below).select(F.col("n_regionkey").cast("long").alias("region"), "digest", "size")


@add("object_counters", "SELECT namespace, count(*) AS objects, CAST(sum(payload_size) AS BIGINT) AS bytes, count(*) FILTER (WHERE validated) AS validated FROM objects GROUP BY namespace")
def _(r):
    return r.objects.groupBy("namespace").agg(F.count("*").alias("objects"), F.sum("payload_size").alias("bytes"), F.count(F.when(F.col("validated"), 1)).alias("validated"))


@add("payload_collapse", """SELECT payload, min_by(namespace, (namespace, native_id)) AS namespace, min_by(native_id, (namespace, native_id)) AS native_id, max(payload_size) AS size, count(*) AS shared,
  min(payload_size) <> max(payload_size) AS conflict FROM objects GROUP BY payload""")
def _(r):
    return folds.collapse(r.objects)


@add("last_writer_wins", "SELECT key, ts, event_id, generation, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n FROM runs) WHERE n = 1")
def _(r):
    return folds.last_writer(r.runs, ["key"], ["ts", "event_id"])


_GENERATIONS = "(SELECT s_suppkey AS run, s_suppkey * 3 + s_suppkey % 4 AS low, s_suppkey * 3 + 2 + (s_suppkey + 1) % 3 AS high FROM supplier)"


@add("generation_gaps", f"SELECT run, low, high, CASE WHEN b IS NULL OR low = b + 1 THEN 'Ok' WHEN low > b + 1 THEN 'Gap' ELSE 'Overlap' END AS status FROM (SELECT *, lag(high) OVER (ORDER BY low) AS b FROM {_GENERATIONS})")
def _(r):
    k = F.col("s_suppkey")
    return folds.generation_gaps(r.supplier.select(k.alias("run"), (k * 3 + k % 4).alias("low"), (k * 3 + 2 + (k + 1) % 3).alias("high")))


@add("distinct_first_seen", "SELECT event_id, event_id = min(event_id) OVER (PARTITION BY user_id) AS first FROM events")
def _(r):
    return folds.first_seen(r.events.select("event_id", "user_id"), "user_id", "event_id").select("event_id", "first")


@add("pack_garbage", """SELECT pack, dead_bytes, body_bytes, live, CASE WHEN dead_bytes > 0 AND (dead_bytes * 100 >= body_bytes * 50 OR live = 0) THEN 'Rewrite' WHEN dead_bytes > 0 THEN 'Tombstone' ELSE 'Keep' END AS action
  FROM (SELECT pack, CAST(sum(CASE WHEN dead THEN framed_len ELSE 0 END) AS BIGINT) AS dead_bytes, CAST(sum(framed_len) AS BIGINT) AS body_bytes, count(*) FILTER (WHERE NOT dead) AS live FROM pack_entries GROUP BY pack)""")
def _(r):
    return folds.pack_garbage(r.pack_entries)


@add("pack_compaction", """WITH s AS (SELECT pack, sum(CASE WHEN dead THEN framed_len ELSE 0 END) AS d, sum(framed_len) AS b, count(*) FILTER (NOT dead) AS live FROM pack_entries GROUP BY pack),
  m AS (SELECT e.*, d > 0 AND (d * 100 >= b * 50 OR live = 0) AS moves FROM pack_entries e JOIN s ON e.pack = s.pack)
  SELECT CASE WHEN moves THEN concat(pack, '+') ELSE pack END AS pack, chunk, framed_len, pack AS old_pack,
    CASE WHEN moves THEN CAST(coalesce(sum(framed_len) OVER (PARTITION BY pack ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END AS "offset" FROM m WHERE NOT moves OR NOT dead""")
def _(r):
    return packs.compacted(r.pack_entries)


@add("shard_compaction", """SELECT shard, k, version, status FROM (SELECT CAST(floor(o_orderkey / 64) AS BIGINT) AS shard, CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS version,
  CASE WHEN o_orderkey % 194 = 0 THEN 'gone' WHEN o_orderkey % 97 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders)
  WHERE status <> 'gone' AND shard IN (SELECT CAST(floor(o_orderkey / 64) AS BIGINT) FROM orders WHERE o_orderkey % 97 = 0)""")
def _(r):
    k = F.col("o_orderkey").cast("long")
    base = r.orders.select(k.alias("k"), F.lit(0).alias("version"), F.col("o_orderstatus").alias("status"))
    delta = r.orders.where(k % 97 == 0).select(k.alias("k"), F.lit(1).alias("version"), F.when(k % 194 == 0, "gone").otherwise("new").alias("status"))
    return packs.rewritten_shards(base, delta, ["k"], ["version"], F.floor(F.col("k") / 64).cast("long"), F.col("status") == "gone")


@add("run_carry", """SELECT CASE WHEN run < 8 THEN 3 WHEN run < 10 THEN 1 ELSE 0 END AS level, user_id, max(run) AS run, arg_max(event_id, run * 1000000000 + event_id) AS event_id
  FROM (SELECT CAST(event_id % 11 AS BIGINT) AS run, user_id, event_id FROM events) GROUP BY 1, 2""")
def _(r):
    runs = r.events.select((F.col("event_id") % 11).cast("long").alias("run"), "user_id", "event_id")
    return packs.carried_runs(runs, ["user_id"], ["run", "event_id"])


@add("run_compaction_levels", "SELECT n, length(regexp_extract(bin(n), '1*$')) AS merged FROM (SELECT CAST(p_partkey AS BIGINT) AS n FROM part)")
def _(r):
    n = F.col("p_partkey").cast("long")
    return r.part.select(n.alias("n"), folds.compaction_level(n).cast("long").alias("merged"))


@add("lru_root", "SELECT r.name, p.last_use FROM roots r JOIN policy p ON r.name = p.name WHERE retention = 'evictable' ORDER BY last_use, r.name LIMIT 1")
def _(r):
    return r.roots.join(r.policy.where("retention = 'evictable'"), "name").orderBy("last_use", "name").limit(1).select("name", "last_use")


@add("max_pin_generation", "SELECT max(generation) AS generation FROM pins WHERE scope = 'snapshot'")
def _(r):
    return r.pins.where("scope = 'snapshot'").agg(F.max("generation").alias("generation"))


@add("dedup_statistics", "SELECT count(*) AS chunks, count(DISTINCT chunk) AS stored, CAST(sum(size) AS BIGINT) AS bytes, (SELECT CAST(sum(raw_len) AS BIGINT) FROM pack_entries) AS stored_bytes FROM manifest")
def _(r):
    per = r.manifest.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("one"))
    return per.agg(F.sum("n").alias("chunks"), F.count("*").alias("stored"), F.sum("b").alias("bytes"), F.sum("one").alias("stored_bytes"))


@add("multi_hash_measure", "SELECT payload, max(size) AS size, md5(string_agg(bytes, '' ORDER BY seq)) AS md5, sha1(string_agg(bytes, '' ORDER BY seq)) AS sha1 FROM manifest GROUP BY payload")
def _(r):
    sizes = r.manifest.groupBy("payload").agg(F.max("size").alias("size"))
    return folds.reassemble(r.manifest).join(sizes, "payload").select("payload", "size", F.md5("bytes").alias("md5"), F.sha1("bytes").alias("sha1"))


@add("canonical_order", "SELECT namespace, native_id, row_number() OVER (ORDER BY namespace, native_id) AS n FROM objects")
def _(r):
    return folds.numbered(r.objects.select("namespace", "native_id"), ["namespace", "native_id"], "n")


@add("keyset_page", "SELECT native_id, payload FROM objects WHERE native_id > '80' ORDER BY native_id LIMIT 256")
def _(r):
    return r.objects.where("native_id > '80'").orderBy("native_id").limit(256).select("native_id", "payload")


_PACKED = "(SELECT o.namespace, o.native_id, o.payload, m.pack FROM objects o LEFT JOIN (SELECT payload, min(pack) AS pack FROM manifest JOIN pack_entries USING (chunk) WHERE seq = 0 GROUP BY payload) m ON o.payload = m.payload)"


@add("physical_read_order", f"""SELECT native_id, pack, w AS "window", row_number() OVER (PARTITION BY w ORDER BY pack IS NULL, pack, payload, namespace, native_id) AS place
  FROM (SELECT *, CAST(floor((row_number() OVER (ORDER BY namespace, native_id) - 1) / 4096) AS BIGINT) AS w FROM {_PACKED})""")
def _(r):
    first = r.manifest.where("seq = 0").join(r.pack_entries, "chunk").groupBy("payload").agg(F.min("pack").alias("pack"))
    rows = r.objects.select("namespace", "native_id", "payload").join(first, "payload", "left")
    physical = [F.col("pack").asc_nulls_last(), "payload", "namespace", "native_id"]
    return folds.read_windows(rows, ["namespace", "native_id"], physical, 4096).select("native_id", "pack", "window", "place")


@add("chunk_offsets", "SELECT payload, seq, CAST(coalesce(sum(size) OVER (PARTITION BY payload ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM manifest")
def _(r):
    return folds.offsets(r.manifest).select("payload", "seq", "offset")


@add("covering_chunks", """SELECT payload, seq, chunk FROM (SELECT *, sum(size) OVER (PARTITION BY payload ORDER BY seq) - size AS o, sum(size) OVER (PARTITION BY payload) AS total FROM manifest)
  WHERE total >= 1000 + 700 AND o < 1700 AND o + size > 1000""")
def _(r):
    return folds.covering(r.manifest, 1000, 700).select("payload", "seq", "chunk")


@add("canonical_violations", "SELECT src, dst FROM (SELECT *, lag(dst) OVER (PARTITION BY src ORDER BY ordinal) AS b FROM links) WHERE b >= dst")
def _(r):
    return folds.canonical_violations(r.links).select("src", "dst")


# ---- reachability --------------------------------------------------------------------------------------------------


@add("closure_of_root", f"WITH RECURSIVE c AS (SELECT '{region(0)}' AS native_id UNION SELECT links.dst FROM c JOIN links ON links.src = c.native_id) SELECT native_id FROM c")
def _(r):
    return graph.closure(r.links, r.objects.where(F.col("native_id") == region(0))).select("native_id")


_STATUS = """WITH RECURSIVE w AS (SELECT name, native_id FROM roots WHERE name LIKE 'regions/%' UNION SELECT w.name, links.dst FROM w JOIN links ON links.src = w.native_id)
  SELECT w.name, CASE WHEN count(*) = count(o.native_id) THEN 'Complete' ELSE 'Missing' END AS status, count(o.native_id) AS objects, count(*) - count(o.native_id) AS missing FROM w LEFT JOIN {} o ON w.native_id = o.native_id GROUP BY w.name"""


@add("closure_status", _STATUS.format("objects"))
def _(r):
    return graph.closure_status(tree(r.objects), r.links, region_roots(r)).select("name", "status", "objects", "missing")


@add("closure_status_incomplete", _STATUS.format("dst_objects"))
def _(r):
    return graph.closure_status(tree(r.dst_objects), r.links, region_roots(r)).select("name", "status", "objects", "missing")


@add("closure_of_many_roots", f"WITH RECURSIVE {REACH} SELECT native_id FROM reach")
def _(r):
    return graph.closure(r.links, r.roots).select("native_id")


_SETTLED = "(SELECT native_id FROM objects WHERE validated OR namespace = 'blob.v1')"


@add("closure_incremental", f"WITH RECURSIVE c AS (SELECT native_id FROM roots UNION SELECT links.dst FROM c JOIN links ON links.src = c.native_id WHERE c.native_id NOT IN {_SETTLED}) SELECT native_id FROM c")
def _(r):
    return graph.closure(r.links, r.roots, stop=r.objects.where("validated OR namespace = 'blob.v1'")).select("native_id")


@add("closure_proven_reuse", "WITH RECURSIVE c AS (SELECT native_id FROM roots UNION SELECT links.dst FROM c JOIN links ON links.src = c.native_id WHERE c.native_id NOT IN (SELECT native_id FROM objects WHERE validated OR (kind = 'nation' AND k % 2 = 0))) SELECT native_id FROM c")
def _(r):
    return graph.closure(r.links, r.roots, stop=r.objects.where("validated OR (kind = 'nation' AND k % 2 = 0)")).select("native_id")


@add("gc_mark", f"WITH RECURSIVE {MARK} SELECT native_id FROM marked")
def _(r):
    return collect.marked(r.objects, r.links, r.roots, r.pins)


@add("tree_walk", """WITH RECURSIVE w AS (SELECT r.name AS root, e.name AS path, kind, digest FROM entries e JOIN roots r ON e.dir = r.native_id
  UNION ALL SELECT w.root, concat(w.path, '/', e.name), e.kind, e.digest FROM w JOIN entries e ON w.digest = e.dir WHERE w.kind = 'd') SELECT root, path, kind, digest FROM w""")
def _(r):
    return graph.tree_paths(r.entries, r.roots.select(F.col("name").alias("root"), "native_id")).select("root", "path", "kind", "digest")


@add("commit_closed_set", """WITH have AS (SELECT native_id FROM dst_objects UNION SELECT native_id FROM objects WHERE k % 2 = 0)
  SELECT l.src AS from_id, l.dst AS missing FROM links l JOIN (SELECT native_id FROM objects WHERE k % 2 = 0) s ON l.src = s.native_id WHERE l.dst NOT IN (SELECT native_id FROM have)""")
def _(r):
    staged = r.objects.where("k % 2 = 0")
    have = sync.overlay(staged.select("native_id"), r.dst_objects.select("native_id"), ["native_id"])
    edges = r.links.join(staged.select(F.col("native_id").alias("src")), "src", "left_semi")
    return edges.join(have, edges["dst"] == have["native_id"], "left_anti").select(F.col("src").alias("from_id"), F.col("dst").alias("missing"))


# histories of twenty commits, with merges
_ORDERS_LINKS = "(SELECT o_orderkey AS src, o_orderkey - 1 AS dst FROM orders WHERE o_orderkey % 20 <> 1 UNION ALL SELECT o_orderkey, o_orderkey - 2 FROM orders WHERE o_orderkey % 5 = 0)"
_TIPS = "(SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT dst FROM e))"


def commit_graph(r: Repo) -> DataFrame:
    k = F.col("o_orderkey")
    return r.orders.where("o_orderkey % 20 != 1").select(k.alias("src"), (k - 1).alias("dst")).unionAll(r.orders.where("o_orderkey % 5 = 0").select(k.alias("src"), (k - 2).alias("dst")))


def tips(r: Repo) -> DataFrame:
    """The commits that no commit has as a parent."""
    ids = r.orders.select(F.col("o_orderkey").alias("native_id"))
    return ids.join(commit_graph(r).select(F.col("dst").alias("native_id")), "native_id", "left_anti")


@add("git_fetch_depth", f"""WITH RECURSIVE e AS (SELECT * FROM {_ORDERS_LINKS}), w AS (SELECT id, 0 AS depth FROM {_TIPS} UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id WHERE depth < 6)
  SELECT id AS native_id, min(depth) AS depth FROM w GROUP BY id""")
def _(r):
    return graph.fetch_selection(commit_graph(r), tips(r), tips(r).where("false"), 6).select("native_id", "depth")


@add("git_fetch_have", f"""WITH RECURSIVE e AS (SELECT * FROM {_ORDERS_LINKS}), h AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION SELECT e.dst FROM h JOIN e ON e.src = h.id),
  w AS (SELECT id FROM {_TIPS} UNION SELECT e.dst FROM w JOIN e ON e.src = w.id WHERE w.id NOT IN (SELECT id FROM h)) SELECT id AS native_id FROM w WHERE id NOT IN (SELECT id FROM h)""")
def _(r):
    have = r.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("native_id"))
    return graph.fetch_selection(commit_graph(r), tips(r), have).select("native_id")


@add("transfer_recursive_upgrade", """SELECT native_id, recursive FROM (SELECT native_id, max(CASE WHEN source IS NULL THEN 0 ELSE 1 END) = 1 AS recursive
    FROM (SELECT NULL AS source, native_id FROM roots UNION ALL SELECT NULL, digest FROM entries UNION ALL SELECT src, dst FROM links WHERE src IN (SELECT native_id FROM dst_objects)) GROUP BY 1) q
  WHERE native_id NOT IN (SELECT native_id FROM dst_objects WHERE validated) AND (recursive OR native_id NOT IN (SELECT native_id FROM dst_objects))""")
def _(r):
    named = r.roots.select("native_id").unionAll(r.entries.select("digest")).select(F.lit(None).cast("string").alias("source"), "native_id")
    linked = r.links.join(r.dst_objects, r.links["src"] == r.dst_objects["native_id"], "left_semi").select(F.col("src").alias("source"), F.col("dst").alias("native_id"))
    return sync.discovery(named.unionByName(linked), r.dst_objects.where("validated"), r.dst_objects.where("NOT validated"))


@add("hardlink_fix_point", """WITH RECURSIVE f AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_partkey - 1 END AS target FROM part WHERE p_partkey >= 8),
  w AS (SELECT path, path AS last, target FROM f UNION ALL SELECT w.path, f.path, f.target FROM w JOIN f ON w.target = f.path) SELECT CAST(path AS VARCHAR) AS path, sha256(CAST(last AS VARCHAR)) AS digest FROM w WHERE target IS NULL""")
def _(r):
    k = F.col("p_partkey")
    rows = r.part.where("p_partkey >= 8").select(
        k.cast("string").alias("path"), F.when(k % 8 == 0, "f").otherwise("h").alias("kind"), F.when(k % 8 != 0, (k - 1).cast("string")).alias("target"),
        F.lit(1).cast("long").alias("size"), F.when(k % 8 == 0, F.sha2(k.cast("string"), 256)).alias("digest"),
    )
    return archives.resolve_hardlinks(rows).select("path", "digest")


@add("retained_by", "WITH RECURSIVE w AS (SELECT name, native_id FROM roots UNION SELECT w.name, links.dst FROM w JOIN links ON links.src = w.native_id) SELECT native_id, count(*) AS roots, min(name) AS least FROM w GROUP BY native_id")
def _(r):
    return graph.retained_by(r.links, r.roots)


@add("traversal_order", f"SELECT 0 AS depth, CAST(0 AS BIGINT) AS ordinal, '{region(0)}' AS native_id UNION ALL SELECT 1, ordinal, dst FROM links WHERE src = '{region(0)}'")
def _(r):
    start = r.objects.where(F.col("native_id") == region(0)).select("native_id")
    walked = graph.closure(r.links, start, depth=1)
    order = r.links.where(F.col("src") == region(0)).select(F.col("dst").alias("native_id"), "ordinal")
    return walked.join(order, "native_id", "left").select("depth", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "native_id").orderBy("depth", "ordinal")


@add("git_view_inventory", f"""WITH RECURSIVE {REACH}, inv AS (SELECT native_id FROM objects WHERE k % 9 <> 0)
  SELECT 'NotListed' AS kind, native_id FROM reach WHERE native_id NOT IN (SELECT native_id FROM inv) UNION ALL SELECT 'NotReached', native_id FROM inv WHERE native_id NOT IN (SELECT native_id FROM reach)""")
def _(r):
    return git.inventory_errors(graph.closure(r.links, r.roots), r.objects.where("k % 9 != 0").select("native_id"))


# ---- collection, checks, commits -----------------------------------------------------------------------------------

_PLAN = f"""{MARK}, live AS (SELECT payload FROM objects WHERE native_id IN (SELECT native_id FROM marked) UNION SELECT payload FROM objects WHERE kind = 'doc' AND k % 50 = 0),
  live_chunks AS (SELECT chunk FROM manifest WHERE payload IN (SELECT payload FROM live))"""


def gc(r: Repo) -> dict[str, DataFrame]:
    r.settle("manifest")
    return collect.gc_plan(r.objects, collect.marked(r.objects, r.links, r.roots, r.pins), r.manifest, r.objects.where("kind = 'doc' AND k % 50 = 0"))


@add("gc_preview", f"""WITH RECURSIVE {_PLAN} SELECT (SELECT count(*) FROM objects WHERE native_id NOT IN (SELECT native_id FROM marked)) AS objects,
  (SELECT count(DISTINCT payload) FROM objects WHERE payload NOT IN (SELECT payload FROM live)) AS payloads, (SELECT count(DISTINCT chunk) FROM manifest WHERE chunk NOT IN (SELECT chunk FROM live_chunks)) AS chunks""")
def _(r):
    return collect.gc_preview(gc(r))


@add("gc_plan", f"""WITH RECURSIVE {_PLAN} SELECT 'object' AS what, native_id AS id FROM objects WHERE native_id NOT IN (SELECT native_id FROM marked)
  UNION ALL SELECT DISTINCT 'payload', payload FROM objects WHERE payload NOT IN (SELECT payload FROM live) UNION ALL SELECT DISTINCT 'chunk', chunk FROM manifest WHERE chunk NOT IN (SELECT chunk FROM live_chunks)""")
def _(r):
    plan = gc(r)
    what = lambda rows, name, key: rows.select(F.lit(name).alias("what"), F.col(key).alias("id"))
    return what(plan["objects"], "object", "native_id").unionByName(what(plan["payloads"], "payload", "payload")).unionByName(what(plan["chunks"], "chunk", "chunk"))


@add("gc_missing_rooted", f"WITH RECURSIVE {REACH} SELECT native_id FROM reach WHERE native_id NOT IN (SELECT native_id FROM dst_objects)")
def _(r):
    return collect.missing_under(r.dst_objects, r.links, r.roots)


@add("retained_set_checks", """SELECT 'OmittedRoot' AS kind, native_id FROM (SELECT DISTINCT native_id FROM roots) WHERE native_id NOT IN (SELECT native_id FROM dst_objects)
  UNION ALL SELECT 'DanglingLink', dst FROM (SELECT DISTINCT dst FROM links WHERE src IN (SELECT native_id FROM dst_objects)) WHERE dst NOT IN (SELECT native_id FROM dst_objects)
  UNION ALL SELECT 'UnknownKey', native_id FROM dst_objects WHERE native_id NOT IN (SELECT native_id FROM objects WHERE k % 13 <> 0)""")
def _(r):
    return collect.retained_errors(r.objects.where("k % 13 != 0"), r.links, r.roots, r.dst_objects)


@add("collect_install", f"WITH RECURSIVE {MARK} SELECT native_id, payload FROM objects WHERE native_id IN (SELECT native_id FROM marked)")
def _(r):
    return collect.marked(r.objects, r.links, r.roots, r.pins, ["payload"])


# what is stored for each chunk is hashed again, and a payload is as bad as the worst of its chunks
_HASHED = """status AS (SELECT m.payload, CASE max(CASE WHEN f.chunk IS NOT NULL THEN 3 WHEN s.chunk IS NULL THEN 2 WHEN SHA(s.bytes) <> m.chunk OR BLEN(s.bytes) <> m.size THEN 1 ELSE 0 END)
  WHEN 3 THEN 'Unavailable' WHEN 2 THEN 'Missing' WHEN 1 THEN 'Corrupt' ELSE 'Healthy' END AS status
  FROM manifest m LEFT JOIN stored_chunks s ON m.chunk = s.chunk LEFT JOIN offline f ON m.chunk = f.chunk GROUP BY m.payload)"""


def stored(r: Repo) -> DataFrame:
    return collect.stored_status(r.manifest, r.stored_chunks, r.offline)


def replica(r: Repo) -> DataFrame:
    return collect.stored_status(r.manifest, r.replica_chunks)


_FSCK = f"""WITH RECURSIVE {REACH}, o AS (SELECT *, CASE WHEN native_id IN (SELECT native_id FROM reach) THEN 'Corrupt' ELSE 'Collectible' END AS d FROM dst_objects), {_HASHED},
  there AS (SELECT DISTINCT payload FROM objects WHERE k % 11 <> 0), f AS (
  SELECT 'MissingRecord' AS kind, 'Corrupt' AS disposition, native_id AS id FROM reach WHERE native_id NOT IN (SELECT native_id FROM o)
  UNION ALL SELECT 'MissingRecord', 'Collectible', dst FROM (SELECT DISTINCT dst FROM links WHERE src IN (SELECT native_id FROM o WHERE d = 'Collectible')) WHERE dst NOT IN (SELECT native_id FROM o) AND dst NOT IN (SELECT native_id FROM reach)
  UNION ALL SELECT 'UnrootedObject', 'Collectible', native_id FROM o WHERE d = 'Collectible'
  UNION ALL SELECT 'UnsupportedNamespace', 'Unchecked', native_id FROM o WHERE namespace = 'doc.v1'
  UNION ALL SELECT 'MissingPayload', d, native_id FROM o WHERE payload NOT IN (SELECT payload FROM there)
  UNION ALL SELECT 'InvalidObject', d, native_id FROM o WHERE payload IN (SELECT payload FROM status WHERE status = 'Corrupt')
  UNION ALL SELECT 'StateEncoding', 'Corrupt', name FROM root_states WHERE NOT coalesce(regexp_matches(state, '^r1 [0-9a-f]{{64}} [0-9a-f]{{8}}$') AND substring(SHA(substring(state, 4, 64)), 1, 8) = substring(state, 69, 8), false)
  UNION ALL SELECT 'UnreferencedPayload', 'Collectible', payload FROM there WHERE payload NOT IN (SELECT payload FROM o)
  UNION ALL SELECT 'UnreferencedChunk', 'Collectible', chunk FROM pack_entries WHERE chunk NOT IN (SELECT chunk FROM manifest WHERE payload IN (SELECT payload FROM o)))"""


def audit(r: Repo) -> DataFrame:
    read = stored(r)
    r.settle("pack_entries", "manifest")
    return collect.fsck(r.dst_objects, r.links, r.roots, r.objects.where("k % 11 != 0").select("payload"), r.manifest, r.pack_entries, NAMESPACES, read, r.root_states)


@add("fsck_findings", f"{_FSCK} SELECT kind, disposition, id FROM f")
def _(r):
    return audit(r).orderBy("kind", "id")


@add("fsck_health", f"{_FSCK} SELECT count(*) FILTER (WHERE disposition = 'Corrupt') = 0 AS healthy, count(*) = 0 AS clean, count(*) AS findings FROM f")
def _(r):
    return collect.health(audit(r))


@add("format_verify", "SELECT kind, count(*) AS objects, count(*) FILTER (WHERE native_id = SHA(concat(kind, ':', CAST(k AS STRING)))) AS good, namespace IN ('tree.v1', 'blob.v1') AS supported FROM objects GROUP BY kind, namespace")
def _(r):
    again = F.sha2(F.concat("kind", F.lit(":"), F.col("k").cast("string")), 256)
    return r.objects.groupBy("kind", "namespace").agg(F.count("*").alias("objects"), F.count(F.when(F.col("native_id") == again, 1)).alias("good")).select("kind", "objects", "good", F.col("namespace").isin(NAMESPACES).alias("supported"))


@add("stored_status", f"WITH {_HASHED} SELECT payload, status FROM status")
def _(r):
    return stored(r)


_REPAIR = f"""WITH {_HASHED}, other AS (SELECT m.payload, min(CAST(SHA(s.bytes) = m.chunk AND BLEN(s.bytes) = m.size AS INTEGER)) = 1 AS healthy FROM manifest m JOIN replica_chunks s ON m.chunk = s.chunk GROUP BY m.payload),
  plan AS (SELECT s.payload, s.status, CASE WHEN s.status = 'Healthy' THEN 'Count' WHEN s.status <> 'Unavailable' AND o.healthy THEN 'Planned' ELSE 'Finding' END AS action FROM status s LEFT JOIN other o ON s.payload = o.payload)"""


@add("repair_plan", f"{_REPAIR} SELECT payload, status, action FROM plan")
def _(r):
    return collect.repair_plan(stored(r), replica(r))


@add("self_repair", f"{_REPAIR} SELECT payload, status, CASE action WHEN 'Count' THEN 'ReadNear' WHEN 'Planned' THEN CASE WHEN status = 'Missing' THEN 'ReadFar' ELSE 'RepairFromFar' END ELSE 'Error' END AS action FROM plan")
def _(r):
    plan = collect.repair_plan(stored(r), replica(r))
    missing = F.col("status") == "Missing"
    return plan.select("payload", "status", F.when(F.col("action") == "Count", "ReadNear").when((F.col("action") == "Planned") & missing, "ReadFar").when(F.col("action") == "Planned", "RepairFromFar").otherwise("Error").alias("action"))


@add("commit_objects", """SELECT a.native_id, CASE WHEN b.native_id IS NULL THEN 'Insert' WHEN b.payload = a.payload THEN 'NoOp' ELSE 'ImmutableConflict' END AS outcome
  FROM (SELECT native_id, CASE WHEN k % 25 = 0 THEN SHA(payload) ELSE payload END AS payload FROM objects WHERE k % 2 = 0) a LEFT JOIN dst_objects b ON a.native_id = b.native_id""")
def _(r):
    staged = r.objects.where("k % 2 = 0").select("native_id", F.when(F.col("k") % 25 == 0, F.sha2("payload", 256)).otherwise(F.col("payload")).alias("payload"))
    return sync.commit_objects(staged, r.dst_objects)


def checks(r: Repo) -> DataFrame:
    """What a caller thinks the roots are: true but for absent names, and stale ones."""
    rows = folds.numbered(r.roots, ["name"], "index")
    return rows.select("index", "name", F.when(F.col("index") % 4 == 0, F.lit(None)).otherwise(F.col("native_id")).alias("expected"))


_CHECKS = "(SELECT n AS index, name, CASE WHEN n % 4 = 0 THEN NULL ELSE native_id END AS expected FROM (SELECT *, row_number() OVER (ORDER BY name) AS n FROM roots))"


@add("commit_checks", f"SELECT CAST(min(CASE WHEN c.expected IS DISTINCT FROM d.native_id THEN c.index END) AS INTEGER) AS failed FROM {_CHECKS} c LEFT JOIN dst_roots d ON c.name = d.name")
def _(r):
    return sync.failed_check(checks(r), r.dst_roots, "name", "native_id")


@add("conditional_root_set", f"SELECT c.name, c.expected IS NOT DISTINCT FROM d.native_id AS applied FROM {_CHECKS} c LEFT JOIN dst_roots d ON c.name = d.name")
def _(r):
    now = r.dst_roots.select("name", F.col("native_id").alias("now"))
    return checks(r).join(now, "name", "left").select("name", F.col("expected").eqNullSafe(F.col("now")).alias("applied"))


@add("root_remove_prefix", "SELECT name FROM roots WHERE NOT (name = 'lang/de' OR name LIKE 'lang/de/%')")
def _(r):
    return r.roots.where(~scans.under(F.col("name"), "lang/de")).select("name")


@add("root_remove_if_target", "SELECT r.name FROM roots r WHERE NOT EXISTS (SELECT 1 FROM dst_roots d WHERE d.name = r.name AND d.native_id = r.native_id)")
def _(r):
    return r.roots.join(r.dst_roots, ["name", "native_id"], "left_anti").select("name")


@add("root_retention_touch", "SELECT name, max(last_use) AS last_use FROM (SELECT name, last_use FROM policy UNION ALL SELECT name, BLEN(name) * 50 FROM policy WHERE retention = 'evictable') GROUP BY name")
def _(r):
    touch = r.policy.where("retention = 'evictable'").select("name", (F.octet_length("name") * 50).cast("long").alias("last_use"))
    return r.policy.select("name", "last_use").unionByName(touch).groupBy("name").agg(F.max("last_use").alias("last_use"))


@add("evict_roots", """SELECT name, last_use, size, freed_before FROM (SELECT r.name, p.last_use, o.payload_size AS size, CAST(coalesce(sum(o.payload_size) OVER (ORDER BY p.last_use, r.name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before
  FROM roots r JOIN policy p ON r.name = p.name AND p.retention = 'evictable' JOIN objects o ON r.native_id = o.native_id) WHERE (90000 - freed_before) * 100 >= 100000 * 75""")
def _(r):
    return collect.eviction(r.roots, r.policy, r.objects.select("native_id", F.col("payload_size").alias("size")), 90_000, 100_000)


@add("pin_conflicts", """SELECT 'SnapshotGeneration' AS kind, token AS id FROM pins WHERE scope = 'snapshot' AND generation > 0
  UNION ALL SELECT DISTINCT 'UnmarkedRoot', native_id FROM roots WHERE native_id IN (SELECT native_id FROM objects) AND native_id NOT IN (SELECT native_id FROM dst_objects)""")
def _(r):
    return sync.pin_conflicts(r.pins.withColumn("scope", F.col("scope")), 0, r.roots, r.dst_objects.select("native_id"), r.objects.select("native_id"))


def doc_bytes(r: Repo) -> DataFrame:
    return r.documents.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("bytes"))


@add("overwrite_payload", "SELECT doc_id, sha256(unhex(concat(substring(h, 1, 20), hex(encode('PATCHED')), substring(h, 35)))) AS payload FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= 17)")
def _(r):
    rows = doc_bytes(r).where(F.octet_length("bytes") >= 17)
    return rows.select("doc_id", F.sha2(text.patched(F.col("bytes"), 10, F.lit(b"PATCHED")), 256).alias("payload"))


@add("stage_alias", "SELECT SHA(concat('alias:', native_id)) AS native_id, payload, payload_size FROM objects")
def _(r):
    return r.objects.select(F.sha2(F.concat(F.lit("alias:"), F.col("native_id")), 256).alias("native_id"), "payload", "payload_size")


@add("publish_variants", """SELECT native_id, min(namespace) AS namespace, count(*) FILTER (WHERE rooted) AS roots FROM (SELECT o.native_id, o.namespace, r.name IS NOT NULL AS rooted FROM objects o LEFT JOIN roots r ON o.native_id = r.native_id) GROUP BY native_id""")
def _(r):
    named = r.roots.groupBy("native_id").agg(F.count("*").alias("n"))
    return r.objects.join(named, "native_id", "left").select("native_id", "namespace", F.coalesce("n", F.lit(0)).alias("roots"))


_PIN_OPS = """(SELECT user_id AS token, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'claim' ELSE 'release' END AS op,
  CASE WHEN event_id % 4 = 0 THEN event_id % 3 END AS expected FROM events)"""


@add("pin_ledger", f"""WITH RECURSIVE o AS (SELECT * FROM {_PIN_OPS}), l AS (SELECT DISTINCT token, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS revision, 'free' AS state, CAST(0 AS BIGINT) AS refused FROM o
  UNION ALL SELECT token, seq, revision + CAST(ok AS BIGINT), CASE WHEN NOT ok THEN state WHEN op = 'add' THEN 'held' WHEN op = 'claim' THEN 'claimed' ELSE 'free' END, refused + 1 - CAST(ok AS BIGINT)
  FROM (SELECT l.token, o.seq, l.revision, l.state, l.refused, o.op, coalesce(o.expected = l.revision, true) AND CASE o.op WHEN 'add' THEN l.state = 'free' WHEN 'claim' THEN l.state = 'held' ELSE l.state <> 'free' END AS ok
        FROM l JOIN o ON o.token = l.token AND o.seq = l.seq + 1)), n AS (SELECT token, max(seq) AS seq FROM o GROUP BY token)
  SELECT l.token, l.revision, l.state, l.refused FROM l JOIN n USING (token, seq)""")
def _(r):
    id_ = F.col("event_id")
    op = F.when(id_ % 3 == 0, "add").when(id_ % 3 == 1, "claim").otherwise("release")
    ops = r.events.select(F.col("user_id").alias("token"), F.struct("ts", "event_id").alias("at"), op.alias("op"), F.when(id_ % 4 == 0, id_ % 3).alias("expected"))
    return pins.ledger(ops)


@add("archive_root_policy", "SELECT r.name, CASE WHEN d.name IS NULL THEN 'Insert' WHEN d.native_id = r.native_id THEN 'Same' ELSE 'Conflict' END AS absent_policy, d.name IS NULL OR d.native_id = r.native_id AS replace_ok FROM roots r LEFT JOIN dst_roots d ON r.name = d.name")
def _(r):
    there = r.dst_roots.select("name", F.col("native_id").alias("now"))
    joined = r.roots.join(there, "name", "left")
    same = F.col("now") == F.col("native_id")
    return joined.select("name", F.when(F.col("now").isNull(), "Insert").when(same, "Same").otherwise("Conflict").alias("absent_policy"), (F.col("now").isNull() | same).alias("replace_ok"))


@add("log_gc", "SELECT DISTINCT substring(chunk, 1, 4) AS log FROM pack_entries WHERE substring(chunk, 1, 4) NOT IN (SELECT substring(chunk, 1, 4) FROM manifest WHERE payload IN (SELECT payload FROM dst_objects))")
def _(r):
    used = r.manifest.join(r.dst_objects, "payload", "left_semi").select(F.substring("chunk", 1, 4).alias("log")).distinct()
    return r.pack_entries.select(F.substring("chunk", 1, 4).alias("log")).distinct().join(used, "log", "left_anti")


# ---- dedup, ranges, transfers --------------------------------------------------------------------------------------


@add("chunk_content_defined")
def _(r):
    return hashing.chunk_payloads(r.pages.select(F.sha2("html", 256).alias("payload"), F.col("html").cast("binary").alias("bytes")), 4096).drop("bytes")


@add("chunk_dedup", "SELECT chunk, count(*) AS uses, max(size) AS size FROM manifest WHERE chunk NOT IN (SELECT chunk FROM pack_entries WHERE dead) GROUP BY chunk")
def _(r):
    new = r.manifest.groupBy("chunk").agg(F.count("*").alias("uses"), F.max("size").alias("size"))
    return new.join(r.pack_entries.where("dead"), "chunk", "left_anti")


@add("payload_dedup", "SELECT sha256(text) AS payload, count(*) AS documents, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def _(r):
    return r.documents.groupBy(F.sha2("text", 256).alias("payload")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


@add("merkle_range_proof")
def _(r):
    return hashing.merkle_root(r.manifest)


@add("verified_range_read", """SELECT payload, seq, sha256(bytes) = chunk AS verified FROM (SELECT *, sum(size) OVER (PARTITION BY payload ORDER BY seq) - size AS o, sum(size) OVER (PARTITION BY payload) AS total FROM manifest)
  WHERE total >= 600 AND o < 600 AND o + size > 100""")
def _(r):
    return folds.covering(r.manifest, 100, 500).select("payload", "seq", (F.sha2("bytes", 256) == F.col("chunk")).alias("verified"))


@add("sliced_delta", """WITH m AS (SELECT * FROM manifest), have AS (SELECT DISTINCT chunk FROM m WHERE payload IN (SELECT payload FROM dst_objects))
  SELECT payload, sum(CASE WHEN have.chunk IS NULL THEN 1 ELSE 0 END)::BIGINT AS literals, sum(CASE WHEN have.chunk IS NULL THEN size ELSE 0 END)::BIGINT AS literal_bytes, count(have.chunk) AS copies FROM m LEFT JOIN have ON m.chunk = have.chunk
  WHERE payload NOT IN (SELECT payload FROM dst_objects) GROUP BY payload""")
def _(r):
    held = r.manifest.join(r.dst_objects, "payload", "left_semi").select("chunk").distinct().withColumn("held", F.lit(True))
    rows = r.manifest.join(r.dst_objects, "payload", "left_anti").join(held, "chunk", "left")
    literal = F.col("held").isNull()
    return rows.groupBy("payload").agg(F.sum(F.when(literal, 1).otherwise(0)).alias("literals"), F.sum(F.when(literal, F.col("size")).otherwise(0)).alias("literal_bytes"), F.count("held").alias("copies"))


_LONG = "(SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) >= 800)"


@add("range_proof_read", f"SELECT doc_id, sha256(unhex(substring(h, 601, 1000))) AS piece FROM {_LONG}")
def _(r):
    made = proofs.range_proofs(doc_bytes(r), "doc_id", 300, 500)
    return proofs.open_proofs(made, "doc_id", 300, 500).select("doc_id", F.sha2("bytes", 256).alias("piece"))


@add("range_proof_overwrite", f"SELECT doc_id, true AS same FROM {_LONG}")
def _(r):
    rows, piece = doc_bytes(r), bytes(500)
    after = proofs.open_proofs(proofs.range_proofs(rows, "doc_id", 300, 500), "doc_id", 300, 500, piece)
    whole = rows.select("doc_id", hashing.blake3_hex(text.patched(F.col("bytes"), 300, F.lit(piece))).alias("want"))
    return after.join(whole, "doc_id").select("doc_id", (F.lower(F.hex("digest_after")) == F.col("want")).alias("same"))


def revisions(r: Repo) -> DataFrame:
    """Documents as old, and as new without their bytes 200 to 249 and with some others there."""
    raw = F.col("bytes")
    new = F.concat(F.substring(raw, 1, 200), F.lit(b"<!-- new -->"), raw.substr(F.lit(251), F.octet_length(raw)))
    return doc_bytes(r).select("doc_id", new.alias("new"), raw.alias("old"))


@add("delta_frames", "SELECT doc_id, sha256(unhex(concat(substring(h, 1, 400), hex(encode('<!-- new -->')), substring(h, 501)))) AS payload FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL)")
def _(r):
    rows = revisions(r)
    frames = deltas.deltas(rows, "doc_id").join(rows.select("doc_id", "old"), "doc_id")
    return deltas.patched_from(frames, "doc_id").select("doc_id", F.sha2("bytes", 256).alias("payload"))


@add("delta_statistics", "SELECT doc_id, 12 + least(strlen(text), 200) + greatest(strlen(text) - 250, 0) AS bytes FROM documents WHERE text IS NOT NULL")
def _(r):
    return deltas.deltas(revisions(r), "doc_id").select("doc_id", (F.col("literal_bytes") + F.col("copy_bytes")).alias("bytes"))


@add("nar_of_blobs", f"""SELECT page_id, 112 + n + (8 - n % 8) % 8 AS nar_size, sha256(unhex(concat('{nar.file_prefix().hex()}', printf('%02x%02x%02x%02x00000000', n % 256, n // 256 % 256, n // 65536 % 256, n // 16777216),
  hex(encode(html)), repeat('00', (8 - n % 8) % 8), '{nar.text(b")").hex()}'))) AS nar_sha256 FROM (SELECT page_id, html, strlen(html) AS n FROM pages WHERE html IS NOT NULL)""")
def _(r):
    made = r.pages.where("html is not null").select("page_id", nar.file_nar(F.col("html")).alias("nar"))
    return made.select("page_id", F.octet_length("nar").cast("long").alias("nar_size"), F.sha2("nar", 256).alias("nar_sha256"))


NEEDLES = ["the", "que", "example.com", "the", "zzzz"]


@add("reference_scan", " UNION ALL ".join(f"SELECT doc_id, {i} AS index FROM documents WHERE contains(text, '{n}')" for i, n in enumerate(NEEDLES)))
def _(r):
    return archives.needles(r.documents, "doc_id", "text", NEEDLES)


@add("association_cache", "SELECT c.blob, max(c.size) AS size, bool_or(s.inode IS NOT NULL) AS current FROM cached c LEFT JOIN seen s ON c.inode = s.inode AND c.mtime = s.mtime GROUP BY c.blob")
def _(r):
    now = r.seen.select("inode", "mtime", F.lit(True).alias("hit"))
    return r.cached.join(now, ["inode", "mtime"], "left").groupBy("blob").agg(F.max("size").alias("size"), F.max(F.coalesce("hit", F.lit(False))).alias("current"))


_TREE = "(SELECT native_id FROM roots WHERE name LIKE 'regions/%')"
_SEND = """SELECT o.native_id, o.payload, o.payload_size, CASE WHEN d.native_id IS NOT NULL THEN 'Reuse' WHEN o.payload IN (SELECT payload FROM dst_objects) THEN 'SendRecord' ELSE 'SendAll' END AS action
  FROM objects o LEFT JOIN dst_objects d ON o.native_id = d.native_id WHERE o.native_id IN (SELECT native_id FROM c)"""


@add("transfer_plan", f"WITH RECURSIVE c AS (SELECT native_id FROM {_TREE} UNION SELECT links.dst FROM c JOIN links ON links.src = c.native_id) {_SEND}")
def _(r):
    return sync.transfer_plan(r.objects, r.links, r.dst_objects, region_roots(r))


@add("transfer_plan_reuse", f"WITH RECURSIVE c AS (SELECT native_id FROM {_TREE} UNION SELECT links.dst FROM c JOIN links ON links.src = c.native_id WHERE c.native_id NOT IN (SELECT native_id FROM dst_objects WHERE validated)) {_SEND}")
def _(r):
    return sync.transfer_plan(r.objects, r.links, r.dst_objects, region_roots(r), reuse=True)


@add("transfer_by_path", """WITH RECURSIVE s AS (SELECT e2.digest AS native_id FROM entries e1 JOIN entries e2 ON e2.dir = e1.digest WHERE e1.dir IN (SELECT native_id FROM roots) AND e2.name LIKE 'customer-1%'),
  c AS (SELECT native_id FROM s UNION SELECT links.dst FROM c JOIN links ON links.src = c.native_id) SELECT native_id FROM c""")
def _(r):
    one = r.entries.join(r.roots.select(F.col("native_id").alias("dir")).distinct(), "dir").select(F.col("digest").alias("dir"))
    two = r.entries.join(one, "dir").where("name LIKE 'customer-1%'").select(F.col("digest").alias("native_id"))
    return graph.closure(r.links, two).select("native_id")


@add("transfer_payload_need", "SELECT DISTINCT payload, payload_size FROM objects WHERE payload NOT IN (SELECT payload FROM dst_objects)")
def _(r):
    return r.objects.select("payload", "payload_size").distinct().join(r.dst_objects, "payload", "left_anti")


@add("transfer_status", """WITH RECURSIVE asked AS (SELECT name, native_id FROM roots UNION ALL SELECT concat('suppliers/', s_name), SHA(concat('supplier:', CAST(s_suppkey AS VARCHAR))) FROM supplier
    UNION ALL SELECT concat('orders/', CAST(o_orderkey AS VARCHAR)), SHA(concat('order:', CAST(o_orderkey AS VARCHAR))) FROM orders),
  w AS (SELECT name, native_id, 0 AS depth FROM asked UNION SELECT w.name, links.dst, depth + 1 FROM w JOIN links ON links.src = w.native_id WHERE w.native_id IN (SELECT native_id FROM dst_objects)),
  f AS (SELECT w.name, min(w.depth * 10 + CASE WHEN d.native_id IS NULL THEN 0 WHEN d.payload < '1' THEN 1 ELSE NULL END) AS f FROM w LEFT JOIN dst_objects d ON w.native_id = d.native_id GROUP BY w.name)
  SELECT name, CASE WHEN f IS NULL THEN 'Complete' WHEN f % 10 = 1 THEN 'Invalid' WHEN f = 0 THEN 'Missing' ELSE 'Incomplete' END AS status FROM f""")
def _(r):
    id_of = lambda kind, k: F.sha2(F.concat(F.lit(f"{kind}:"), F.col(k).cast("string")), 256).alias("native_id")
    suppliers = r.supplier.select(F.concat(F.lit("suppliers/"), "s_name").alias("name"), id_of("supplier", "s_suppkey"))
    orders = r.orders.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("name"), id_of("order", "o_orderkey"))
    asked = r.roots.select("name", "native_id").unionByName(suppliers).unionByName(orders)
    return sync.requested_status(r.dst_objects, r.links, asked, r.payloads.where("payload >= '1'"))


@add("slice_bases", "SELECT r.name, r.native_id, d.native_id AS base FROM roots r JOIN dst_roots d ON r.name = d.name WHERE r.native_id <> d.native_id")
def _(r):
    return sync.slice_bases(r.roots, r.dst_roots)


@add("transfer_batches")
def _(r):
    return sync.batches(tree(r.objects).select("namespace", "native_id", "payload_size"), "namespace", "native_id", "payload_size", 4096, 256)


@add("path_proof", """WITH RECURSIVE w AS (SELECT r.name AS root, e.name AS path, kind, digest, 1 AS depth, concat(r.native_id, ',', digest) AS spine FROM entries e JOIN roots r ON e.dir = r.native_id
  UNION ALL SELECT w.root, concat(w.path, '/', e.name), e.kind, e.digest, depth + 1, concat(spine, ',', e.digest) FROM w JOIN entries e ON w.digest = e.dir WHERE w.kind = 'd')
  SELECT root, path, depth, sha256(spine) AS spine FROM w""")
def _(r):
    spines = graph.path_spines(r.entries, r.roots.select(F.col("name").alias("root"), "native_id"))
    return spines.select("root", "path", "depth", F.sha2(F.array_join("spine", ","), 256).alias("spine"))


@add("transfer_hold_scope", "SELECT native_id FROM roots WHERE name LIKE 'regions/%' UNION SELECT native_id FROM objects WHERE created_generation <= 1")
def _(r):
    return region_roots(r).select("native_id").union(scans.created_through(r.objects, 1).select("native_id")).distinct()


@add("selected_size_check", """WITH adds AS (SELECT *, CASE WHEN kind = 'd' THEN 1 + size ELSE 1 END AS n FROM entries), told AS (SELECT dir AS id, sum(n) AS size FROM adds GROUP BY 1),
  got AS (SELECT dir AS id, sum(n) AS size FROM adds WHERE digest IN (SELECT native_id FROM dst_objects) GROUP BY 1),
  sized AS (SELECT e.dir, e.name, CAST(CASE WHEN e.kind = 'd' THEN coalesce(told.size, 0) ELSE e.size END AS BIGINT) AS advertised,
    CAST(CASE WHEN d.native_id IS NULL THEN NULL WHEN e.kind = 'd' THEN coalesce(got.size, 0) ELSE d.payload_size END AS BIGINT) AS selected
    FROM entries e LEFT JOIN told ON e.digest = told.id LEFT JOIN got ON e.digest = got.id LEFT JOIN dst_objects d ON e.digest = d.native_id WHERE e.kind <> 'l')
  SELECT *, CASE WHEN selected IS NULL THEN 'IncompleteSource' WHEN selected = advertised THEN 'Ok' ELSE 'WrongSize' END AS status FROM sized""")
def _(r):
    told = r.entries.groupBy(F.col("dir").alias("id")).agg(F.sum(folds.contribution(F.col("kind"), F.col("size"))).alias("told"))
    advertised = F.when(F.col("kind") == "d", F.coalesce("told", F.lit(0))).otherwise(F.col("size")).cast("long")
    entries = r.entries.join(told, F.col("digest") == F.col("id"), "left").select("dir", "name", "kind", "digest", advertised.alias("advertised"))
    received = r.entries.join(r.dst_objects.select(F.col("native_id").alias("digest")), "digest", "left_semi")
    return sync.selected_sizes(entries, r.dst_objects, received)
