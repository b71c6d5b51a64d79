"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a table bucketed by digest whose files are sorted by digest. New rows are reduced to one row per digest
before anything is shuffled, joined to the index by a sort-merge anti-join on the bucketing key (the index side is not
shuffled; Spark sorts its buckets again, as each append adds a file to a bucket), and the digests that are new are
appended. Texts never leave the scan: rows of 100 bytes move. A table is taken in as batches in order of doc_id.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.llm.common import partitions, quoted, text_of, with_row_keys, without_rows, written

#: Batches that a table is taken in as.
BATCHES = 4
#: Runs of white space that are not already one space; replacing only these gives the same text with fewer matches.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(text_of(text), _RUNS, " ")


def digest(text: str | Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """A digest table that outlives the session: (digest, keep_id, batch), one row per digest ever taken in."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or partitions(spark)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.format("parquet").mode(mode).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def ingest(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Take in (doc_id, digest) rows; return one row per digest of the batch: digest, keep_id, row_id, group_size.

        keep_id is the doc_id of the row that stays: that of an earlier batch if the index knows the digest, else the
        smallest of the batch, nulls last. row_id is null for digests known before, so that no row of the batch stays.
        digests needs a column row_id that tells repeated rows apart. The index remembers which batch brought a digest:
        the same rows again under the same batch name, as in a retry, get the same answer and add nothing.
        """
        name = batch or uuid.uuid4().hex
        first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_id"))
        groups = digests.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
        groups = groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row_id").alias("row_id"), "group_size")
        if not self.spark.catalog.tableExists(self.table):
            self._write(groups.limit(0).select("digest", "keep_id", F.lit(name).alias("batch")), "errorifexists")
        known = self.spark.table(self.table)
        before = known.where(F.col("batch") != name).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
        fresh = groups.join(before.hint("merge"), "digest", "left_anti").withColumns({"known_id": F.lit(None).cast("long"), "known": F.lit(False)})
        old = groups.join(before.hint("merge"), "digest")
        answers = written(fresh.unionByName(old), "digest-answers")
        added = answers.where("not known").select("digest", "keep_id", F.lit(name).alias("batch"))
        self._write(added.join(known.where(F.col("batch") == name).select("digest").hint("merge"), "digest", "left_anti"), "append")
        keep = F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id")
        return answers.select("digest", keep, F.when(~F.col("known"), F.col("row_id")).alias("row_id"), "group_size")

    def compact(self) -> None:
        """Write the table anew with one sorted file per bucket."""
        to = f"{self.table}_{uuid.uuid4().hex}"
        rows = self.spark.table(self.table).repartition(self.buckets, "digest")
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(to)
        self.drop()
        self.spark.sql(f"ALTER TABLE {to} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _decided(rows: DataFrame, index: DigestIndex | None, batch: str | None, batches: int) -> DataFrame:
    """rows (doc_id, digest, row_id, ...), a written table, with keep_id, group_size and kept."""
    own = index or DigestIndex(rows.sparkSession)
    name = batch or uuid.uuid4().hex
    ends = rows.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(ends or []))
    # batches in order of doc_id, nulls with the last, so that the first row of a digest to come is the one that stays
    parts = []
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        inside = F.lit(True) if low is None else F.col("doc_id") > low
        inside = inside & (F.col("doc_id") <= high) if high is not None else inside | F.col("doc_id").isNull()
        parts.append(own.ingest(rows.where(inside), f"{name}/{k}"))
    if index is None:
        own.drop()
    every = reduce(DataFrame.unionByName, parts)
    groups = every.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.max("row_id").alias("keep_row"), F.sum("group_size").alias("group_size"))
    # written, so that the join shuffles both sides anew and a digest with very many rows is split
    out = rows.join(written(groups, "digest-groups"), "digest")
    return out.withColumn("kept", F.coalesce(F.col("row_id") == F.col("keep_row"), F.lit(False)))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, text_col: str = "text", batch: str | None = None, batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the smallest doc_id stays, a null doc_id last; of rows with
    equal doc_id and text exactly one stays. group_size counts the rows of docs. Without an index a fresh one is used
    and dropped. batch names the call for a retry, see ingest. An empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(quoted(text_col)).alias("digest")).withColumn("row_id", F.monotonically_increasing_id())
    out = _decided(written(rows, "digests"), index, batch, batches)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs without the rows that exact_dedup drops; columns as in docs, whatever their names."""
    keyed, file, place = with_row_keys(docs)
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), digest(quoted(text_col)).alias("digest"), F.col(file).alias("f"), F.col(place).alias("p"))
    rows = written(rows.withColumn("row_id", F.monotonically_increasing_id()), "digests")
    dropped = _decided(rows, None, None, batches).where("not kept").select(F.col("f").alias(file), F.col("p").alias(place))
    return without_rows(keyed, file, place, dropped)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
