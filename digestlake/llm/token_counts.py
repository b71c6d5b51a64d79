"""Token counts from pre-token frequencies.

A scan cuts texts into the tokenizer's own pre-tokens and counts them per document. Each block of documents sends its
distinct pre-tokens, packed by bucket of their hash; where the rows of a bucket arrive the tokenizer counts the pieces
of each distinct pre-token once and answers the blocks with counts in their own order; the blocks join these to their
documents' frequencies and sum. No ids are kept, and a pre-token that every document holds costs a place per block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.llm.blocks import BLOCK_BYTES, block_id, unvarints, varints
from digestlake.llm.common import file_system, partitions, prepared, quoted, released, scratch, slices

TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: the white space of the tokenizer's own pattern (Unicode White_Space).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs between white space, at which pre-tokens always part: a run with the one space before it, or white space.
_RUNS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
# Pre-tokens of a run of characters below U+0250 by the usual byte-level pattern, with letters and numbers spelled out:
# these are the same in every version of Unicode. Other runs are left to the tokenizer itself.
_EARLY = re.compile("[\\x00-\u024f]*")
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_WS}{_LETTER}{_NUMBER}]+|[{_WS}]+")
#: Characters of a run above which its pre-tokens are not remembered, and pre-tokens of which a task remembers counts.
LONG_RUN, MEMO_ITEMS = 64, 500_000
_MEMO: dict = {}


def tokenizer(path: str):
    """The tokenizer at path, loaded once in a Python worker."""
    if path not in _MEMO:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _MEMO.clear()
        _MEMO[path] = t
    return _MEMO[path]


def forget_tokenizers() -> None:
    """Drop the tokenizer that an earlier stage left in a Python worker, with the tokens it remembers."""
    _MEMO.clear()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def specials(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def pre_tokens(run: str, t) -> list[str]:
    """The tokenizer's own pre-tokens of a run, as text."""
    if _EARLY.fullmatch(run):
        return _PARTS.findall(run)
    return [run[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(run)]


def units(text: str, special: re.Pattern | None, t, known: dict[str, list[str]]) -> Counter:
    """Pre-tokens of a text with their counts. Special strings count as pre-tokens of their own.

    known remembers the pre-tokens of runs that the block has met.
    """
    out: Counter = Counter()
    if special is None or not special.search(text):
        runs = Counter(_RUNS.findall(text))
    else:
        runs = Counter()
        for part in special.split(text):
            if special.fullmatch(part):
                out[part] += 1
            else:
                runs.update(_RUNS.findall(part))
    for run, n in runs.items():
        got = known.get(run)
        if got is None:
            got = pre_tokens(run, t)
            if len(run) <= LONG_RUN:
                known[run] = got
        for p in got:
            out[p] += n
    return out


def _scan(path: str, buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        t, names = tokenizer(path), specials(path)
        known: dict[str, list[str]] = {}
        special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        part, number = TaskContext.get().partitionId(), 0
        seen: dict[str, int] = {}
        docs: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            block = block_id(part, number)
            # number the block's pre-tokens bucket by bucket
            pre = list(seen)
            raw = [p.encode() for p in pre]
            to = np.fromiter((zlib.crc32(r) % buckets for r in raw), dtype=np.int64, count=len(raw))
            order = np.argsort(to, kind="stable")
            place = np.empty(len(pre), dtype=np.int64)
            place[order] = np.arange(len(pre))
            rows = []
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            for k in range(buckets):
                if cuts[k] < cuts[k + 1]:
                    rows.append(("items", block, k, None, None, "\0".join([pre[i].replace("\\", "\\\\").replace("\0", "\\0") for i in order[cuts[k] : cuts[k + 1]]]).encode(), None))
            for doc_id, n_bytes, at, n in docs:
                p = place[at]
                o = np.argsort(p)
                rows.append(("docs", block, -1, doc_id, n_bytes, varints(np.diff(p[o], prepend=0)), varints(n[o])))
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows[i : i + 2000], columns=["kind", "block", "bucket", "doc_id", "n_bytes", "a", "b"]).astype({"doc_id": "Int64", "n_bytes": "Int64"}), schema=arrow, preserve_index=False)

        arrow = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
        for batch in batches:
            for doc_id, text in ((i, x) for first, many in slices(batch.column(1)) for i, x in zip(batch.column(0).slice(first, many).to_pylist(), batch.column(1).slice(first, many).to_pylist())):
                text = text or ""
                counts = units(text, special, t, known)
                at = np.fromiter((seen.setdefault(u, len(seen)) for u in counts), dtype=np.int64, count=len(counts))
                docs.append((doc_id, n := len(text.encode()), at, np.fromiter(counts.values(), dtype=np.int64, count=len(counts))))
                size += n + 64
                if size >= block_bytes:
                    yield from flush()
                    number, seen, docs, size = number + 1, {}, [], 0
                    known.clear()
        if docs:
            yield from flush()
        seen, docs = {}, []
        known.clear()
        released()

    return run


def _count(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows of a bucket: each distinct pre-token is counted once, each block gets the counts in its own order.

        Rows pass one by one; what is remembered of them is bounded, and beyond the bound counted anew.
        """
        known: dict[bytes, int] = {}
        t = tokenizer(path)
        for pdf in frames:
            out = []
            for block, bucket, data in zip(pdf["block"], pdf["bucket"], pdf["a"]):
                own = bytes(data).split(b"\0")
                if len(known) > MEMO_ITEMS:
                    known.clear()
                new = list({x for x in own if x not in known})
                for i in range(0, len(new), 20_000):
                    some = new[i : i + 20_000]
                    texts = [x.decode() if b"\\" not in x else _plain(x) for x in some]
                    known.update(zip(some, (len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False))))
                out.append((block, bucket, varints(np.array([known[x] for x in own]))))
            yield pd.DataFrame(out, columns=["block", "bucket", "a"])
        known.clear()
        released()

    return run


def _plain(raw: bytes) -> str:
    return re.sub(r"\\(.)", lambda m: "\0" if m[1] == "0" else m[1], raw.decode())


def _sum(where: str):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.dataset as ds

        pieces = [unvarints(bytes(x)) for x in pdf.sort_values("bucket")["a"]]
        pieces = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        fs, at = file_system(f"{where}/kind=docs/block={key[0]}")
        rows = ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=["doc_id", "n_bytes", "a", "b"])
        n = [int((pieces[np.cumsum(unvarints(a))] * unvarints(b)).sum()) if a else 0 for a, b in zip(rows.column("a").to_pylist(), rows.column("b").to_pylist())]
        return pd.DataFrame({"doc_id": rows.column("doc_id").to_pandas(integer_object_nulls=True).astype("Int64"), "n_bytes": rows.column("n_bytes").to_numpy(), "n_tokens": np.array(n, dtype=np.int64)})

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    n_tokens is what the tokenizer at path gives for the whole text without added special tokens; special strings
    inside a text count as their default says. Null text counts as empty: no bytes, no tokens. Repeated rows give
    repeated rows; an empty table gives an empty result; other columns are not read. The tokenizer must be byte-level
    BPE without normaliser and with the usual byte-level pattern, whose pieces never cross white space.
    """
    spark = prepared(docs)
    buckets = partitions(spark)
    where = scratch(spark, "pretokens")
    schema = "kind string, block long, bucket int, doc_id long, n_bytes long, a binary, b binary"
    rows = docs.select(F.col("doc_id").cast("long"), F.col(quoted(text_col)).alias("text"))
    rows.mapInArrow(_scan(path, buckets, block_bytes), schema).write.option("compression", "zstd").partitionBy("kind", "block").parquet(where)
    stored = spark.read.schema(schema).parquet(where)
    # a block whose documents are all empty has no items, but its documents still need their row
    items = stored.where("kind = 'items'").select("block", "bucket", "a")
    # a block or bucket is few rows and much work: a count that is asked for is not merged into fewer tasks
    tasks = 2 * buckets
    counted = items.repartitionById(buckets, F.col("bucket")).mapInPandas(_count(path), "block long, bucket int, a binary")
    blocks = stored.where("kind = 'docs'").select("block").distinct().select("block", F.lit(-1).alias("bucket"), F.lit(b"").alias("a"))
    answers = counted.unionByName(blocks)
    summed = answers.repartition(tasks, "block").groupBy("block").applyInPandas(_sum(where), "doc_id long, n_bytes long, n_tokens long")
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(TOKENIZER))
