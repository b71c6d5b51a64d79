"""Packing by minimum bin slack.

The scan tokenizes each text once and keeps, per piece, its length and the CRC of its ids. A text longer than a window
is cut into full windows and one remainder. How many remainders there are of each length is a histogram of at most
4096 counts; on it the driver plans windows: each takes the longest remainder left and the multiset of other lengths
that fills the window closest to capacity, found by subset sums in a bitset (a Python integer) whose steps are kept
and walked back; the multiset is repeated as often as the counts allow. Remainders of a length then take the places
planned for that length in the order of their rank, and ranks come from counts per partition, so no length, however
common, is gathered in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from digestlake.llm.common import prepared, quoted, released, slices, written
from digestlake.llm.token_counts import tokenizer, vocabulary

TOKENIZER = "word_bpe_49k.json"
#: Bytes that the runs of characters between white space and their ids take that a worker remembers; beyond that, and
#: when a scan ends, it forgets and starts anew.
MEMO_BYTES = 64 << 20
#: Characters that Arrow and str.split() take as white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Punctuation that ends a run. After one of _PLAIN it is a pre-token of its own. Other letters may be normalised to a
#: letter and a mark, to which punctuation is joined.
_STOPS = ".,!?;:"
_PLAIN = frozenset(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº" or c in "0123456789")
_JOIN = 400
_memo: dict[str, tuple[dict[str, bytes], np.ndarray]] = {}


def _learn(words: list[str], single: list[str], t, known: dict[str, bytes], last: np.ndarray) -> None:
    """Add the ids of runs to known. Words, of letters alone, are encoded many at a time and told apart by the tokens
    that end a word; a join whose words do not come out one by one is encoded word by word, as single runs are."""
    joins = [words[i : i + _JOIN] for i in range(0, len(words), _JOIN)]
    for own, e in zip(joins, t.encode_batch_fast([" ".join(j) for j in joins], add_special_tokens=False)):
        ids = np.array(e.ids, dtype="<u4")
        ends = ((np.nonzero(last[ids])[0] + 1) * 4).tolist()
        if len(ends) != len(own):
            single = single + own
            continue
        known.update(zip(own, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))))
    for i in range(0, len(single), 20_000):
        some = single[i : i + 20_000]
        known.update(zip(some, (np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch_fast(some, add_special_tokens=False))))


def _lowered(text: str) -> str:
    """Lower case where that is the tokenizer's own and changes nothing else, so that fewer runs differ."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


def encoded(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, as the tokenizer gives them without added tokens.

    The pre-tokens of this vocabulary hold no white space, so a text's ids are those of its runs between white space;
    each worker remembers the ids of runs. A run that ends in punctuation after a plain letter or digit is made of two. Texts
    with a control character on which Python and the tokenizer disagree go to the tokenizer whole.
    """
    t = tokenizer(path)
    if path not in _memo:
        vocab = t.get_vocab()
        last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        _memo[path] = ({"": b""}, last)
    runs, last = _memo[path]
    # a run takes a string, its ids as bytes and a place in the dict: some 240 bytes
    if len(runs) * 240 > MEMO_BYTES:
        runs.clear()
        runs[""] = b""
    odd = [_ODD.search(x) is not None for x in texts]
    # a text that begins or ends in white space has empty runs there
    split = pc.utf8_split_whitespace(pa.array(["" if o else _lowered(x) for o, x in zip(odd, texts)], pa.string()))
    flat = split.flatten().dictionary_encode()
    distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    new = set(distinct).difference(runs)
    words = {r for r in new if r.isalpha()}
    single: set[str] = set()
    ended: dict[str, str] = {}
    for r in new - words:
        core = r.rstrip(_STOPS)
        if core and len(core) < len(r) and core[-1] in _PLAIN:
            ended[r] = core
            if core not in runs:
                (words if core.isalpha() else single).add(core)
            if (stop := r[len(core) :]) not in runs:
                single.add(stop)
        else:
            single.add(r)
    _learn(list(words), list(single), t, runs, last)
    for r, core in ended.items():
        runs[r] = runs[core] + runs[r[len(core) :]]
    # the ids of all runs in a row, gathered from those of the distinct ones
    each = list(map(runs.__getitem__, distinct))
    sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
    firsts, codes = np.cumsum(sizes) - sizes, np.asarray(flat.indices)
    many = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(many)])
    bounds = (ends[np.asarray(split.offsets)] if texts else ends).tolist()
    ids = np.frombuffer(b"".join(each), dtype="<u4")[np.repeat(firsts[codes] - ends[:-1], many) + np.arange(ends[-1])]
    return [
        np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() if o else ids[low:high].tobytes()
        for x, o, low, high in zip(texts, odd, bounds, bounds[1:])
    ]


def pieces(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each text's ids and end_id, cut at multiples of window."""
    prepared(docs)
    end = int(end_id).to_bytes(4, "little")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            for at, n in slices(b.column(1)):
                rows: list[tuple] = []
                texts = [x or "" for x in b.column(1).slice(at, n).to_pylist()]
                for doc_id, raw in zip(b.column(0).slice(at, n).to_pylist(), encoded(texts, path)):
                    raw += end
                    total = len(raw) // 4
                    for start in range(0, total, window):
                        part = raw[4 * start : 4 * (start + window)]
                        rows.append((doc_id, start, len(part) // 4, crc32(part), total))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
        _memo.clear()
        released()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long"), F.col(quoted(text_col)).alias("text")).mapInArrow(scan, schema)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that the sum is as close to room as can be, not above it.

    counts: how many there are of each length. Lengths are taken up longest first, each in powers of two of its count;
    the search ends as soon as room is met. The sums that can be reached are the bits of an integer; the integer
    before each step is kept, and the counts are found by walking the steps back.
    """
    full, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, power = min(counts[length], room // length), 1
        while left > 0:
            many = min(power, left)
            left, power = left - many, power * 2
            steps.append((length, many, reach))
            reach |= (reach << (length * many)) & full
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    take: dict[int, int] = {}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            take[length] = take.get(length, 0) + many
            at -= length * many
    return take


def plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Windows as (multiset of lengths, how often). Every remainder of counts is in exactly one window."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        take = best_fill({k: v for k, v in left.items() if v}, window - longest)
        left[longest] += 1
        take[longest] = take.get(longest, 0) + 1
        times = min(left[k] // n for k, n in take.items())
        out.append((take, times))
        for k, n in take.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _places(spark: SparkSession, windows: list[tuple[dict[int, int], int]]) -> DataFrame:
    """For ranks [low, high) of a length: first sequence, pieces of that length a window, offset of the first."""
    rows, used, sequence = [], {}, 0
    for take, times in windows:
        offset = 0
        for length, n in sorted(take.items(), reverse=True):
            low = used.get(length, 0)
            rows.append((length, low, low + n * times, sequence, n, offset))
            used[length] = low + n * times
            offset += length * n
        sequence += times
    return spark.createDataFrame(rows, "p_length long, low long, high long, first_sequence long, many long, first_offset long")


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with rank: 0, 1, ... within each value of key. rows must be a written table, so that its parts hold still.

    A part's rows of a key are numbered within the part, and the counts of the parts before it are added: no task
    holds more of a key than one part does.
    """
    parted = written(rows.withColumn("part", F.spark_partition_id()), "parts")
    counts = parted.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(key).alias("__k"), F.col("part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order)) - 1
    numbered = parted.withColumn("__own", own)
    joined = numbered.join(starts, (numbered[key] == starts["__k"]) & (numbered["part"] == starts["__p"]))
    return joined.withColumn("rank", F.col("__own") + F.col("__before")).drop("__k", "__p", "__before", "__own", "part")


def pack(docs: DataFrame, path: str, window: int = 4096, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most window ids and are numbered from 0 without gaps; pieces lie in them without gaps from
    offset 0. Null text counts as empty, so its document is end_id alone. Repeated rows are packed as often as they
    are there. An empty table gives an empty result; other columns are not read.
    """
    spark = prepared(docs)
    rows = written(pieces(docs, path, window, end_id, text_col), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # a row per length: at most window
    places = _places(spark, plan(counts, window))
    placed = ranked(rows, "length", ["doc_id", "start", "ids_crc32"])
    # one row per length and planned multiset: its size depends on window alone
    joined = placed.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("many"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (nth % F.col("many")) * F.col("length")).cast("long").alias("offset"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(TOKENIZER))
