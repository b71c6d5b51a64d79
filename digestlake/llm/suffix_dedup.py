"""Removal of repeated 50-byte strings with deep-shallow suffix sorting.

A string of 50 bytes is found again by its smallest 20-gram hash: equal strings have equal smallest hashes, and the
windows of a text fall into runs that share one (about 16 windows). The work has four steps over blocks of documents:

1. each block sends marks of its distinct run hashes (32 bits, sorted, as differences) to buckets; a bucket tells the
   blocks which occur in two documents. Different hashes that share a mark only cost a segment sent in vain;
2. each block cuts out the runs with such hashes (a segment: the bytes that a run's windows cover) and sends each
   distinct segment once, with the smallest doc_id that has it in this block;
3. a bucket sorts suffixes of its segments: multikey quicksort over 8-byte characters down to a shallow depth, then
   blind tries for the groups that still agree. First the suffixes that cover each segment are sorted, which tells
   equal segments from different blocks; where a hash has several distinct segments, the suffixes at all their windows
   are. Suffixes that agree on 50 bytes get the smallest doc_id of their group; blocks are told the runs of these per
   segment;
4. each block marks the windows whose smallest doc_id is below their document's, and drops the bytes they cover.

A passage that very many documents share costs a bucket one row per block. Segments of one hash are in one bucket, so
no match is lost; different hashes never hold equal strings. What is shuffled is packed with zstd by bucket, as the
overlapping segments are several times as large as the texts that they are cut from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestlake.llm.blocks import BLOCK_BYTES, block_id, unvarints, varints
from digestlake.llm.common import file_system, partitions, prepared, quoted, scratch

GRAM = 20
SHALLOW = 16
_SMALL = 512
#: Suffixes whose bytes are gathered at once.
_CHUNK = 1 << 16
#: Windows or segments that a bucket sorts at once; each takes some 130 bytes meanwhile.
SORTED = 1 << 19
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]


def run_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """For each window of length bytes the smallest hash of the grams in it."""
    n = len(data)
    if n < length:
        return np.empty(0, dtype=np.uint64)
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    m = n - GRAM + 1
    h = eight[:m] * _P[0]
    h ^= h >> np.uint64(29)
    h += eight[8 : 8 + m] * _P[1]
    h ^= h >> np.uint64(31)
    h = (h + four[16 : 16 + m]) * _P[2]
    h ^= h >> np.uint64(32)
    h *= _P[3]
    h ^= h >> np.uint64(29)
    width, want = 1, length - GRAM + 1
    while width * 2 <= want:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: n - length + 1], h[want - width :]) if width < want else h


def chunks(docs: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about size bytes together."""
    first, held = 0, 0
    for i, d in enumerate(docs):
        held += len(d)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(docs):
        yield first, len(docs)


def runs(docs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first window, windows) of each run of windows with one hash, over joined documents."""
    data = np.frombuffer(b"".join(docs), dtype=np.uint8)
    ends = np.cumsum([len(d) for d in docs])
    starts = ends - [len(d) for d in docs]
    h = run_hashes(data, length)
    if not len(h):
        return h, *(np.empty(0, np.int64) for _ in range(3))
    # a window must end inside the document that it starts in
    of = np.searchsorted(ends, np.arange(len(h)), side="right")
    fits = np.nonzero(np.arange(len(h)) + length <= ends[of])[0]
    if not len(fits):
        return h[:0], *(np.empty(0, np.int64) for _ in range(3))
    own = h[fits]
    cut = np.nonzero((np.diff(fits) != 1) | (own[1:] != own[:-1]) | (of[fits[1:]] != of[fits[:-1]]))[0] + 1
    first = np.concatenate([[0], cut])
    count = np.diff(np.concatenate([first, [len(fits)]]))
    return own[first], of[fits[first]], fits[first] - starts[of[fits[first]]], count


# ---- deep-shallow sorting ------------------------------------------------------------------------------------------


def shallow_sort(keys: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of 8-byte characters to a depth in bytes: order, and where each group of rows starts
    that agree so far. Small parts are sorted directly."""
    order = np.arange(len(keys))
    starts = np.zeros(len(keys), dtype=bool)
    last = depth // 8
    todo = [(0, len(keys), 0)]
    while todo:
        a, b, d = todo.pop()
        if a >= b:
            continue
        starts[a] = True
        if d >= last or b - a == 1:
            continue
        part = order[a:b]
        char = keys[part, d]
        if b - a <= _SMALL:
            rest = keys[part][:, d:last]
            by = np.lexsort(rest.T[::-1])
            order[a:b] = part[by]
            rest = rest[by]
            starts[a + 1 : b] = (rest[1:] != rest[:-1]).any(axis=1)
            continue
        pivot = np.partition(char[:: max(1, (b - a) // 64)], 32 if (b - a) >= 64 else 0)[min(32, len(char[:: max(1, (b - a) // 64)]) - 1)]
        less, more = part[char < pivot], part[char > pivot]
        same = part[char == pivot]
        order[a:b] = np.concatenate([less, same, more])
        i, j = a + len(less), a + len(less) + len(same)
        todo += [(a, i, d), (i, j, d + 1), (j, b, d)]
    return order, np.nonzero(starts)[0]


class BlindTrie:
    """Orders strings that agree on a long prefix. Inner nodes keep only the depth at which their strings part."""

    __slots__ = ("length", "root", "keys", "members")

    def __init__(self, length: int):
        self.length, self.root = length, None
        self.keys: list[int] = []
        self.members: list[list[int]] = []

    def _leaf(self, key: int, member: int) -> int:
        self.keys.append(key)
        self.members.append([member])
        return len(self.keys) - 1

    def add(self, key: bytes, member: int) -> None:
        number = int.from_bytes(key, "big")
        if self.root is None:
            self.root = self._leaf(number, member)
            return
        node = self.root
        while not isinstance(node, int):  # blind: bytes between the depths are not looked at
            node = node[1].get(key[node[0]]) if key[node[0]] in node[1] else next(iter(node[1].values()))
        other = number ^ self.keys[node]
        if not other:
            self.members[node].append(member)
            return
        lcp = self.length - 1 - (other.bit_length() - 1) // 8
        mark = self.keys[node] >> 8 * (self.length - 1 - lcp) & 255
        up, node = None, self.root
        while not isinstance(node, int) and node[0] < lcp:
            up, node = node, node[1][key[node[0]]]
        leaf = self._leaf(number, member)
        if not isinstance(node, int) and node[0] == lcp:
            node[1][key[lcp]] = leaf
            return
        new = (lcp, {mark: node, key[lcp]: leaf})
        if up is None:
            self.root = new
        else:
            up[1][key[up[0]]] = new

    def classes(self) -> Iterator[list[int]]:
        """Members of each distinct string, in the strings' order."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                yield self.members[node]
            else:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]


def _rows_equal(view: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=bool)
    for k in range(0, len(a), _CHUNK):
        out[k : k + _CHUNK] = (view[a[k : k + _CHUNK]] == view[b[k : k + _CHUNK]]).all(axis=1)
    return out


def suffix_classes(data: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """The rank of each suffix data[at:] among all, by its first length bytes; equal ones share a rank.

    Groups that agree to the shallow depth are ordered by blind tries. Of suffixes that are wholly equal one goes into
    the trie; they are told by a hash first and then byte for byte.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    keys = np.empty((len(at), SHALLOW // 8), dtype=np.uint64)
    rest = np.zeros(len(at), dtype=np.uint64)
    for k in range(0, len(at), _CHUNK):
        some = np.zeros((min(_CHUNK, len(at) - k), -(-length // 8) * 8), dtype=np.uint8)
        some[:, :length] = view[at[k : k + _CHUNK]]
        chars = some.view(">u8")
        keys[k : k + _CHUNK] = chars[:, : SHALLOW // 8]
        for c in range(SHALLOW // 8, chars.shape[1]):
            h = (rest[k : k + _CHUNK] ^ chars[:, c].astype(np.uint64)) * _P[0]
            rest[k : k + _CHUNK] = h ^ (h >> np.uint64(31))
    order, starts = shallow_sort(keys)
    size = np.diff(np.append(starts, len(at)))
    group = np.repeat(np.arange(len(starts)), size)
    by = np.lexsort((rest[order], group))
    order = order[by]
    same = (group[1:] == group[:-1]) & (rest[order[1:]] == rest[order[:-1]])
    told = np.nonzero(same)[0]
    same[told] = _rows_equal(view, at[order[told]], at[order[told + 1]])
    # the first of each run of equal suffixes stands for them
    first = np.nonzero(np.concatenate([[True], ~same]))[0]
    leads = order[first]
    in_group = np.zeros(len(first), dtype=np.int64)
    of = group[first]
    cuts = np.searchsorted(of, np.arange(len(starts) + 1))
    number = np.ones(len(starts), dtype=np.int64)
    for g in np.nonzero(np.diff(cuts) > 1)[0].tolist():
        trie = BlindTrie(length)
        for m in range(cuts[g], cuts[g + 1]):
            p = int(at[leads[m]])
            trie.add(data[p : p + length], m)
        found = list(trie.classes())
        number[g] = len(found)
        for k, members in enumerate(found):
            in_group[members] = k
    rank = (np.cumsum(number) - number)[of] + in_group
    out = np.empty(len(at), dtype=np.int64)
    out[order] = np.repeat(rank, np.diff(np.append(first, len(order))))
    return out


def segment_classes(data: bytes, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """A number per segment data[start : start + size], equal for equal segments, from the ranks of the suffixes that
    cover it: those at every length bytes and the last one."""
    many = -(-size // length)
    of = np.repeat(np.arange(len(size)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    rank = suffix_classes(data, start[of] + np.minimum(nth * length, size[of] - length), length)
    code = np.unique(size, return_inverse=True)[1].astype(np.int64)
    begin = np.cumsum(many) - many
    left = np.arange(len(size))
    k = 0
    while len(left):
        pair = np.stack([code[left], rank[begin[left] + k]], axis=1)
        by = np.lexsort((pair[:, 1], pair[:, 0]))
        new = np.concatenate([[True], (pair[by][1:] != pair[by][:-1]).any(axis=1)])
        # sizes differ between codes, so finished segments and those that go on never get mixed
        code[left[by]] = np.cumsum(new) - 1 + (int(code.max()) + 1 if len(left) < len(size) else 0)
        k += 1
        left = left[many[left] > k]
    return np.unique(code, return_inverse=True)[1]


def grouped(weight: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of whole groups (numbers from 0) of about SORTED in weight; only a group that weighs more exceeds it."""
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group))  # of each group in order
    held = np.concatenate([[0], np.cumsum(weight[order])])
    at = 0
    while at < len(order):
        last = int(np.searchsorted(held, held[at] + SORTED, side="right")) - 1
        g = int(np.searchsorted(ends, last, side="right"))
        end = int(ends[g - 1]) if g else 0
        end = end if end > at else int(ends[np.searchsorted(ends, at, side="right")])
        yield order[at:end]
        at = end


def window_lows(data: bytes, at: np.ndarray, low: np.ndarray, length: int) -> np.ndarray:
    """For each window data[at : at + length] the smallest low of the windows that equal it.

    At most SORTED windows are sorted at once: more are dealt by a hash of their bytes, and what is still more is
    sorted in parts, of which one window for each distinct string is sorted again.
    """
    out = np.empty(len(at), dtype=np.int64)
    deals = max(1, -(-len(at) // SORTED))
    to = np.zeros(len(at), dtype=np.uint32)
    if deals > 1:
        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), length)
        for k in range(0, len(at), _CHUNK):
            some = np.zeros((min(_CHUNK, len(at) - k), -(-length // 8) * 8), dtype=np.uint8)
            some[:, :length] = view[at[k : k + _CHUNK]]
            h = np.zeros(len(some), dtype=np.uint64)
            for char in some.view("<u8").T:
                h = (h ^ char) * _P[1]
                h ^= h >> np.uint64(29)
            to[k : k + _CHUNK] = h % np.uint64(deals)
    for deal in range(deals):
        own = np.nonzero(to == deal)[0]
        parts, firsts, lows = [], [], []
        for k in range(0, len(own), SORTED):
            some = own[k : k + SORTED]
            rank = suffix_classes(data, at[some], length)
            least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, rank, low[some])
            first = np.empty(len(least), dtype=np.int64)
            first[rank] = some
            parts.append((some, rank.astype(np.int32)))
            firsts.append(first)
            lows.append(least)
        if len(parts) > 1:
            rank = suffix_classes(data, at[np.concatenate(firsts)], length)
            least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, rank, np.concatenate(lows))
            lows = np.split(least[rank], np.cumsum([len(x) for x in firsts])[:-1])
        for (some, rank), least in zip(parts, lows):
            out[some] = least[rank]
    return out


# ---- steps over blocks ---------------------------------------------------------------------------------------------


def _blob(values, kind: str) -> bytes:
    return np.asarray(values, dtype=kind).tobytes()


def squeezed(data: bytes | pa.Buffer) -> bytes:
    """data packed with zstd behind its length."""
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if len(data) else b"")


def unsqueezed(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(memoryview(data)[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _packed(values, kind: str) -> bytes:
    """Whole numbers as differences, which are mostly small, packed."""
    v = np.asarray(values, dtype=kind)
    return squeezed(np.diff(v, prepend=v[:0].dtype.type(0)).tobytes())  # differences that overflow come back in the sum


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(unsqueezed(data), kind), dtype=kind)


def _marks(h: np.ndarray) -> np.ndarray:
    """32 bits of each hash. The lowest bits tell the bucket and the highest ones are mostly zero in a minimum."""
    return h >> np.uint64(16) & np.uint64(0xFFFFFFFF)


def _mark_rows(h: np.ndarray, two: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """For each bucket the distinct marks of hashes, times two and odd if two documents have one."""
    for k, at in _deal((h % np.uint64(buckets)).astype(np.int64), buckets):
        mark = _marks(h[at])
        order = np.argsort(mark, kind="stable")
        mark = mark[order]
        first = np.nonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))[0]
        odd = np.maximum.reduceat(two[at][order].astype(np.uint64), first)
        odd |= np.diff(np.append(first, len(mark))) > 1  # two hashes of one mark may be in two documents
        yield k, varints(np.diff(mark[first] << np.uint64(1) | odd, prepend=np.uint64(0)))


def _marks_of(data: bytes) -> np.ndarray:
    return np.cumsum(unvarints(data)).astype(np.uint64)


def _deal(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cuts[k] < cuts[k + 1]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _store(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            texts = b.column(1)
            blocks = []
            for n in pc.binary_length(texts).to_pylist():
                blocks.append(block_id(part, number))
                size += n + 64
                if size >= block_bytes:
                    number, size = number + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), b.column(0), texts], ["block", "doc_id", "text"])

    return run


def _read(where: str, block: int) -> tuple[list[int | None], list[bytes]]:
    import pyarrow.dataset as ds

    fs, at = file_system(f"{where}/block={block}")
    table = ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=["doc_id", "text"])
    return table.column("doc_id").to_pylist(), [x or b"" for x in table.column("text").to_pylist()]


def _hashes(where: str, length: int, buckets: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Step 1 in a block: marks of its distinct hashes; odd if two documents of the block have one."""
        ids, docs = _read(where, key[0])
        docs = [d if i is not None else b"" for i, d in zip(ids, docs)]
        got = []
        for a, b in chunks(docs):
            h, of, _, _ = runs(docs[a:b], length)
            if len(h):
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                new = np.concatenate([[True], h[1:] != h[:-1]])
                other = np.concatenate([[False], (h[1:] == h[:-1]) & (of[1:] != of[:-1])])
                first = np.nonzero(new)[0]
                got.append((h[first], np.add.reduceat(other, first) > 0))
        if not got:
            return pd.DataFrame({"bucket": [], "block": [], "hashes": []})
        h, two = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.argsort(h, kind="stable")
        h, two = h[order], two[order]
        first = np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0]
        many = np.diff(np.append(first, len(h))) > 1
        two = (np.add.reduceat(two, first) > 0) | many
        rows = [(k, key[0], marks) for k, marks in _mark_rows(h[first], two, buckets)]
        return pd.DataFrame(rows, columns=["bucket", "block", "hashes"])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 1 in a bucket: for each block its marks that two documents have."""
    own = [_marks_of(x) for x in pdf["hashes"]]
    every = np.concatenate(own)
    plain = every >> np.uint64(1)
    order = np.argsort(plain, kind="stable")
    s = plain[order]
    first = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
    count = np.diff(np.append(first, len(s)))
    odd = np.add.reduceat((every[order] & np.uint64(1)).astype(np.int64), first) > 0
    keep = np.repeat((count > 1) | odd, count)
    mask = np.empty(len(every), dtype=bool)
    mask[order] = keep
    out, at = [], 0
    for bucket, block, x in zip(pdf["bucket"], pdf["block"], own):
        m = mask[at : at + len(x)]
        at += len(x)
        if m.any():
            out.append((block, bucket, varints(np.diff(x[m] >> np.uint64(1), prepend=np.uint64(0)))))
    return pd.DataFrame(out, columns=["block", "bucket", "hashes"])


def _segments(where: str, length: int, buckets: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Step 2: distinct segments of a block for the buckets, and where they are in its documents."""
        # a bucket and a mark make one number
        shared = np.sort(np.concatenate([np.uint64(k) << np.uint64(32) | _marks_of(x) for k, x in zip(pdf["bucket"], pdf["hashes"])]))
        ids, docs = _read(where, key[0])
        known: dict[bytes, int] = {}
        hashes, least, at_doc, at_start, at_seg = [], [], [], [], []
        usable = [d if i is not None else b"" for i, d in zip(ids, docs)]
        for a, b in chunks(usable):
            h, of, start, count = runs(usable[a:b], length)
            told = h % np.uint64(buckets) << np.uint64(32) | _marks(h)
            k = np.minimum(np.searchsorted(shared, told), len(shared) - 1)
            hit = shared[k] == told
            for v, d, s, n in zip(h[hit].tolist(), (of[hit] + a).tolist(), start[hit].tolist(), count[hit].tolist()):
                seg = usable[d][s : s + n + length - 1]
                i = known.get(seg)
                if i is None:
                    i = known[seg] = len(hashes)
                    hashes.append(v)
                    least.append(ids[d])
                elif ids[d] < least[i]:
                    least[i] = ids[d]
                at_doc.append(d)
                at_start.append(s)
                at_seg.append(i)
        rows = []
        if hashes:
            segs, h, least_ = list(known), np.array(hashes, dtype=np.uint64), np.array(least, dtype=np.int64)
            for bucket, at in _deal((h % np.uint64(buckets)).astype(np.int64), buckets):
                some = [segs[i] for i in at.tolist()]
                rows.append(("segments", key[0], bucket, _packed(at, "<i4"), _blob(_marks(h[at]), "<u4"), _packed(least_[at], "<i8"), _packed([len(x) for x in some], "<i4"), b"".join(some)))
            rows.append(("places", key[0], -1, _blob(at_doc, "<i4"), _blob(at_start, "<i8"), _blob(at_seg, "<i4"), None, None))
        return pd.DataFrame(rows, columns=["kind", "block", "bucket", "a", "b", "c", "d", "data"])

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of segments as they are shuffled. Where they are stored, a block's rows are packed together."""
    for b in batches:
        at = b.schema.get_field_index("data")
        yield b.set_column(at, "data", pa.array([squeezed(x.as_buffer()) for x in b.column(at)], pa.binary()))


def _sorted(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Step 3 in a bucket: for each block's segments the smallest doc_id of each run of windows."""
        index = [_unpacked(a, "<i4") for a in pdf["a"]]
        h = np.concatenate([np.frombuffer(b, "<u4") for b in pdf["b"]])
        least = np.concatenate([_unpacked(c, "<i8") for c in pdf["c"]])
        size = np.concatenate([_unpacked(d, "<i4") for d in pdf["d"]]).astype(np.int64)
        data = b"".join(unsqueezed(x) for x in pdf["data"])
        start = np.cumsum(size) - size
        mine, told = np.empty(len(size), dtype=np.int64), 0
        for some in grouped(-(-size // length), np.unique(h, return_inverse=True)[1]):
            mine[some] = told + segment_classes(data, start[some], size[some], length)
            told = int(mine[some].max()) + 1
        # each distinct segment: one place where it is, its hash, and the smallest doc_id that has it
        _, at = np.unique(mine, return_index=True)
        low = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(low, mine, least)
        windows = size[at] - length + 1
        _, inverse, count = np.unique(h[at], return_inverse=True, return_counts=True)
        several = np.nonzero(count[inverse] > 1)[0]
        # runs of windows of each segment: first window, windows, smallest doc_id
        run_seg = [np.nonzero(count[inverse] == 1)[0]]
        run_first = [np.zeros(len(run_seg[0]), dtype=np.int64)]
        run_count, run_low = [windows[run_seg[0]]], [low[run_seg[0]]]
        for some in grouped(windows[several], np.unique(inverse[several], return_inverse=True)[1]) if len(several) else ():
            own, n = several[some], windows[several[some]]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            value, seg = window_lows(data, np.repeat(start[at[own]], n) + nth, np.repeat(low[own], n), length), np.repeat(own, n)
            first = np.nonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (seg[1:] != seg[:-1])]))[0]
            run_seg.append(seg[first])
            run_first.append(nth[first])
            run_count.append(np.diff(np.append(first, len(value))))
            run_low.append(value[first])
        run_seg, run_first, run_count, run_low = (np.concatenate(x) for x in (run_seg, run_first, run_count, run_low))
        order = np.argsort(run_seg, kind="stable")
        cuts = np.searchsorted(run_seg[order], np.arange(len(at) + 1))
        out, done = [], 0
        for block, own in zip(pdf["block"], index):
            seg = mine[done : done + len(own)]
            done += len(own)
            many = cuts[seg + 1] - cuts[seg]
            pick = order[np.repeat(cuts[seg], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            out.append((block, _packed(np.repeat(own, many), "<i4"), _packed(run_first[pick], "<i8"), _packed(run_count[pick], "<i8"), _packed(run_low[pick], "<i8")))
        return pd.DataFrame(out, columns=["block", "a", "b", "c", "d"])

    return run


def _by_bucket(step):
    """step over the rows of each bucket of a partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            every = pd.concat(held, ignore_index=True)
            held.clear()
            for _, own in every.groupby("bucket", sort=False):
                yield step(own)

    return run


def kept_bytes(text: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and what is left, for runs of windows to be removed."""
    edge = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), spans, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


def _kept(where: str, places: str, length: int, with_text: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Step 4: the block's documents without what smaller documents have."""
        ids, docs = _read(where, key[0])
        marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seg, first, count, low = (np.concatenate([_unpacked(x, kind) for x in pdf[c]]) for c, kind in zip("abcd", ("<i4", "<i8", "<i8", "<i8")))
        if len(seg):
            import pyarrow.dataset as ds

            fs, at = file_system(f"{places}/kind=places/block={key[0]}")
            row = ds.dataset(at, filesystem=fs, format="parquet").to_table(columns=["a", "b", "c"]).to_pylist()[0]
            doc, start, of = np.frombuffer(row["a"], "<i4"), np.frombuffer(row["b"], "<i8"), np.frombuffer(row["c"], "<i4")
            order = np.argsort(seg, kind="stable")
            cuts = np.searchsorted(seg[order], np.arange(int(of.max()) + 2))
            many = cuts[of + 1] - cuts[of]
            place = np.repeat(np.arange(len(of)), many)
            pick = order[np.repeat(cuts[of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            id_of = np.array([-1 if i is None else i for i in ids], dtype=np.int64)
            gone = low[pick] < id_of[doc[place]]
            place, pick = place[gone], pick[gone]
            d, s, n = doc[place], start[place] + first[pick], count[pick]
            by = np.argsort(d, kind="stable")
            d, s, n = d[by], s[by], n[by]
            edges = np.nonzero(np.concatenate([[True], d[1:] != d[:-1]]))[0] if len(d) else np.empty(0, np.int64)
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(d)).tolist()):
                marks[int(d[a])] = (s[a:b], n[a:b])
        rows = []
        for i, (doc_id, text) in enumerate(zip(ids, docs)):
            removed, spans, left = kept_bytes(text, *marks[i], length) if i in marks else (0, 0, text)
            rows.append((doc_id, len(text), removed, spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
        return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return run


def remove_repeats(docs: DataFrame, length: int = 50, text_col: str = "text", block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, on demand).

    Removed is each byte covered by a string of length bytes that also starts in a document with a smaller doc_id, as
    judged on the input. Null text counts as empty; texts shorter than length lose nothing. Rows with the same doc_id
    take nothing from each other; rows with a null doc_id lose nothing and take nothing. An empty table gives an empty
    result; other columns are not read. length is at least 36.
    """
    if length < GRAM + SHALLOW:
        raise ValueError(f"length must be at least {GRAM + SHALLOW}")
    spark = prepared(docs)
    where, places = scratch(spark, "suffix-blocks"), scratch(spark, "suffix-segments")
    stored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).cast("binary").alias("text"))
    stored.mapInArrow(_store(block_bytes), "block long, doc_id long, text binary").write.option("compression", "zstd").partitionBy("block").parquet(where)
    ids = spark.read.schema("doc_id long, text binary, block long").parquet(where).select("block").distinct()
    # a bucket for each block of text at least, so that it holds no more where partitions do not grow with the input
    buckets = max(partitions(spark), ids.count())
    # a block or bucket is few rows and much work: a count that is asked for is not merged into fewer tasks
    tasks = 2 * buckets
    hashes = ids.repartition(tasks, "block").groupBy("block").applyInPandas(_hashes(where, length, buckets), "bucket int, block long, hashes binary")
    shared = hashes.repartitionById(buckets, F.col("bucket")).mapInPandas(_by_bucket(_shared), "block long, bucket int, hashes binary")
    schema = "kind string, block long, bucket int, a binary, b binary, c binary, d binary, data binary"
    found = shared.repartition(tasks, "block").groupBy("block").applyInPandas(_segments(where, length, buckets), schema)
    found.write.option("compression", "zstd").partitionBy("kind", "block").parquet(places)
    segments = spark.read.schema(schema).parquet(places).where("kind = 'segments'").drop("kind")
    segments = segments.mapInArrow(_squeeze, segments.schema)
    answers = segments.repartitionById(buckets, F.col("bucket")).mapInPandas(_by_bucket(_sorted(length)), "block long, a binary, b binary, c binary, d binary")
    none = F.lit(b"")
    every = answers.unionByName(ids.select("block", *[none.alias(c) for c in "abcd"]))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return every.repartition(tasks, "block").groupBy("block").applyInPandas(_kept(where, places, length, with_text), schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")
