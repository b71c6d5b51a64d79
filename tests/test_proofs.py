"""Range proofs, deltas and Nix archives: round trips, models and hostile inputs."""

import hashlib
import shutil
import subprocess
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from digestlake.functions import codecs, deltas, hashing, proofs
from digestlake.sources import archives, nar


def body(n, seed=1):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 256, n, dtype="uint8").tobytes()


@pytest.mark.parametrize("n", [0, 1, 1024, 16384, 16385, 50_000, 16384 * 5, 200_001])
def test_proofs(n):
    data = body(n)
    digest, _ = proofs.outboard(data)
    assert digest == hashing.blake3(data)
    for low, size in [(0, n), (n // 2, n - n // 2), (n // 3, min(20, n - n // 3)), (n, 0)]:
        same, proof = proofs.prove(data, low, size)
        assert same == digest
        assert proofs.proven(proof, digest, n, low, size) == data[low : low + size]
        piece = bytes(255 - x for x in data[low : low + size])
        assert proofs.overwritten(proof, digest, n, low, piece) == hashing.blake3(data[:low] + piece + data[low + size :])


def test_proofs_refuse_changes():
    data = body(100_000)
    digest, proof = proofs.prove(data, 40_000, 10)
    for at in (0, 40, len(proof) - 1):
        bad = proof[:at] + bytes([proof[at] ^ 1]) + proof[at + 1 :]
        with pytest.raises(proofs.ProofError):
            proofs.proven(bad, digest, len(data), 40_000, 10)
    for bad in (proof[:-1], proof + b"x", b""):
        with pytest.raises(proofs.ProofError):
            proofs.proven(bad, digest, len(data), 40_000, 10)
    with pytest.raises(proofs.ProofError):
        proofs.prove(data, 99_999, 2)


def test_outboard_lists_every_parent():
    assert [len(proofs.outboard(body(n))[1]) for n in (0, 16384, 16385, 16384 * 5)] == [0, 0, 64, 256]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=4000), max_size=5), st.lists(st.integers(0, 4), max_size=8))
def test_deltas_round_trip(parts, order):
    old = b"".join(parts)
    new = b"".join(parts[i] for i in order if i < len(parts))
    for a, b in ((new, old), (old, new), (new, b""), (b"", old)):
        assert deltas.apply_delta(deltas.encode_delta(a, b), b) == a
        assert deltas.apply_tree_delta(deltas.tree_delta(a, b), b) == a


def test_delta_copies_what_is_held():
    old = body(300_000)
    new = old[:100_000] + b"between" + old[100_000:] + body(10, 2)
    kinds = [(k, n) for k, _, n, _ in deltas.tokens(deltas.encode_delta(new, old))]
    assert kinds == [("copy", 100_000), ("literal", 7), ("copy", 200_000), ("literal", 10)]


def test_bad_deltas():
    old = body(50_000)
    frame = deltas.encode_delta(old + b"x", old)
    for bad in (frame[:-1], frame + b"x", b"y" + frame, frame[:19] + b"\0" + frame[20:]):
        with pytest.raises(codecs.Malformed):
            deltas.apply_delta(bad, old)
    with pytest.raises(codecs.Malformed):
        deltas.apply_delta(frame, old[:-1])
    for bad in (b"", b"\1\1\0", b"\1\1\x91\0\5", b"\1\2\1a"):
        with pytest.raises(codecs.Malformed):
            deltas.apply_tree_delta(bad, b"a")


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_git_reads_the_tree_delta(tmp_path):
    import struct

    old = body(70_000)
    new = old[:30_000] + b"changed" + old[30_007:] + b"tail"
    oid = hashlib.sha1(b"blob %d\0" % len(old) + old).digest()

    def entry(kind, raw, head=b""):
        n, size, first = len(raw), bytearray(), True
        low, n = n & 15, n >> 4
        size.append(kind << 4 | low | (128 if n else 0))
        while n:
            size.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
        return bytes(size) + head + zlib.compress(raw)

    pack = b"PACK" + struct.pack(">II", 2, 2) + entry(3, old) + entry(7, deltas.tree_delta(new, old), oid)
    pack += hashlib.sha1(pack).digest()
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "unpack-objects", "-q"], input=pack, check=True)
    name = hashlib.sha1(b"blob %d\0" % len(new) + new).hexdigest()
    assert subprocess.run(["git", "-C", str(tmp_path), "cat-file", "blob", name], capture_output=True, check=True).stdout == new


TREE = {b"bin": {b"run": ("x", b"#!/bin/sh\n")}, b"empty": {}, b"link": ("l", b"bin/run"), b"note": b"hello"}


def test_nar_round_trip_and_refusals():
    raw = nar.write_nar(TREE)
    assert [(p, k, t, b) for p, k, t, b in nar.nodes(raw)] == [
        ("", "d", None, b""), ("bin", "d", None, b""), ("bin/run", "x", None, b"#!/bin/sh\n"), ("empty", "d", None, b""), ("link", "l", "bin/run", b""), ("note", "f", None, b"hello"),
    ]
    deep = b"x"
    for _ in range(300):
        deep = {b"d": deep}
    bad_order = nar.text(nar.MAGIC) + raw[len(nar.text(nar.MAGIC)) :].replace(nar.text(b"bin"), nar.text(b"zzz"))
    for bad in (raw[:-1], raw + b"x", raw[:-8], b"", bad_order, raw.replace(b"hello\0", b"hello\1"), nar.write_nar({b"..": b""}), nar.write_nar(deep)):
        with pytest.raises(codecs.Malformed):
            nar.nodes(bad)


def test_read_nar(spark, tmp_path):
    (tmp_path / "a.nar").write_bytes(nar.write_nar(TREE))
    got = {r.path: (r.kind, r.target, r.size, r.digest) for r in archives.importer("nar")(spark, str(tmp_path)).collect()}
    assert got["note"] == ("f", None, 5, hashlib.sha256(b"hello").hexdigest()) and got["link"] == ("l", "bin/run", 0, None)
    assert archives.detect(nar.write_nar(TREE)[:512]) == "nar"


def test_file_nar(spark):
    rows = [b"", b"1234567", b"12345678", body(300), None]
    df = spark.createDataFrame([(r,) for r in rows], "b binary")
    got = [r[0] for r in df.select(nar.file_nar(df["b"])).collect()]
    assert [g if g is None else bytes(g) for g in got] == [None if r is None else nar.write_nar(r) for r in rows]


def test_proofs_of_rows(spark):
    data = [(1, body(60_000)), (2, body(10)), (3, body(40_000, 2))]
    made = proofs.range_proofs(spark.createDataFrame(data, "k long, bytes binary"), "k", 20_000, 100)
    got = {r.k: (bytes(r.bytes), bytes(r.digest_after)) for r in proofs.open_proofs(made, "k", 20_000, 100, b"z" * 100).collect()}
    assert got == {k: (b[20_000:20_100], hashing.blake3(b[:20_000] + b"z" * 100 + b[20_100:])) for k, b in data if k != 2}
    from pyspark.sql import functions as F

    broken = made.withColumn("digest", F.lit(bytes(32)))
    assert {r.bytes for r in proofs.open_proofs(broken, "k", 20_000, 100).collect()} == {None}
