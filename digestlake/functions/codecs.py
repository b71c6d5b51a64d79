"""Binary forms of directories, linked objects and identifiers, and bounded decompression."""

from __future__ import annotations

import struct
from dataclasses import dataclass

#: Fixed values of the directory format: a tag per node kind.
DIRECTORY, FILE, SYMLINK = 0, 1, 2
#: Fixed values of the identifier format: CID version, codecs, and the BLAKE3 multihash code and length.
CID_VERSION, RAW_CODEC, LINKED_CODEC, BLAKE3_CODE, DIGEST_BYTES = 1, 0x55, 0x300001, 0x1E, 32


class Malformed(ValueError):
    """Bytes that are no canonical form."""


@dataclass(frozen=True)
class Entry:
    name: bytes
    kind: int
    digest: bytes = b""
    size: int = 0
    executable: bool = False
    target: bytes = b""


def encode_directory(entries: list[Entry]) -> bytes:
    """Count, then per entry in name order its tag, name, and what its kind has."""
    ordered = sorted(entries, key=lambda e: e.name)
    if any(a.name == b.name for a, b in zip(ordered, ordered[1:])):
        raise Malformed("two entries have one name")
    out = [struct.pack("<Q", len(ordered))]
    for e in ordered:
        out.append(struct.pack("<BQ", e.kind, len(e.name)) + e.name)
        if e.kind == SYMLINK:
            out.append(struct.pack("<Q", len(e.target)) + e.target)
        else:
            out.append(e.digest + struct.pack("<Q", e.size) + (struct.pack("<B", e.executable) if e.kind == FILE else b""))
    return b"".join(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise Malformed("the data ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def end(self) -> None:
        if self.at != len(self.data):
            raise Malformed("data after the end")


def decode_directory(data: bytes) -> list[Entry]:
    r, out = _Reader(data), []
    for _ in range(r.number("<Q")):
        kind = r.number("<B")
        name = r.take(r.number("<Q"))
        if not 0 < len(name) <= 255 or b"/" in name or b"\0" in name or name in (b".", b".."):
            raise Malformed("no name of an entry")
        if out and out[-1].name >= name:
            raise Malformed("names are not in order")
        if kind == SYMLINK:
            out.append(Entry(name, kind, target=r.take(r.number("<Q"))))
        elif kind in (DIRECTORY, FILE):
            digest, size = r.take(DIGEST_BYTES), r.number("<Q")
            flag = r.number("<B") if kind == FILE else 0
            if flag > 1:
                raise Malformed("no flag")
            out.append(Entry(name, kind, digest, size, bool(flag)))
        else:
            raise Malformed("no kind of an entry")
    r.end()
    return out


def encode_linked(keys: list[tuple[str, bytes]], body: bytes) -> bytes:
    """Sorted distinct object keys, then a body."""
    out = [struct.pack("<Q", len(set(keys)))]
    for namespace, native_id in sorted(set(keys)):
        name = namespace.encode("ascii")
        out.append(struct.pack("<B", len(name)) + name + struct.pack("<B", len(native_id)) + native_id)
    return b"".join(out) + body


def decode_linked(data: bytes) -> tuple[list[tuple[str, bytes]], bytes]:
    r, keys = _Reader(data), []
    for _ in range(r.number("<Q")):
        key = (r.take(r.number("<B")).decode("ascii"), r.take(r.number("<B")))
        if keys and keys[-1] >= key:
            raise Malformed("keys are not in order")
        keys.append(key)
    return keys, data[r.at :]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode_cid(codec: int, digest: bytes) -> bytes:
    if len(digest) != DIGEST_BYTES:
        raise Malformed("a digest has 32 bytes")
    return varint(CID_VERSION) + varint(codec) + varint(BLAKE3_CODE) + varint(DIGEST_BYTES) + digest


def decode_cid(cid: bytes) -> tuple[int, bytes]:
    numbers, at = [], 0
    for _ in range(4):
        n = shift = 0
        while True:
            if at >= len(cid) or shift > 63:
                raise Malformed("the identifier ends early")
            n |= (cid[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if cid[at - 1] < 128:
                break
        numbers.append(n)
    version, codec, code, length = numbers
    if (version, code, length) != (CID_VERSION, BLAKE3_CODE, DIGEST_BYTES) or codec not in (RAW_CODEC, LINKED_CODEC) or len(cid) - at != DIGEST_BYTES:
        raise Malformed("no identifier of this kind")
    return codec, cid[at:]


def compress(raw: bytes, level: int = 3) -> bytes:
    """zstd, or the bytes themselves behind another tag where that is not smaller."""
    import zstandard

    packed = zstandard.ZstdCompressor(level=level).compress(raw)
    return b"\1" + packed if len(packed) < len(raw) else b"\0" + raw


def decompress(data: bytes, most: int) -> bytes:
    """The bytes behind compress, refused above most."""
    import zstandard

    if data[:1] == b"\0":
        raw = data[1:]
    elif data[:1] == b"\1":
        size = zstandard.frame_content_size(data[1:])
        if size < 0 or size > most:
            raise Malformed("the content is larger than allowed")
        raw = zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=max(1, size))
    else:
        raise Malformed("no tag of a frame")
    if len(raw) > most:
        raise Malformed("the content is larger than allowed")
    return raw
