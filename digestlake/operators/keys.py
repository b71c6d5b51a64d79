"""Identities as short bytes, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType

_HEX = "^[0-9a-f]{64}$"
_NONE = "01" * 33


def packed(value: str | Column, kind: DataType | None = None) -> Column:
    """value, of type kind (a string if it is not given), as bytes that are equal only for equal values; null has bytes
    of its own. A digest in hex takes 32 bytes, another text of up to 31 bytes its own, a longer one a byte more."""
    c = F.col(value) if isinstance(value, str) else value
    if isinstance(kind, BinaryType):
        c = F.lower(F.hex(c))
    elif kind is not None and not isinstance(kind, StringType):
        c = c.cast("string")
    raw = c.cast("binary")
    own = F.when(F.octet_length(c) < 32, raw).otherwise(F.concat(raw, F.unhex(F.lit("00"))))
    return F.when(c.isNull(), F.unhex(F.lit(_NONE))).when(c.rlike(_HEX), F.unhex(c)).otherwise(own)


def unpacked(value: str | Column, kind: DataType | None = None) -> Column:
    """What packed was given."""
    b = F.col(value) if isinstance(value, str) else value
    size = F.octet_length(b)
    long = F.when(b != F.unhex(F.lit(_NONE)), F.substring(b, F.lit(1), size - 1).cast("string"))
    text = F.when(size == 32, F.lower(F.hex(b))).when(size < 32, b.cast("string")).otherwise(long)
    if isinstance(kind, BinaryType):
        return F.unhex(text)
    return text if kind is None or isinstance(kind, StringType) else text.cast(kind)
