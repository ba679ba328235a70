"""Column functions for keys: order-preserving encodings, entry sizes, bloom filter sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_long(column: Column) -> Column:
    """A long as eight bytes that sort as the numbers do (text would put 1000 before 150)."""
    flipped = column.cast("long").bitwiseXOR(F.expr("-9223372036854775807L - 1L"))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def decode_long(column: Column) -> Column:
    """The inverse of encode_long()."""
    # conv() reads an unsigned number; negative longs come back through their decimal form
    unsigned = F.conv(F.hex(column), 16, 10).cast("decimal(20,0)")
    return (unsigned - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def entry_bytes(key: Column, value: Column) -> Column:
    """What an entry counts in a memtable: the bytes of key and value; a tombstone has no value."""
    return F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))


def bloom_bits_per_key(entries: int, fpp: float) -> int:
    """Bits for each key of a bloom filter with the given rate of false positives."""
    if not 0 < fpp < 1:
        raise ValueError("a rate lies between 0 and 1")
    total = -entries * math.log(fpp) / math.log(2) ** 2
    return math.ceil(total / max(1, entries))


def bloom_hashes(bits_per_key: int) -> int:
    """How many bits such a filter sets for a key."""
    return min(30, max(1, round(bits_per_key * math.log(2) - 0.5)))
