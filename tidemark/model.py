"""Schema, options and key bounds of a table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The stored record. A null value is a tombstone; seq grows with every write.
RECORD = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("value", T.BinaryType(), True)])

MAX_LENGTH = 65_535
#: seq = commit version << SEQ_BITS | position in the batch.
SEQ_BITS = 32


@dataclass(frozen=True)
class LeveledOptions:
    """Simple-leveled compaction: ratio between neighbouring levels, level-0 trigger, depth."""

    size_ratio_percent: int = 200
    level0_trigger: int = 2
    max_levels: int = 4


@dataclass(frozen=True)
class TableOptions:
    """Sizes and policies of a table; ``compaction`` is None or LeveledOptions."""

    block_size: int = 4096
    target_file_size: int = 2 << 20
    memtable_limit: int = 50
    compaction: LeveledOptions | None = None
    enable_wal: bool = False
    bloom_fpp: float = 0.01

    @classmethod
    def plain(cls) -> TableOptions:
        """Large memtable limit, no compaction."""
        return cls()

    @classmethod
    def small_buffers(cls) -> TableOptions:
        """Two frozen memtables at most, no compaction."""
        return cls(memtable_limit=2)

    @classmethod
    def compacting(cls, compaction: LeveledOptions | None) -> TableOptions:
        """Small files, two memtables and the given compaction."""
        return cls(target_file_size=1 << 20, memtable_limit=2, compaction=compaction)

    @classmethod
    def shell(cls, compaction: LeveledOptions | None, enable_wal: bool) -> TableOptions:
        """What the shell opens tables with."""
        return cls(memtable_limit=3, compaction=compaction, enable_wal=enable_wal)


@dataclass(frozen=True)
class Bound:
    """One end of a key range: a key and whether it belongs to the range; no key is no end."""

    key: bytes | None = None
    inclusive: bool = True


UNBOUNDED = Bound()


def included(key: bytes | str) -> Bound:
    """A bound that belongs to the range."""
    return Bound(to_key(key), True)


def excluded(key: bytes | str) -> Bound:
    """A bound that doesn't."""
    return Bound(to_key(key), False)


def to_key(key: bytes | str) -> bytes:
    """Keys are bytes; text is its UTF-8."""
    return key.encode() if isinstance(key, str) else bytes(key)


@dataclass(frozen=True)
class KeyRange:
    """Keys between two bounds."""

    lower: Bound = field(default=UNBOUNDED)
    upper: Bound = field(default=UNBOUNDED)

    def condition(self, column: Column, text: bool = False) -> Column | None:
        """The range as a filter that reaches the Parquet scan; None if it has no end.

        text: the column is a string, which is compared with strings (a cast would keep
        the filter from the scan) unless a key isn't UTF-8.
        """

        def literal(key: bytes) -> Column:
            try:
                return F.lit(key.decode() if text else key)
            except UnicodeDecodeError:
                return F.lit(key)

        out = None
        for bound, closed, open_ in ((self.lower, Column.__ge__, Column.__gt__), (self.upper, Column.__le__, Column.__lt__)):
            if bound.key is not None:
                part = (closed if bound.inclusive else open_)(column, literal(bound.key))
                out = part if out is None else out & part
        return out

    def holds(self, key: bytes) -> bool:
        """Whether a key lies in the range."""
        low, high = self.lower, self.upper
        if low.key is not None and (key < low.key or key == low.key and not low.inclusive):
            return False
        return high.key is None or key < high.key or key == high.key and high.inclusive

    def overlaps(self, first: bytes, last: bytes) -> bool:
        """Whether the range may hold a key of first..last."""
        low, high = self.lower, self.upper
        if high.key is not None and (first > high.key or first == high.key and not high.inclusive):
            return False
        return low.key is None or last > low.key or last == low.key and low.inclusive


def check_record(key: bytes, value: bytes | None) -> None:
    """Raises ValueError for keys and values that a table doesn't take."""
    if not 0 < len(key) <= MAX_LENGTH:
        raise ValueError(f"a key has 1 to {MAX_LENGTH} bytes")
    if value is not None and not 0 < len(value) <= MAX_LENGTH:
        raise ValueError(f"a value has 1 to {MAX_LENGTH} bytes; delete() removes a key")
