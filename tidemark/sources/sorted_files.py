"""Key-sorted Parquet files with a bloom filter on the key."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import bloom_bits_per_key, entry_bytes
from ..model import RECORD, TableOptions
from .manifest import FileEntry

DATA = "data"
#: Files of a table with a smaller target lie together in Parquet files of this size.
PACK_BYTES = 1 << 20
#: What a record takes besides key and value: seq and two lengths.
RECORD_BYTES = 16
#: So many different shifts are read by scans of their own; more by one scan with a list of files and shifts.
MANY_SHIFTS = 16


def write(entries: DataFrame, files, options: TableOptions, rows: int, size: int) -> list[FileEntry]:
    """Entries (unique keys) written in files with disjoint key ranges of about target_file_size.

    rows and size (bytes) are estimates, too high where rows are merged or dropped; they
    set the number of Parquet files. The files are no part of the table until a commit
    names them. Of the written rows key and seq are read again, for the files' ranges, and
    the values where several files lie in one Parquet file, which is cut by their sizes.
    """
    if not rows:
        return []
    folder = f"{DATA}/{uuid.uuid4().hex}"
    target = options.target_file_size
    packed = target < PACK_BYTES
    count = max(1, -(-size // max(target, PACK_BYTES)))
    dealt = entries.coalesce(1) if count == 1 else entries.repartitionByRange(count, "key")
    _writer(dealt.sortWithinPartitions("key").select("key", "seq", "value"), options, -(-rows // count)).parquet(files.url(folder))
    stats = entries.sparkSession.read.schema(RECORD).parquet(files.url(folder)).select("*", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes"))
    by = ["name", "bytes"]
    if packed:
        before = F.sum("size").over(W.partitionBy("name").orderBy("key").rowsBetween(W.unboundedPreceding, -1))
        stats = stats.select("key", "seq", "name", (entry_bytes(F.col("key"), F.col("value")) + RECORD_BYTES).cast("long").alias("size"))
        stats = stats.withColumn("cut", F.floor(F.coalesce(before, F.lit(0)) / target))
        by = ["name", "cut"]
    measures = [F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high")]
    found = stats.groupBy(*by).agg(*measures, *([F.sum("size").alias("bytes")] if packed else [])).collect()  # a row for each file
    out = [FileEntry(f"{folder}/{r['name']}" + (f"#{r['cut']}" if packed else ""), bytes(r["first"]), bytes(r["last"]), r["rows"], r["bytes"], r["low"], r["high"]) for r in found]
    return sorted(out, key=lambda e: e.first)


def write_runs(spark: SparkSession, runs: list[list[tuple[bytes, int, bytes | None]]], files, options: TableOptions) -> list[FileEntry]:
    """A file of each run of (key, seq, value) with unique keys, all written by one task; in the order of the runs, without empty ones."""
    runs = [sorted(run) for run in runs if run]
    if not runs:
        return []
    folder = f"{DATA}/{uuid.uuid4().hex}"
    rows = [(i, *row) for i, run in enumerate(runs) for row in run]
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("run", T.IntegerType(), False), *RECORD.fields]))
    frame = frame.coalesce(1).sortWithinPartitions("run", "key")
    _writer(frame, options, max(map(len, runs))).partitionBy("run").parquet(files.url(folder))
    out = []
    for i, run in enumerate(runs):
        place = f"{folder}/run={i}"
        (name,) = [n for n in files.list(place) if n.endswith(".parquet")]
        size = sum(len(k) + len(v or b"") + RECORD_BYTES for k, _, v in run)
        out.append(FileEntry(f"{place}/{name}", run[0][0], run[-1][0], len(run), size, min(s for _, s, _ in run), max(s for _, s, _ in run)))
    return out


def _writer(sorted_: DataFrame, options: TableOptions, keys: int) -> DataFrameWriter:
    """The writer of sorted rows, about ``keys`` of them a file."""
    writer = sorted_.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(options.bloom_fpp))
    keys = max(64, keys)
    limit = max(1 << 20, keys * bloom_bits_per_key(keys, options.bloom_fpp) // 4)  # twice what the rate takes: filters are powers of two
    writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(keys)).option("parquet.bloom.filter.max.bytes", str(limit))
    return writer.option("parquet.page.size", str(max(1024, options.block_size))).option("parquet.page.row.count.limit", "2000")


def read(spark: SparkSession, files, entries: list[FileEntry]) -> DataFrame:
    """The rows of the Parquet files that some files lie in, seq as the table counts it.

    Beside the rows of a file these are rows of others of its commit and level, in their own key ranges.
    """
    if not entries:
        return spark.createDataFrame([], RECORD)
    shifts = {e.path: e.shift for e in entries}
    by_shift: dict[int, list[str]] = {}
    for path, shift in shifts.items():
        by_shift.setdefault(shift, []).append(files.url(path))
    if len(by_shift) > MANY_SHIFTS:  # a plan with a scan for each would take longer to make than to run
        rows = spark.read.schema(RECORD).parquet(*map(files.url, shifts))
        placed = rows.withColumn("path", F.regexp_extract("_metadata.file_path", f"({DATA}/[0-9a-f]{{32}}/.*)$", 1))
        listed = spark.createDataFrame(list(shifts.items()), "path string, shift long")
        return placed.join(F.broadcast(listed), "path").select("key", (F.col("seq") + F.col("shift")).alias("seq"), "value")
    parts = []
    for shift, urls in sorted(by_shift.items()):
        rows = spark.read.schema(RECORD).parquet(*urls)
        parts.append(rows.withColumn("seq", F.col("seq") + F.lit(shift)) if shift else rows)
    return reduce(DataFrame.unionByName, parts)
