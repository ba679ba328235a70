"""What the corpus operators share: exact column access, staged tables, sliced Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)

#: Text bytes that a Python worker holds at once, besides a single longer row.
SLICE_BYTES = 1 << 20


#: Bytes of a batch that goes to a Python worker (a single longer row goes alone). A batch is held several
#: times over: as it is built, as it is read, and in what is computed of it.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds what Python workers are sent at once, unless the session has a bound of its own."""
    if spark.conf.get(_BATCH_CONF, None) == "67108864b":  # Spark's default
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark has to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to the given types, whatever else the table holds.

    Names match exactly first (a table may hold both ``text`` and ``TEXT``), then
    without case; of columns with the same name the first counts. A column that is
    absent is null.
    """
    bound_batches(df.sparkSession)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*_picked(df.columns, columns))


def column_at(names: list[str], name: str) -> int | None:
    """Which of the columns a name means, as pick() says."""
    lower = [c.lower() for c in names]
    return names.index(name) if name in names else lower.index(name) if name in lower else None


def _picked(names: list[str], columns: dict[str, str]) -> list[Column]:
    """The columns of pick(), of a frame whose columns are called c0, c1, ..."""
    out = []
    for name, kind in columns.items():
        at = column_at(names, name)
        out.append((F.lit(None) if at is None else F.col(f"c{at}")).cast(kind).alias(name))
    return out


#: Files of a scan whose places in the list of all files are sent to every task; beyond, rows are written with their numbers.
MANY_FILES = 100_000


def _scanned(df: DataFrame) -> bool:
    """Whether df is a scan of Parquet files and nothing else, whose rows have places of their own."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().toString() == "Parquet" and "_metadata" not in (c.lower() for c in df.columns)


def with_numbers(df: DataFrame, label: str = "numbered") -> DataFrame:
    """df's columns as c0, c1, ... and n, a number that a row keeps in whatever job and plan reads it.

    A scan of Parquet files is numbered by file and place in the file, without a copy:
    numbers that Spark gives out by partition change when executors come or go between
    two jobs, as a scan is cut for the cores there are. Any other plan is written once,
    with its numbers, to the shared folder.
    """
    bound_batches(df.sparkSession)
    names = [f"c{i}" for i in range(len(df.columns))]
    if _scanned(df):
        row = F.col("_metadata.row_index")
        placed = df.select("*", F.col("_metadata.file_path"), row).toDF(*names, "file", "row")
        listed = [r[0] for r in placed.select("file").distinct().limit(MANY_FILES + 1).collect()]
        if len(listed) <= MANY_FILES:
            ranks = df.sparkSession.createDataFrame(list(enumerate(sorted(listed))), "rank long, file string")
            return placed.join(F.broadcast(ranks), "file").select(*names, (F.shiftleft("rank", 40) + F.col("row")).alias("n"))
    return stage(df.toDF(*names).withColumn("n", F.monotonically_increasing_id()), label)


def numbered(df: DataFrame, **columns: str) -> DataFrame:
    """pick() of the columns, and n as with_numbers() gives it."""
    if _scanned(df):
        return with_numbers(df).select(*_picked(df.columns, columns), "n")
    return stage(pick(df, **columns).withColumn("n", F.monotonically_increasing_id()), "numbered")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; set here only where it is unset, on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, executors may be lost."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot where one in so many rows has it: there are fewer such keys than this.
HOT = 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], times: str = "times") -> DataFrame:
    """rows joined with counted, which has one row for each key and in ``times`` how many rows have it.

    Hot keys are fewer than HOT by their count, so that part of counted is broadcast and
    the rows with them stay where they are; the other rows are shuffled by key. Both
    frames are read more than once: stage() them.
    """
    total = counted.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) * HOT > total
    some, rest = F.broadcast(counted.where(hot)), counted.where(~hot)
    cold = rows.join(some.select(*([key] if isinstance(key, str) else key)), key, "left_anti")
    return rows.join(some, key).drop(times).unionByName(cold.join(rest, key).drop(times))


def join_salted(rows: DataFrame, counted: DataFrame, key: list[str], number: str = "n", times: str = "times") -> DataFrame:
    """join_counted() where counted is too wide to be broadcast: of its hot rows there are copies.

    A key that one in HOT rows has gets a copy for each such share, fewer than 2 * HOT copies
    in all; the rows are dealt over the copies by their ``number``. What is broadcast are the
    hot keys alone. Both frames are read more than once: stage() them.
    """
    total = counted.agg(F.sum(times)).first()[0] or 0
    copies = F.ceil(F.col(times) * HOT / max(total, 1)).cast("int")
    hot = counted.where(F.col(times) * HOT > total).select(*key, copies.alias("copies"))
    dealt = F.coalesce(F.pmod(F.xxhash64(number), F.col("copies")), F.lit(0)).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("salt", dealt).drop("copies")
    right = counted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))).drop(times)
    return left.join(right, [*key, "salt"]).drop("salt")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's values in each take about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.binary_length(values).fill_null(0)).astype(np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def over_text(df: DataFrame, rows: Callable, schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """df through ``rows(batch) -> RecordBatch``, over slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, limit):
            yield rows(part)
        release()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that a finished task leaves free back to the system: workers are used again by other operators."""
    if len(_powers[0]) > POWERS:
        _powers[:] = [table[:POWERS].copy() for table in _powers]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The powers are made by so many, and up to so many are kept from task to task.
POWERS = 1 << 16
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (the base is odd)."""
    if len(_powers[0]) < n:
        m = -(-n // POWERS) * POWERS
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            factors = np.full(m, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


#: A 64-bit value for each byte, so that near bytes don't give near sums.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span, from prefix sums of a polynomial."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``inside`` (256 flags) holds."""
    edge = np.diff(inside[data].astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
