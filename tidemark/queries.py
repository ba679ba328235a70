"""The table engine's operators as queries over logs of the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.keys import entry_bytes
from .model import UNBOUNDED, Bound, KeyRange, LeveledOptions, excluded, included
from .operators import merge
from .plans.compaction import Levels, pick
from .store import fill_ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The event log as operations: a user's newest event is its value, an error deletes it.
_EVENTS = """oplog AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq,
    CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '@' || CAST(event_id AS VARCHAR) END AS value FROM events)"""
_LATEST = _EVENTS + """, latest AS (SELECT key, seq, value FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM oplog) WHERE r = 1)"""
_CUTS = _EVENTS + """, cut AS (SELECT (n * 40) // 100 AS c1, (n * 70) // 100 AS c2, (n * 90) // 100 AS c3 FROM (SELECT count(*) AS n FROM events)),
    placed AS (SELECT o.*, row_number() OVER (ORDER BY seq) AS p FROM oplog o),
    layer AS (SELECT key, seq, value, CASE WHEN p > c3 THEN 0 WHEN p > c2 THEN 1 WHEN p > c1 THEN 2 ELSE 3 END AS prio FROM placed, cut),
    runs AS (SELECT key, seq, value, prio FROM (SELECT *, row_number() OVER (PARTITION BY key, prio ORDER BY seq DESC) AS r FROM layer) WHERE r = 1)"""


def query(name: str, sql: str):
    """Registers a query and its SQL."""

    def add(function):
        QUERIES[name], ORACLE_SQL[name] = function, sql
        return function

    return add


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, seq, value) of the event log, keys and values as text."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_type") != "error", F.concat_ws("@", "event_type", F.col("event_id").cast("string")))
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), value.alias("value"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in four layers: prio 0 (newest tenth, in memory), 1 and 2 (level 0), 3 (oldest, level 1)."""
    entries = ranked(oplog(spark, sf_dir), "seq")
    n = entries.count()
    p = F.col("rank")
    prio = F.when(p > n * 90 // 100, 0).when(p > n * 70 // 100, 1).when(p > n * 40 // 100, 2).otherwise(3)
    return entries.withColumn("prio", prio).drop("rank")


def ranked(rows: DataFrame, column: str, width: int = 4096) -> DataFrame:
    """rows with their rank (from 1) by a whole number without repeats: counts of ranges of numbers, then a rank in each range."""
    bucket = F.floor(F.col(column) / width)
    rows = rows.withColumn("bucket", bucket)
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    counts = rows.groupBy("bucket").agg(F.count("*").alias("c")).select("bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(W.partitionBy("bucket").orderBy(column))
    return rows.join(counts, "bucket").withColumn("rank", F.col("offset") + inner).drop("bucket", "offset")


def runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Each layer with one entry for each key."""
    entries = layers(spark, sf_dir)
    return [merge.latest(entries.where(F.col("prio") == i)) for i in range(4)]


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("key", "value")


@query("kv_latest", f"WITH {_LATEST} SELECT * FROM latest")
def kv_latest(spark, sf_dir):
    """The newest entry of each key, tombstones as null."""
    return merge.latest(oplog(spark, sf_dir))


@query("kv_scan_full", f"WITH {_LATEST} SELECT key, value FROM latest WHERE value IS NOT NULL")
def kv_scan_full(spark, sf_dir):
    """All live rows in key order."""
    return merge.in_order(_pairs(merge.live(oplog(spark, sf_dir))))


def _range(lower: Bound, upper: Bound):
    def run(spark, sf_dir):
        return merge.in_order(_pairs(merge.live(merge.bounded(oplog(spark, sf_dir), KeyRange(lower, upper)))))

    return run


for _name, _lower, _upper, _where in (
    ("ii", included("10"), included("15"), "key >= '10' AND key <= '15'"),
    ("ie", included("10"), excluded("15"), "key >= '10' AND key < '15'"),
    ("ei", excluded("10"), included("15"), "key > '10' AND key <= '15'"),
    ("ee", excluded("10"), excluded("15"), "key > '10' AND key < '15'"),
    ("lo", included("12"), UNBOUNDED, "key >= '12'"),
    ("lo_ex", excluded("12"), UNBOUNDED, "key > '12'"),
    ("hi", UNBOUNDED, included("12"), "key <= '12'"),
    ("hi_ex", UNBOUNDED, excluded("12"), "key < '12'"),
    ("empty_range", included("10!"), included("10!!"), "key >= '10!' AND key <= '10!!'"),
    ("inverted", included("15"), included("10"), "key >= '15' AND key <= '10'"),
):
    query(f"kv_scan_{_name}", f"WITH {_LATEST} SELECT key, value FROM latest WHERE value IS NOT NULL AND {_where}")(_range(_lower, _upper))


@query("kv_scan_text_order", f"WITH {_LATEST} SELECT key, value, length(key) > 2 AS inner_key FROM latest WHERE value IS NOT NULL AND key >= '10' AND key <= '15'")
def kv_scan_text_order(spark, sf_dir):
    """Keys of a range as text: '100' lies between '10' and '15'."""
    return _range(included("10"), included("15"))(spark, sf_dir).withColumn("inner_key", F.length("key") > 2)


def _get(key: str):
    def run(spark, sf_dir):
        return _pairs(merge.live(merge.bounded(oplog(spark, sf_dir), KeyRange(included(key), included(key)))))

    return run


for _name, _key in (("hit", "7"), ("miss", "no such key"), ("other", "12")):
    query(f"kv_get_{_name}", f"WITH {_LATEST} SELECT key, value FROM latest WHERE value IS NOT NULL AND key = '{_key}'")(_get(_key))


@query("kv_get_deleted", f"WITH {_LATEST}, d AS (SELECT min(key) AS k FROM latest WHERE value IS NULL) SELECT count(*) AS found FROM latest, d WHERE key = k AND value IS NOT NULL")
def kv_get_deleted(spark, sf_dir):
    """A deleted key is not found."""
    newest = merge.latest(oplog(spark, sf_dir))
    gone = newest.where(F.col("value").isNull()).agg(F.min("key").alias("k"))
    hit = newest.join(gone, newest["key"] == gone["k"], "left_semi")
    return hit.agg(F.count("value").alias("found"))


@query("kv_multi_get", f"WITH {_LATEST} SELECT c.key, l.value FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer) c LEFT JOIN latest l ON l.key = c.key")
def kv_multi_get(spark, sf_dir):
    """The live values of many keys in one join."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return merge.multi_get(keys, oplog(spark, sf_dir))


@query("kv_merge_priority", f"WITH {_CUTS} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio) AS r FROM runs) WHERE r = 1")
def kv_merge_priority(spark, sf_dir):
    """Four layers, the first that holds a key wins, with an empty layer among them."""
    parts = [_pairs(r) for r in runs(spark, sf_dir)]
    return merge.merge_priority([*parts[:2], parts[0].limit(0), *parts[2:]])


@query("kv_merge_two", f"WITH {_CUTS} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio) AS r FROM runs WHERE prio IN (1, 2)) WHERE r = 1")
def kv_merge_two(spark, sf_dir):
    """Two layers, the left wins, tombstones too."""
    parts = runs(spark, sf_dir)
    return merge.merge_two(_pairs(parts[1]), _pairs(parts[2]))


@query("kv_layered_scan", f"WITH {_LATEST} SELECT key, value FROM latest WHERE value IS NOT NULL")
def kv_layered_scan(spark, sf_dir):
    """Layers give what the whole log gives."""
    return _pairs(merge.live(merge.union_layers(runs(spark, sf_dir))))


@query("kv_level_concat", f"WITH {_LATEST} SELECT key, value FROM latest")
def kv_level_concat(spark, sf_dir):
    """A level of files with disjoint ranges: no merge."""
    newest = _pairs(merge.latest(oplog(spark, sf_dir)))
    cuts = [KeyRange(UNBOUNDED, excluded("3")), KeyRange(included("3"), excluded("6")), KeyRange(included("6"), UNBOUNDED)]
    return merge.concat_level([merge.bounded(newest, c) for c in cuts])


@query("kv_delete_only", f"WITH {_LATEST} SELECT key, seq FROM latest WHERE value IS NULL")
def kv_delete_only(spark, sf_dir):
    """Keys whose newest entry is a tombstone."""
    return merge.latest(oplog(spark, sf_dir)).where(F.col("value").isNull()).select("key", "seq")


@query("kv_delete_then_put", f"WITH {_LATEST} SELECT key, value FROM latest l WHERE value IS NOT NULL AND EXISTS (SELECT 1 FROM oplog o WHERE o.key = l.key AND o.value IS NULL AND o.seq < l.seq)")
def kv_delete_then_put(spark, sf_dir):
    """Live keys that had been deleted before."""
    entries = oplog(spark, sf_dir)
    whole = entries.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max(F.when(F.col("value").isNull(), F.col("seq"))).alias("gone"))
    return whole.where(F.col("value").isNotNull() & F.col("gone").isNotNull()).select("key", "value")


@query(
    "kv_update_if_exists",
    f"""WITH {_LATEST}, u AS (SELECT CAST(c_custkey AS VARCHAR) AS key, 1000000000 + c_custkey AS seq, 'new' || CAST(c_custkey AS VARCHAR) AS value FROM customer)
    SELECT l.key, coalesce(u.value, l.value) AS value FROM latest l LEFT JOIN u ON u.key = l.key WHERE l.value IS NOT NULL""",
)
def kv_update_if_exists(spark, sf_dir):
    """Updates reach live keys only."""
    entries, key = oplog(spark, sf_dir), F.col("c_custkey")
    updates = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.cast("string").alias("key"), (F.lit(1_000_000_000) + key).alias("seq"), F.concat(F.lit("new"), key.cast("string")).alias("value"))
    return _pairs(merge.live(merge.apply_updates(entries, updates)))


@query("kv_fill", "SELECT CAST(i AS VARCHAR) AS key, 'value' || CAST(i AS VARCHAR) || '@7' AS value FROM range(100, 201) t(i)")
def kv_fill(spark, sf_dir):
    """Filling 100..200 in epoch 7, both ends included."""
    return fill_ops(spark, 100, 200, 7).select("key", "value")


@query("kv_write_batch_order", f"WITH {_EVENTS} SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM oplog WHERE value IS NOT NULL) WHERE r = 1")
def kv_write_batch_order(spark, sf_dir):
    """A batch of puts with repeated keys: the last position wins."""
    batch = oplog(spark, sf_dir).where(F.col("value").isNotNull())
    return _pairs(merge.latest(batch))


_MEMTABLE = 1000


@query(
    "kv_memtable_bytes",
    f"""WITH {_EVENTS} SELECT seq // {_MEMTABLE} AS memtable, CAST(sum(length(key) + length(coalesce(value, ''))) AS BIGINT) AS bytes, count(*) AS writes FROM oplog GROUP BY 1""",
)
def kv_memtable_bytes(spark, sf_dir):
    """Bytes written to each memtable of a thousand writes, overwrites counted."""
    size = entry_bytes(F.col("key"), F.col("value"))
    return oplog(spark, sf_dir).groupBy(F.expr(f"seq div {_MEMTABLE}").alias("memtable")).agg(F.sum(size).alias("bytes"), F.count("*").alias("writes"))


@query(
    "kv_flush_runs",
    f"""WITH {_EVENTS}, r AS (SELECT *, seq // {_MEMTABLE} AS run FROM oplog),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS x FROM r) WHERE x = 1)
    SELECT run, count(*) AS entries, count(*) - count(value) AS tombstones, min(key) AS first_key, max(key) AS last_key FROM d GROUP BY run""",
)
def kv_flush_runs(spark, sf_dir):
    """The files that flushing gives: one entry per key and run, tombstones kept."""
    entries = oplog(spark, sf_dir).withColumn("run", F.expr(f"seq div {_MEMTABLE}"))
    newest = entries.groupBy("run", "key").agg(F.max_by("value", "seq").alias("value"))
    return newest.groupBy("run").agg(F.count("*").alias("entries"), F.count(F.when(F.col("value").isNull(), 1)).alias("tombstones"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query("kv_compact_mid", f"WITH {_CUTS} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM runs WHERE prio IN (1, 2)) WHERE r = 1")
def kv_compact_mid(spark, sf_dir):
    """A merge above the bottom keeps tombstones and seq."""
    parts = runs(spark, sf_dir)
    return merge.latest(merge.union_layers(parts[1:3]))


@query("kv_compact_bottom", f"WITH {_CUTS} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM runs WHERE prio > 0) WHERE r = 1 AND value IS NOT NULL")
def kv_compact_bottom(spark, sf_dir):
    """A merge into the bottom level drops tombstones."""
    return merge.live(merge.union_layers(runs(spark, sf_dir)[1:]))


@query("kv_compact_full", f"WITH {_LATEST} SELECT key, seq, value FROM latest WHERE value IS NOT NULL")
def kv_compact_full(spark, sf_dir):
    """Everything merged, no tombstone left."""
    return merge.live(merge.union_layers(runs(spark, sf_dir)))


_FILES = f"{_EVENTS}, f AS (SELECT seq // 1000 AS file, min(key) AS first_key, max(key) AS last_key, count(DISTINCT key) AS entries FROM oplog GROUP BY 1)"


def _files(spark, sf_dir):
    parts = oplog(spark, sf_dir).groupBy(F.expr("seq div 1000").alias("file"), "key").agg(F.lit(1))
    return parts.groupBy("file").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("entries"))


@query("kv_file_prune", f"WITH {_FILES} SELECT file, first_key, last_key, entries, last_key >= '12' AND first_key < '2' AS needed FROM f")
def kv_file_prune(spark, sf_dir):
    """Which files a range from '12' to below '2' has to read."""
    return _files(spark, sf_dir).withColumn("needed", (F.col("last_key") >= "12") & (F.col("first_key") < "2"))


@query("kv_key_within", f"WITH {_FILES} SELECT file, first_key <= '42' AND '42' <= last_key AS may_hold FROM f")
def kv_key_within(spark, sf_dir):
    """Which files may hold a key."""
    return _files(spark, sf_dir).select("file", ((F.col("first_key") <= "42") & (F.col("last_key") >= "42")).alias("may_hold"))


@query(
    "kv_level_invariant",
    f"WITH {_FILES} SELECT count(*) AS files, count(*) FILTER (last_key < first_key) AS reversed, CAST(coalesce(sum(CAST(prev >= first_key AS INT)), 0) AS BIGINT) AS overlaps FROM (SELECT *, lag(last_key) OVER (ORDER BY first_key, file) AS prev FROM f)",
)
def kv_level_invariant(spark, sf_dir):
    """How often neighbouring files overlap if flushed runs were called a level (a row for each file)."""
    before = F.lag("last_key").over(W.orderBy("first_key", "file"))
    files = _files(spark, sf_dir).withColumn("prev", before)
    return files.agg(F.count("*").alias("files"), F.count(F.when(F.col("last_key") < F.col("first_key"), 1)).alias("reversed"), F.count(F.when(F.col("prev") >= F.col("first_key"), 1)).alias("overlaps"))


_SHAPES = [(1, (0, 0, 0)), (2, (0, 0, 0)), (2, (4, 0, 0)), (2, (3, 9, 0)), (0, (4, 7, 0)), (0, (0, 5, 9)), (0, (0, 0, 7)), (3, (6, 12, 24)), (3, (5, 10, 20))]


def _shape_sql() -> str:
    rows = ", ".join(f"({i}, {a}, {b}, {c}, {d})" for i, (a, (b, c, d)) in enumerate(_SHAPES))
    small = lambda low, up: f"{up} > 0 AND 100 * {low} < 200 * {up}"
    return f"""SELECT shape, CASE WHEN l0 >= 2 AND {small("l1", "l0")} THEN 0 WHEN {small("l2", "l1")} THEN 1 WHEN {small("l3", "l2")} THEN 2 ELSE -1 END AS upper
        FROM (VALUES {rows}) t(shape, l0, l1, l2, l3)"""


@query("kv_compaction_pick", _shape_sql())
def kv_compaction_pick(spark, sf_dir):
    """What the policy merges for some level sizes; -1: nothing."""
    rows = []
    for i, (zero, deeper) in enumerate(_SHAPES):
        names = [tuple(f"{level}-{k}" for k in range(n)) for level, n in enumerate((zero, *deeper))]
        task = pick(Levels(names[0], tuple(names[1:])), LeveledOptions(200, 2, 3))
        rows.append((i, task.upper if task else -1))
    return spark.createDataFrame(rows, "shape int, upper int")


@query("kv_scan_count", f"WITH {_LATEST} SELECT count(*) AS keys FROM latest WHERE value IS NOT NULL AND key >= '10' AND key <= '15'")
def kv_scan_count(spark, sf_dir):
    """Live keys of a range."""
    return _range(included("10"), included("15"))(spark, sf_dir).agg(F.count("*").alias("keys"))


@query("kv_first_n", f"WITH {_LATEST} SELECT key, value FROM latest WHERE value IS NOT NULL ORDER BY key LIMIT 10")
def kv_first_n(spark, sf_dir):
    """The ten live rows with the least keys."""
    return merge.first_n(_pairs(merge.live(oplog(spark, sf_dir))), 10)


@query("kv_keys_only", f"WITH {_LATEST} SELECT DISTINCT key FROM oplog")
def kv_keys_only(spark, sf_dir):
    """Keys that were ever written; values aren't read."""
    return merge.without_values(oplog(spark, sf_dir)).distinct()


@query("kv_wal_replay", f"WITH {_CUTS} SELECT key, seq, value FROM runs WHERE prio = 0")
def kv_wal_replay(spark, sf_dir):
    """What replaying the unflushed tail of the log gives."""
    return runs(spark, sf_dir)[0]


@query("kv_bloom_probe", f"WITH {_LATEST} SELECT p.key, l.seq IS NOT NULL AS present FROM (SELECT CAST(i * 7 AS VARCHAR) AS key FROM range(0, 300) t(i)) p LEFT JOIN latest l ON l.key = p.key")
def kv_bloom_probe(spark, sf_dir):
    """Exact membership of probe keys."""
    probes = spark.range(300).select((F.col("id") * 7).cast("string").alias("key"))
    return probes.join(merge.latest(oplog(spark, sf_dir)), "key", "left").select("key", F.col("seq").isNotNull().alias("present"))


_LINE_ORDER = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items as operations on (order, line): seq is the tuple of all other columns, a returned item deletes."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit(":"), F.col("l_linenumber").cast("string"))
    seq = F.struct(*_LINE_ORDER.split(", "))
    return items.select(key.alias("key"), seq.alias("seq"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("value"))


@query(
    "kv_lineitem_upsert",
    f"""WITH o AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || ':' || CAST(l_linenumber AS VARCHAR) AS key, l_partkey, l_returnflag,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + " DESC" for c in _LINE_ORDER.split(", "))}) AS r FROM lineitem)
    SELECT key, l_partkey AS value FROM o WHERE r = 1 AND l_returnflag <> 'R'""",
)
def kv_lineitem_upsert(spark, sf_dir):
    """Live rows of the line-item log."""
    return _pairs(merge.live(lineitem_log(spark, sf_dir)))


@query("kv_lineitem_range", ORACLE_SQL["kv_lineitem_upsert"] + " AND key >= '0000000100:1' AND key < '0000000200:1'")
def kv_lineitem_range(spark, sf_dir):
    """A key range of it."""
    return _pairs(merge.live(merge.bounded(lineitem_log(spark, sf_dir), KeyRange(included("0000000100:1"), excluded("0000000200:1")))))


from . import table_queries as _table_queries  # noqa: E402, F401  (registers its queries here)
