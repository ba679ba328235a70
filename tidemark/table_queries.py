"""Queries that run on a table: each builds one in a fresh shared folder from a log of the test tables, and reads it."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import decode_long, encode_long
from .model import KeyRange, LeveledOptions, TableOptions, excluded, included
from .queries import _CUTS, _EVENTS, _LATEST, query, ranked
from .shell import Shell
from .sources.scratch import scratch_path
from .store import Memtable, Table, open_table
from .streaming.ingest import stream_into

#: Small files, so that a table of the test size has several of them in a level.
SMALL = TableOptions(target_file_size=2048, compaction=LeveledOptions(200, 2, 3))
_LIVE = f"WITH {_LATEST} SELECT key, value FROM latest WHERE value IS NOT NULL"
#: Single writes go through the driver; so many a chunk.
CHUNK = 1000


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as operations: a user's event puts, an error deletes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("key"), F.concat_ws("@", "event_type", F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("pos"))


def parts(spark: SparkSession, sf_dir: str, n: int) -> list[DataFrame]:
    """The log cut in n batches, oldest first. It is ranked once, for the places where batches begin."""
    log = ops(spark, sf_dir)
    count = log.count()
    size = max(1, -(-count // n))
    begins = [r["pos"] for r in ranked(log, "pos").where((F.col("rank") - 1) % size == 0).orderBy("pos").select("pos").collect()]
    out = []
    for i in range(n):
        part = log.where(F.col("pos") >= begins[i]) if i < len(begins) else log.where(F.lit(False))
        out.append(part.where(F.col("pos") < begins[i + 1]) if i + 1 < len(begins) else part)
    return out


def fresh(spark: SparkSession, label: str, options: TableOptions = SMALL) -> Table:
    """An empty table."""
    return open_table(spark, scratch_path(spark, label), options)


def loaded(spark: SparkSession, sf_dir: str, label: str, batches: int = 3, options: TableOptions = SMALL) -> Table:
    """A table with the log in it, a commit for each batch."""
    table = fresh(spark, label, options)
    for part in parts(spark, sf_dir, batches):
        table.ingest(part)
    return table


def write_all(table: Table, rows: DataFrame, flush: bool = False) -> None:
    """Operations in order through write_batch(), CHUNK at a time; flush: each chunk is a memtable and a file of level 0, several are written by one job."""
    held: list = []

    def write() -> None:
        table.write_batch(held)
        held.clear()
        if flush:
            table.freeze()
            if len(table.immutable) >= table.options.memtable_limit:
                table.flush_each()

    for r in rows.orderBy("pos").select("op", "key", "value").toLocalIterator(prefetchPartitions=True):
        op, key, value = r
        held.append((op, key, value if op == "put" else None))
        if len(held) == CHUNK:
            write()
    if held:
        write()
    if flush:
        table.flush_each()


def text(pairs: DataFrame) -> DataFrame:
    """key and value as text."""
    return pairs.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("kv_table_scan", _LIVE)
def kv_table_scan(spark, sf_dir):
    """All live rows of a table of three batches, in key order."""
    with loaded(spark, sf_dir, "scan") as table:
        return text(table.scan())


def _range(lower, upper):
    def run(spark, sf_dir):
        with loaded(spark, sf_dir, "range") as table:
            while table.compact_once():
                pass
            return text(table.scan(KeyRange(lower, upper)))

    return run


for _name, _lower, _upper, _where in (
    ("ii", included("10"), included("15"), "key >= '10' AND key <= '15'"),
    ("ee", excluded("10"), excluded("15"), "key > '10' AND key < '15'"),
    ("none", included("10!"), included("10!!"), "key >= '10!' AND key <= '10!!'"),
):
    query(f"kv_table_range_{_name}", f"{_LIVE} AND {_where}")(_range(_lower, _upper))


@query("kv_table_memory_and_files", _LIVE)
def kv_table_memory_and_files(spark, sf_dir):
    """The newest tenth in memtables, one frozen, the rest in files: scanned together."""
    table = fresh(spark, "memory")
    *older, newer = parts(spark, sf_dir, 10)
    table.ingest(_union(older))
    write_all(table, newer)
    table.freeze()
    table.write_batch([("put", "zz", "1"), ("del", "zz", None)])
    return text(table.scan())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("kv_table_reopen", _LIVE)
def kv_table_reopen(spark, sf_dir):
    """Written by put and delete, closed, and opened again."""
    with fresh(spark, "reopen") as table:
        write_all(table, ops(spark, sf_dir))
    with open_table(spark, table.path, SMALL) as again:
        return text(again.scan())


@query("kv_table_wal_recover", f"{_LIVE}")
def kv_table_wal_recover(spark, sf_dir):
    """The newest tenth only in the log of memtables: another opener replays it."""
    options = TableOptions(enable_wal=True)
    table = fresh(spark, "wal", options)
    cut = parts(spark, sf_dir, 10)
    table.ingest(_union(cut[:9]))
    write_all(table, cut[9])
    table.sync()  # and is never closed
    return text(open_table(spark, table.path, options).scan())


@query("kv_table_wal_replay", f"WITH {_CUTS} SELECT key, value FROM runs WHERE prio = 0")
def kv_table_wal_replay(spark, sf_dir):
    """What the memtables hold that are replayed from the log: the newest entries of the newest tenth, tombstones too."""
    options = TableOptions(enable_wal=True)
    table = fresh(spark, "replay", options)
    whole = ranked(ops(spark, sf_dir), "pos")
    write_all(table, whole.where(F.col("rank") > whole.count() * 90 // 100))
    again = open_table(spark, table.path, options)
    return text(again.entries().groupBy("key").agg(F.max_by("value", "seq").alias("value")))


_RUN = f"""{_EVENTS}, placed AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // {CHUNK} AS run FROM oplog),
    newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) AS x FROM placed) WHERE x = 1)"""


@query("kv_table_flush", f"WITH {_RUN} SELECT 0 AS level, min(key) AS first_key, max(key) AS last_key, count(*) AS entries FROM newest GROUP BY run")
def kv_table_flush(spark, sf_dir):
    """The files of level 0 after a flush for every thousand writes."""
    with fresh(spark, "flush", TableOptions.plain()) as table:
        write_all(table, ops(spark, sf_dir), flush=True)
        found = table.describe()
    return found.select("level", F.col("first").cast("string").alias("first_key"), F.col("last").cast("string").alias("last_key"), F.col("rows").alias("entries"))


@query("kv_table_memtable", f"WITH {_RUN} SELECT run AS memtable, CAST(sum(length(key) + length(coalesce(value, ''))) AS BIGINT) AS bytes, count(DISTINCT key) AS entries FROM placed GROUP BY run")
def kv_table_memtable(spark, sf_dir):
    """Bytes written to and keys held by a memtable for every thousand writes."""
    found, table = [], Memtable(0)
    for i, r in enumerate(ops(spark, sf_dir).orderBy("pos").toLocalIterator()):
        if i and i % CHUNK == 0:
            found.append((table.id, table.size, len(table.rows)))
            table = Memtable(table.id + 1)
        table.put(r["key"].encode(), i, r["value"].encode() if r["op"] == "put" else None)
    found.append((table.id, table.size, len(table.rows)))
    return spark.createDataFrame(found, "memtable long, bytes long, entries long")


@query("kv_table_compact_full", f"WITH {_LATEST} SELECT key, value FROM latest WHERE value IS NOT NULL")
def kv_table_compact_full(spark, sf_dir):
    """All entries that are left after a full compaction: the live ones, once."""
    with loaded(spark, sf_dir, "full") as table:
        table.compact_full()
        return text(table.entries())


@query("kv_table_compact_leveled", f"WITH {_LATEST} SELECT key, value, 0 AS wrong FROM latest WHERE value IS NOT NULL")
def kv_table_compact_leveled(spark, sf_dir):
    """Live rows after a compaction round for each of eight batches, and how many level invariants are broken."""
    with fresh(spark, "leveled") as table:
        wrong = 0
        for part in parts(spark, sf_dir, 8):
            table.ingest(part)
            while table.compact_once():
                wrong += len(table.manifest.snapshot().check_levels())
        return text(table.scan()).withColumn("wrong", F.lit(wrong))


@query("kv_table_levels", "SELECT 0 AS wrong, 0 AS small_levels, true AS below_trigger")
def kv_table_levels(spark, sf_dir):
    """Once the policy asks for nothing: levels in order, each twice its upper one, level 0 below its trigger."""
    with loaded(spark, sf_dir, "levels", 6) as table:
        while table.compact_once():
            pass
        state = table.manifest.snapshot()
    sizes = [len(state.levels.files(n)) for n in range(len(state.levels.levels) + 1)]
    small = sum(a and 100 * b < SMALL.compaction.size_ratio_percent * a for a, b in zip(sizes[1:], sizes[2:]))
    return spark.createDataFrame([(len(state.check_levels()), small, sizes[0] < SMALL.compaction.level0_trigger)], "wrong int, small_levels int, below_trigger boolean")


@query("kv_table_prune", f"WITH {_LATEST} SELECT p.low, count(l.key) AS live_rows, true AS pruned, 0 AS missed FROM (VALUES ('12', '2'), ('7', '71'), ('0', '1')) p(low, high) LEFT JOIN latest l ON l.value IS NOT NULL AND l.key >= p.low AND l.key < p.high GROUP BY p.low")
def kv_table_prune(spark, sf_dir):
    """Ranges of a compacted table: their live rows, whether files were left out, and files left out that hold a key of the range."""
    with loaded(spark, sf_dir, "prune", options=TableOptions(target_file_size=256, compaction=LeveledOptions(200, 2, 3))) as table:
        table.compact_full()
        state, out = table.manifest.snapshot(), []
        for low, high in (("12", "2"), ("7", "71"), ("0", "1")):
            keys = KeyRange(included(low), excluded(high))
            used = {e.name for _, e in state.select(keys)}
            missed = sum(n not in used and any(keys.holds(k) for k in (e.first, e.last)) for n, e in state.entries.items())
            out.append((low, table.count(keys), len(used) < len(state.entries), missed))
    return spark.createDataFrame(out, "low string, live_rows long, pruned boolean, missed int")


@query("kv_table_multi_get", f"WITH {_LATEST} SELECT c.key, l.value FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS key FROM customer) c LEFT JOIN latest l ON l.key = c.key")
def kv_table_multi_get(spark, sf_dir):
    """The live values of many keys."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    with loaded(spark, sf_dir, "multi") as table:
        return text(table.multi_get(keys))


@query("kv_table_get", f"WITH {_LATEST} SELECT p.key, l.value FROM (VALUES ('1'), ('7'), ('12'), ('no such key')) p(key) LEFT JOIN latest l ON l.key = p.key")
def kv_table_get(spark, sf_dir):
    """Single keys."""
    with loaded(spark, sf_dir, "get") as table:
        found = [(k, v and v.decode()) for k in ("1", "7", "12", "no such key") for v in [table.get(k)]]
    return spark.createDataFrame(found, "key string, value string")


@query("kv_table_bloom", f"WITH {_EVENTS} SELECT count(*) AS probes, count(*) FILTER (EXISTS (SELECT 1 FROM oplog o WHERE o.key = p.key)) AS present FROM (SELECT CAST(i * 7 AS VARCHAR) AS key FROM range(0, 300) t(i)) p")
def kv_table_bloom(spark, sf_dir):
    """Probes that a file with a bloom filter on the key holds an entry for."""
    with loaded(spark, sf_dir, "bloom", 1) as table:
        probes = spark.range(300).select((F.col("id") * 7).cast("string").cast("binary").alias("key"))
        found = probes.join(table.entries().select("key", F.lit(1).alias("one")), "key", "left")
        return found.agg(F.count("*").alias("probes"), F.count("one").alias("present"))


@query("kv_table_time_travel", f"WITH {_CUTS}, old AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio) AS r FROM runs WHERE prio > 0) SELECT key, value FROM old WHERE r = 1 AND value IS NOT NULL")
def kv_table_time_travel(spark, sf_dir):
    """The live rows of the version before the newest tenth, after that tenth and a full compaction have been committed."""
    whole = ranked(ops(spark, sf_dir), "pos")
    cut = whole.count() * 90 // 100
    with fresh(spark, "travel") as table:
        version = table.ingest(whole.where(F.col("rank") <= cut).drop("rank")).version
        table.ingest(whole.where(F.col("rank") > cut).drop("rank"))
        table.compact_full()
        return text(table.scan(version=version))


@query("kv_table_stream", _LIVE)
def kv_table_stream(spark, sf_dir):
    """The log as a stream: micro-batches are commits, and a second run of the query adds nothing."""
    table = fresh(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for _ in range(2):
        events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        key = F.col("user_id").cast("string").alias("key")
        stream = events.select(F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"), key, F.concat_ws("@", "event_type", F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("pos"))
        stream_into(stream, table, f"{table.path}-checkpoint", availableNow=True).awaitTermination()
    return text(table.scan())


@query("kv_table_batch_once", f"{_LIVE}")
def kv_table_batch_once(spark, sf_dir):
    """A named batch that is sent again after newer ones changes nothing."""
    with fresh(spark, "once") as table:
        cut = parts(spark, sf_dir, 2)
        for i in (0, 1, 0, 1):
            table.ingest(cut[i], f"log/{i}")
        return text(table.scan())


@query(
    "kv_table_update_existing",
    f"""WITH {_LATEST}, u AS (SELECT CAST(c_custkey AS VARCHAR) AS key, 'new' || CAST(c_custkey AS VARCHAR) AS value FROM customer)
    SELECT l.key, coalesce(u.value, l.value) AS value FROM latest l LEFT JOIN u ON u.key = l.key WHERE l.value IS NOT NULL""",
)
def kv_table_update_existing(spark, sf_dir):
    """Updates reach live keys only."""
    key = F.col("c_custkey").cast("string")
    updates = spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("key"), F.concat(F.lit("new"), key).alias("value"), F.col("c_custkey").alias("pos"))
    with loaded(spark, sf_dir, "update") as table:
        table.update_existing(updates)
        return text(table.scan())


@query("kv_table_delete", f"WITH {_LATEST} SELECT key, value FROM latest WHERE value IS NOT NULL AND key NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
def kv_table_delete(spark, sf_dir):
    """Live rows after the keys of all suppliers were deleted, whether they were there or not."""
    gone = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("del").alias("op"), F.col("s_suppkey").cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.col("s_suppkey").alias("pos"))
    with loaded(spark, sf_dir, "delete") as table:
        table.ingest(gone)
        table.compact_full()
        return text(table.scan())


@query("kv_table_two_openers", _LIVE)
def kv_table_two_openers(spark, sf_dir):
    """Batches that two openers of one folder write in turn, the second by put and flush, with compactions of both."""
    one = fresh(spark, "openers")
    two = open_table(spark, one.path, SMALL)
    for i, part in enumerate(parts(spark, sf_dir, 4)):
        if i % 2:
            write_all(two, part)
            two.freeze()
            two.flush_all()
            two.compact_once()
        else:
            one.ingest(part)
    one.compact_once()
    return text(one.scan())


@query("kv_table_vacuum", f"WITH {_LATEST} SELECT count(*) AS live_rows, true AS deleted, 0 AS left_over FROM latest WHERE value IS NOT NULL")
def kv_table_vacuum(spark, sf_dir):
    """Live rows after merged inputs were deleted, and folders that no version names."""
    with loaded(spark, sf_dir, "vacuum") as table:
        table.compact_full()
        deleted = table.vacuum()
        out = [(table.count(), bool(deleted), len(table.vacuum()))]
    return spark.createDataFrame(out, "live_rows long, deleted boolean, left_over int")


@query("kv_table_cursor", f"{_LIVE} ORDER BY key LIMIT 10")
def kv_table_cursor(spark, sf_dir):
    """The first ten rows by a cursor."""
    found = []
    with loaded(spark, sf_dir, "cursor") as table:
        cursor = table.cursor()
        while cursor.valid and len(found) < 10:
            found.append((cursor.key.decode(), cursor.value.decode()))
            cursor.next()
    return spark.createDataFrame(found, "key string, value string")


@query("kv_table_sources", "SELECT 3 AS sources, 0 AS elsewhere")
def kv_table_sources(spark, sf_dir):
    """Files and memtables that a scan merges: two flushed, one in memory; none beyond the keys."""
    with fresh(spark, "sources", TableOptions.plain()) as table:
        cut = parts(spark, sf_dir, 3)
        for part in cut[:2]:
            write_all(table, part)
            table.flush()
        write_all(table, cut[2])
        out = [(table.active_sources(), table.active_sources(KeyRange(included("x"), included("y"))))]
    return spark.createDataFrame(out, "sources int, elsewhere int")


@query("kv_table_shell", "SELECT * FROM (VALUES (0, '101 values filled with epoch 0'), (1, '150=value150@0'), (2, '151: value151@0 -> new'), (3, 'nokey does not exist'), (4, '110=value110@0'), (5, '112=value112@0'), (6, '2 keys scanned'), (7, 'error: unknown command bad')) t(line, said)")
def kv_table_shell(spark, sf_dir):
    """What the shell says to a session on a table."""
    out = io.StringIO()
    shell = Shell(fresh(spark, "shell", TableOptions.shell(None, True)), out)
    for line in ("fill 100 200", "get 150", "update 151 new", "get nokey", "del 111", "scan 110 112", "bad", "flush", "quit"):
        shell.run(line)
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines())), "line int, said string")


@query("kv_table_numeric_keys", "SELECT event_id, event_type FROM events WHERE event_id - 5000 BETWEEN -4800 AND 150")
def kv_table_numeric_keys(spark, sf_dir):
    """Whole numbers as keys that sort as numbers: a range that runs over zero."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") - 5000).alias("number"), "event_type", "event_id")
    puts = events.select(F.lit("put").alias("op"), encode_long(F.col("number")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("pos"))
    low, high = (included((n + 2**63).to_bytes(8, "big")) for n in (-4800, 150))
    with fresh(spark, "numbers", TableOptions(target_file_size=4096)) as table:
        table.ingest(puts)
        found = table.scan(KeyRange(low, high))
    return found.select((decode_long(F.col("key")) + 5000).alias("event_id"), F.col("value").cast("string").alias("event_type"))


@query("kv_table_lineitem", """SELECT key, CAST(value AS VARCHAR) AS value FROM (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || ':' || CAST(l_linenumber AS VARCHAR) AS key, l_partkey AS value, l_returnflag,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS r FROM lineitem) WHERE r = 1 AND l_returnflag <> 'R'""")
def kv_table_lineitem(spark, sf_dir):
    """Live line items of a table that is ingested in one batch and compacted."""
    from pyspark.sql import Window as W

    from .queries import lineitem_log

    log = lineitem_log(spark, sf_dir)
    pos = F.row_number().over(W.partitionBy("key").orderBy("seq"))
    rows = log.select(F.when(F.col("value").isNull(), "del").otherwise("put").alias("op"), "key", F.col("value").cast("string").alias("value"), pos.alias("pos"))
    with fresh(spark, "lineitem", TableOptions(target_file_size=1 << 20)) as table:
        table.ingest(rows)
        table.compact_full()
        return text(table.scan())
