"""The table on disk: scans, flushes, compaction, recovery, crash points, streaming, shell."""

import io
import random

import pytest

from tidemark.model import KeyRange, LeveledOptions, TableOptions, excluded, included
from tidemark.shell import Shell
from tidemark.store import open_table
from tidemark.streaming.ingest import stream_into


def rows(table, *bounds, **options):
    return [(bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in table.scan(KeyRange(*bounds), **options).collect()]


def test_memory_and_files(spark, tmp_path):
    table = open_table(spark, str(tmp_path), TableOptions.plain())
    table.write_batch([("put", "0", "2333333"), ("put", "00", "2333333"), ("put", "4", "23")])
    table.flush()
    table.delete("4")
    table.flush()
    table.write_batch([("put", "1", "233"), ("put", "2", "2333"), ("put", "00", "2333")])
    table.freeze()
    table.write_batch([("put", "3", "23333"), ("del", "1", None)])
    whole = [("0", "2333333"), ("00", "2333"), ("2", "2333"), ("3", "23333")]
    assert rows(table) == whole
    assert rows(table, included("1"), included("2")) == [("2", "2333")]
    assert rows(table, excluded("1"), excluded("3")) == [("2", "2333")]
    assert rows(table, included("0"), included("1")) == whole[:2]
    assert rows(table, excluded("0"), included("1")) == whole[1:2]
    assert rows(table, included("00a"), included("00b")) == []
    assert [table.get(k) for k in ("0", "00", "2", "3", "4", "1", "x")] == [b"2333333", b"2333", b"2333", b"23333", None, None, None]
    probe = spark.createDataFrame([("0",), ("4",), ("x",), ("0",)], "key string")
    assert {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in table.multi_get(probe).collect()} == {b"0": b"2333333", b"4": None, b"x": None}
    assert table.active_sources() == 4 and table.active_sources(KeyRange(included("5"), included("6"))) == 0
    assert table.count() == 4
    cursor = table.cursor(KeyRange(included("2")))
    seen = []
    while cursor.valid:
        seen.append(cursor.key)
        cursor.next()
    cursor.next()
    assert seen == [b"2", b"3"]
    with pytest.raises(ValueError):
        cursor.key
    table.close()


def test_full_compaction(spark, tmp_path):
    with open_table(spark, str(tmp_path)) as table:
        table.flush()  # nothing to flush
        table.put("0", "v1")
        table.flush()
        table.write_batch([("put", k, "v2") for k in "012"])
        table.flush()
        table.write_batch([("del", "0", None), ("del", "2", None)])
        table.flush()
        before = table.manifest.snapshot().version
        table.compact_full()
        assert rows(table) == [("1", "v2")] and rows(table, version=before) == [("1", "v2")]
        assert table.describe().count() == 1
        table.write_batch([("put", "0", "v3"), ("put", "2", "v3"), ("del", "1", None)])
        table.flush()
        table.compact_full()
        assert rows(table) == [("0", "v3"), ("2", "v3")]
        assert not table.manifest.snapshot().check_levels()
        assert table.vacuum() and rows(table) == [("0", "v3"), ("2", "v3")]
        table.write_batch([("del", "0", None), ("del", "2", None)])
        table.flush()
        table.compact_full()  # nothing but tombstones
        assert rows(table) == [] and table.describe().count() == 0
    with open_table(spark, str(tmp_path), TableOptions.compacting(LeveledOptions())) as table:  # another strategy
        assert rows(table) == []


@pytest.mark.parametrize("wal", [False, True])
def test_reopening(spark, tmp_path, wal):
    options = TableOptions(memtable_limit=2, compaction=LeveledOptions(200, 2, 3), enable_wal=wal)
    with open_table(spark, str(tmp_path), options) as table:
        for i in range(6):
            table.write_batch([("put", "0", f"v{i}"), ("put" if i % 2 == 0 else "del", "1", f"v{i}"), ("put" if i % 2 else "del", "2", f"v{i}")])
            if i == 2:
                table.flush()
    with open_table(spark, str(tmp_path), options) as table:
        assert rows(table) == [("0", "v5"), ("2", "v5")]
        table.put("0", "v6")  # newer than all that was recovered
        assert table.get("0") == b"v6"


def test_torn_log_and_lost_files(spark, tmp_path):
    options = TableOptions(enable_wal=True)
    table = open_table(spark, str(tmp_path), options)
    table.put("a", "1")
    table.put("b", "2")
    log = next((tmp_path / "wal").iterdir())
    log.write_bytes(log.read_bytes()[:-5])
    (tmp_path / "data" / "lost").mkdir(parents=True)
    again = open_table(spark, str(tmp_path), options)
    assert rows(again) == [("a", "1")]
    assert again.vacuum() == ["lost"]


def test_batches_are_whole(spark, tmp_path):
    with open_table(spark, str(tmp_path)) as table:
        with pytest.raises(ValueError):
            table.write_batch([("put", "a", "1"), ("put", "", "2")])
        assert rows(table) == []
        bad = spark.createDataFrame([("put", "a", "1", 0), ("put", "b", "", 1)], "op string, key string, value string, pos long")
        with pytest.raises(ValueError):
            table.ingest(bad)
        assert rows(table) == []
        table.write_batch([("put", "k", "1"), ("del", "k", None), ("put", "k", "3")])
        assert rows(table) == [("k", "3")]
        table.update_existing(spark.createDataFrame([("k", "4", 0), ("z", "4", 1)], "key string, value string, pos long"))
        assert rows(table) == [("k", "4")]
        assert table.update("z", "5") is None and table.update("k", "5") == (b"4", b"5")


def test_automatic_freeze(spark, tmp_path):
    options = TableOptions(target_file_size=1024, memtable_limit=2)
    with open_table(spark, str(tmp_path), options) as table:
        for _ in range(100):
            table.put("1", "x" * 30)
        assert len(table.immutable) >= 2
        count = len(table.immutable)
        table.maintain()
        assert len(table.immutable) == count - 1 and len(table.manifest.snapshot().levels.level0) == 1


def test_against_a_dictionary(spark, tmp_path):
    """Random writes, ingests, flushes and compactions hold to what a dictionary holds."""
    generator = random.Random(5)
    options = TableOptions(target_file_size=3000, memtable_limit=2, compaction=LeveledOptions(200, 2, 3))
    model: dict[str, str] = {}
    table = open_table(spark, str(tmp_path), options)
    for step in range(14):
        ops = []
        for i in range(120):
            key = f"{generator.randrange(150):010}"
            op = "del" if generator.random() < 0.25 else "put"
            ops.append((op, key, f"{step}-{i}" if op == "put" else None))
            if op == "put":
                model[key] = f"{step}-{i}"
            else:
                model.pop(key, None)
        if step % 3 == 2:
            table.ingest(spark.createDataFrame([(*o, i) for i, o in enumerate(ops)], "op string, key string, value string, pos long"))
        else:
            table.write_batch(ops)
        if step % 2:
            table.flush()
        if step % 4 == 3:
            while table.compact_once():
                pass
        assert not table.manifest.snapshot().check_levels()
    assert rows(table) == sorted(model.items())
    low, high = "0000000030", "0000000090"
    assert rows(table, included(low), excluded(high)) == sorted((k, v) for k, v in model.items() if low <= k < high)
    table.close()
    assert rows(open_table(spark, str(tmp_path), options)) == sorted(model.items())


def test_bloom_filter_skips_row_groups(spark, tmp_path):
    with open_table(spark, str(tmp_path)) as table:
        table.fill(0, 3000)
        name = table.describe().first()["name"]
        import pyarrow.parquet as pq

        data = open(tmp_path / name, "rb").read()
        assert pq.ParquetFile(tmp_path / name).metadata.num_rows == 3001 and data
        assert table.get("100") == b"value100@0" and table.get("100x") is None


def test_streaming_applies_a_batch_once(spark, tmp_path):
    schema = "op string, key string, value string, pos long"
    table = open_table(spark, str(tmp_path / "table"))
    source = str(tmp_path / "in")
    spark.createDataFrame([("put", "a", "1", 0), ("put", "b", "1", 1), ("del", "a", None, 2)], schema).coalesce(1).write.json(source)
    stream = spark.readStream.schema(schema).json(source)
    for _ in range(2):
        query = stream_into(stream, table, str(tmp_path / "check"), availableNow=True)
        query.awaitTermination()
    assert rows(table) == [("b", "1")]
    state = table.manifest.snapshot()
    again = table.ingest(spark.createDataFrame([("put", "c", "1", 0)], schema), next(iter(state.batches)))
    assert again.version == state.version and rows(table) == [("b", "1")]


def test_shell(spark, tmp_path):
    out = io.StringIO()
    shell = Shell(open_table(spark, str(tmp_path), TableOptions.shell(None, False)), out)
    for line in ("fill 98 101", "get 100", "update 100 hello", "update x y", "del 99", "scan 100 101", "scan a", "fill 5 4", "flush", "scan"):
        assert shell.run(line)
    assert not shell.run("quite")
    said = out.getvalue()
    assert "100=value100@0" in said and "100: value100@0 -> hello" in said and "x does not exist" in said
    assert "2 keys scanned" in said and "3 keys scanned" in said and "error: scan takes 0 or 2" in said and "0 values filled" in said
    assert shell.epoch == 10
