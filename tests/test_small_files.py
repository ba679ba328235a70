"""Tables of many small files and memtables: what they cost follows the data, not the number of files."""

from tidemark import store, table_queries
from tidemark.model import KeyRange, LeveledOptions, TableOptions, excluded, included
from tidemark.sources import sorted_files
from tidemark.store import open_table

SF = "/root/testdata/sf0.001"


def rows(table, *bounds):
    return [(bytes(r["key"]).decode(), bytes(r["value"]).decode()) for r in table.scan(KeyRange(*bounds)).collect()]


def ops(spark, count, keys, value="v"):
    return spark.createDataFrame([("put", f"{i % keys:05}", f"{value}{i}", i) for i in range(count)], "op string, key string, value string, pos long")


def test_small_files_share_parquet_files(spark, tmp_path):
    table = open_table(spark, str(tmp_path), TableOptions(target_file_size=256, compaction=LeveledOptions(200, 2, 3)))
    for _ in range(2):
        table.ingest(ops(spark, 4000, 1000))
    table.compact_full()
    found = list(table.manifest.snapshot().entries.values())
    assert sum(e.rows for e in found) == 1000 and 95 <= len(found) <= 110  # 26 bytes a row: counted after the merge, without Parquet's own bytes
    assert len({e.path for e in found}) == 1
    assert not table.manifest.snapshot().check_levels()
    some = KeyRange(included("00100"), excluded("00130"))
    assert 1 <= len(table.manifest.snapshot().select(some)) <= 6
    assert rows(table, included("00100"), excluded("00130")) == [(f"{i:05}", f"v{3000 + i}") for i in range(100, 130)]


def test_batches_are_not_ranked_again(spark):
    cut = table_queries.parts(spark, SF, 8)
    assert not any("Window" in p._jdf.queryExecution().toString() for p in cut)
    pos = [[r["pos"] for r in p.collect()] for p in cut]
    assert sum(map(len, pos)) == table_queries.ops(spark, SF).count() and max(map(len, pos)) - min(map(len, pos)) <= 8
    assert all(max(a) < min(b) for a, b in zip(pos, pos[1:]))
    assert [p.count() for p in table_queries.parts(spark, SF, 8)] == list(map(len, pos))


def test_memtables_get_files_by_one_commit(spark, tmp_path):
    table = open_table(spark, str(tmp_path), TableOptions.plain())
    before = table.manifest.snapshot().version
    table_queries.write_all(table, ops(spark, 3500, 700), flush=True)
    state = table.manifest.snapshot()
    assert state.version == before + 1 and [state.entries[n].rows for n in state.levels.level0] == [500, 700, 700, 700]
    assert rows(table) == [(f"{i % 700:05}", f"v{i}") for i in range(2800, 3500)]


def test_closing_merges_waiting_memtables(spark, tmp_path):
    options = TableOptions(target_file_size=64)
    with open_table(spark, str(tmp_path), options) as table:
        table.write_batch([("put", f"{i % 50:03}", f"v{i}") for i in range(1000)] + [("del", "007", None)])
        assert len(table.immutable) > 50
        before = table.manifest.snapshot().version
    again = open_table(spark, str(tmp_path), options)
    assert again.manifest.snapshot().version == before + 2  # the flush, and the second opener
    assert rows(again) == [(f"{i % 50:03}", f"v{i}") for i in range(950, 1000) if i != 957]


def test_waiting_memtables_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "HELD_BYTES", 2000, raising=False)
    table = open_table(spark, str(tmp_path), TableOptions(target_file_size=100))
    for k in range(10):
        table.write_batch([("put", f"{i:03}", f"v{k}") for i in range(100)])
        assert sum(t.size for t in table.immutable) < 2000
    assert rows(table) == [(f"{i:03}", "v9") for i in range(100)]


def test_many_shifts_are_one_scan(spark, tmp_path, monkeypatch):
    table = open_table(spark, str(tmp_path), TableOptions())
    for k in range(4):
        table.put("a", f"v{k}")
        table.put(f"k{k}", "x")
        table.flush()
    monkeypatch.setattr(sorted_files, "MANY_SHIFTS", 2, raising=False)
    plan = table.view(KeyRange(included("a"), included("k1")))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Location:") == 1 and "GreaterThanOrEqual(key" in plan
    assert rows(table) == [("a", "v3"), *((f"k{k}", "x") for k in range(4))]


def test_two_openers_flush_at_once(spark, monkeypatch):
    made = []
    fresh = table_queries.fresh
    monkeypatch.setattr(table_queries, "fresh", lambda *a: made.append(fresh(*a)) or made[-1])
    found = table_queries.kv_table_two_openers(spark, SF).count()
    assert found and made[0].manifest.snapshot().version <= 12
