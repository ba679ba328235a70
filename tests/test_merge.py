"""Merging of layers: golden cases."""

from tidemark.operators import merge


def layer(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def pairs(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_priority(spark):
    one = layer(spark, [("a", "1.1"), ("b", "2.1"), ("c", "3.1"), ("e", None)])
    two = layer(spark, [("a", "1.2"), ("b", "2.2"), ("c", "3.2"), ("d", "4.2")])
    three = layer(spark, [("b", "2.3"), ("c", "3.3"), ("d", "4.3")])
    assert pairs(merge.merge_priority([one, two, three])) == {"a": "1.1", "b": "2.1", "c": "3.1", "d": "4.2", "e": None}
    assert pairs(merge.merge_priority([three, one, two])) == {"a": "1.1", "b": "2.3", "c": "3.3", "d": "4.3", "e": None}


def test_two_with_tombstones_and_empty_sides(spark):
    empty = layer(spark, [])
    left, right = layer(spark, [("a", None), ("c", "l")]), layer(spark, [("a", "r"), ("b", "r")])
    assert pairs(merge.merge_two(left, right)) == {"a": None, "b": "r", "c": "l"}
    assert pairs(merge.merge_two(empty, right)) == pairs(right)
    assert pairs(merge.merge_two(left, empty)) == pairs(left)
    assert pairs(merge.merge_two(empty, empty)) == {}


def test_binary_order(spark):
    keys = [bytes.fromhex(x) for x in ("80", "ff", "00", "7f", "0000", "3030", "30")]
    rows = spark.createDataFrame([(k, b"v") for k in keys], "key binary, value binary")
    assert [bytes(r["key"]) for r in merge.in_order(rows).collect()] == sorted(keys)


def test_key_filters_reach_the_scan(spark, tmp_path):
    from tidemark.model import KeyRange, excluded, included

    spark.createDataFrame([("a", 1, "x")], "key string, seq long, value string").write.parquet(str(tmp_path / "t"))
    df = merge.live(spark.read.parquet(str(tmp_path / "t")))
    plan = merge.bounded(df, KeyRange(included("a"), excluded("b")))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "GreaterThanOrEqual(key" in scan and "LessThan(key" in scan and "IsNotNull(value)" not in scan
