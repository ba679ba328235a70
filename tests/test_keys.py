from pyspark.sql import functions as F

from tidemark.functions import keys


def test_long_keys_sort_as_numbers(spark):
    numbers = [-(2**63), -1000, -1, 0, 1, 150, 1000, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", keys.encode_long(F.col("n")).alias("key"))
    rows = df.orderBy("key").select("n", keys.decode_long(F.col("key")).alias("back")).collect()
    assert [r["n"] for r in rows] == numbers == [r["back"] for r in rows]


def test_entry_bytes(spark):
    df = spark.createDataFrame([("é", "abc"), ("k", None)], "k string, v string")
    assert [r[0] for r in df.select(keys.entry_bytes(F.col("k"), F.col("v"))).collect()] == [5, 1]


def test_bloom_sizes():
    assert keys.bloom_bits_per_key(1000, 0.01) == 10 and keys.bloom_hashes(10) == 6
