"""Merging of layers: the newest entry of each key, tombstones kept or hidden."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KeyRange


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """All entries of all layers."""
    return reduce(DataFrame.unionByName, layers)


def bounded(entries: DataFrame, keys: KeyRange) -> DataFrame:
    """The entries of a key range; written above a merge it is pushed through to the scan."""
    condition = keys.condition(F.col("key"), dict(entries.dtypes)["key"] == "string")
    return entries if condition is None else entries.where(condition)


def latest(entries: DataFrame, seq: str | Column = "seq") -> DataFrame:
    """(key, seq, value) of the entry with the greatest seq of each key, tombstones included.

    An aggregate, so that each map task sends one entry of a key at most.
    """
    order = F.col(seq) if isinstance(seq, str) else seq
    return entries.groupBy("key").agg(F.max(order).alias("seq"), F.max_by("value", order).alias("value")).select("key", "seq", "value")


def live(entries: DataFrame) -> DataFrame:
    """Newest entries without tombstones."""
    return latest(entries).where(F.col("value").isNotNull())


def merge_priority(layers: list[DataFrame]) -> DataFrame:
    """(key, value) of the first layer that holds each key, tombstones included.

    Within a layer keys are unique. An empty list of layers is an error; empty layers aren't.
    """
    ranked = [layer.select("key", "value", F.lit(i).alias("priority")) for i, layer in enumerate(layers)]
    return union_layers(ranked).groupBy("key").agg(F.min_by("value", "priority").alias("value"))


def merge_two(left: DataFrame, right: DataFrame) -> DataFrame:
    """merge_priority() of two layers."""
    return merge_priority([left, right])


def concat_level(files: list[DataFrame]) -> DataFrame:
    """Entries of files with disjoint key ranges: no merge is needed."""
    return union_layers(files)


def in_order(entries: DataFrame) -> DataFrame:
    """Entries by key bytes, ascending."""
    return entries.orderBy("key")


def first_n(entries: DataFrame, n: int) -> DataFrame:
    """The n entries with the least keys, without a full sort."""
    return entries.orderBy("key").limit(n)


def without_values(entries: DataFrame) -> DataFrame:
    """Keys only; values aren't read."""
    return entries.select("key")


def apply_updates(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """The entries and those updates (key, seq, value) whose key is live."""
    return entries.unionByName(updates.join(live(entries).select("key"), "key", "left_semi").select("key", "seq", "value"))


def multi_get(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Each distinct key with its live value or null, in one join instead of a job for each key."""
    return keys.select("key").distinct().join(live(entries).select("key", "value"), "key", "left")
