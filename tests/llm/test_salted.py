"""Salted joins: the rows of a plain join, hot keys dealt over copies."""

from collections import Counter

import pytest

from tidemark.llm import common


@pytest.mark.parametrize("count", [0, 1, 5000])
def test_rows_of_a_plain_join(spark, count):
    keys = [(0, 7) if i % 3 == 0 else (i % 50, i % 11) for i in range(count)]
    rows = common.stage(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(keys)], "n long, a long, b int"), "rows")
    wide = [(a, b, times, f"text {a} {b}") for (a, b), times in Counter(keys).items()]
    counted = common.stage(spark.createDataFrame(wide, "a long, b int, times long, wide string"), "counted")
    out = common.join_salted(rows, counted, ["a", "b"])
    assert sorted(map(tuple, out.select("n", "a", "b", "wide").collect())) == [(i, a, b, f"text {a} {b}") for i, (a, b) in enumerate(keys)]
    assert set(out.columns) == {"n", "a", "b", "wide"}
