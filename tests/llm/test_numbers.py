"""Operators that join by row number, while the number of a scan's partitions changes from job to job."""

import itertools

import pytest

from tidemark.llm import common, decontam, lines, suffix, warc

from . import test_decontam, test_suffix, test_warc
from .corpus import documents, odd


@pytest.fixture
def changing(spark, monkeypatch):
    """From one staged table to the next, scans are cut for another number of cores."""
    real, cores = common.stage, itertools.cycle([2, 7, 1, 5, 3])

    def stage(df, label):
        out = real(df, label)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(cores))
        return out

    monkeypatch.setattr(common, "stage", stage)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def table(spark, tmp_path, rows, schema="doc_id long, text string", files=6):
    path = f"{tmp_path}/rows.parquet"
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


ROWS = documents(seed=77, count=60) + odd()


def test_numbers_stay(spark, tmp_path, changing):
    docs = table(spark, tmp_path, [(i, str(i)) for i in range(500)])
    whole = common.with_numbers(docs)
    found = []
    for cores in (1, 3, 8):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        found.append({r["c0"]: r["n"] for r in whole.select("c0", "n").collect()})
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == 500
    other = common.with_numbers(docs.where("doc_id % 2 = 0"))  # no bare scan
    assert {r["n"]: r["c0"] for r in other.collect()} == {r["n"]: r["c0"] for r in other.coalesce(1).collect()}


def test_more_files_than_are_listed(spark, tmp_path, changing, monkeypatch):
    monkeypatch.setattr(common, "MANY_FILES", 2)
    rows = common.numbered(table(spark, tmp_path, ROWS), doc_id="long", text="string")
    assert rows.select("n").distinct().count() == len(ROWS) == rows.count()


def test_suffix_spans(spark, tmp_path, changing):
    assert test_suffix.result(suffix.dedup(table(spark, tmp_path, ROWS), 60, 24)) == test_suffix.brute(ROWS, 60)


@pytest.mark.parametrize("block", [120, 1 << 20])
def test_hits(spark, tmp_path, changing, monkeypatch, block):
    rows, items, benchmark = test_decontam.case(spark)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs = table(spark, tmp_path, rows)
    expected = test_decontam.brute(rows, items)
    assert test_decontam.result(decontam.contamination(docs, benchmark)) == expected
    left = sorted(str(r["doc_id"]) for r in decontam.keep_clean(docs, benchmark).collect())
    assert left == sorted(r[0] for r in expected if not r[-1])


def test_lines_kept(spark, tmp_path, changing):
    docs = table(spark, tmp_path, ROWS)
    got = sorted((str(r["doc_id"]), r["text"] or "", r["n_removed"]) for r in lines.dedup(docs).collect())
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", 1)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in lines.dedup_documents(docs).collect())
    assert [x[:2] for x in got] == kept and sum(x[2] > 0 for x in got) > 10
    whole = sorted(len(t or "") for _, t in ROWS)
    assert sorted(len(t) + n for _, t, n in got) == whole


def test_archives(spark, tmp_path, changing):
    data = test_warc.rows() + [(20 + i, f"http://x/{i}", f"text {i % 5}", None, 1, "z") for i in range(40)]
    out = warc.round_trip(spark, table(spark, tmp_path, data, test_warc.SCHEMA.replace("URL", "other").replace("sha1", "hash"))).collect()
    found = sorted(repr((str(r["page_id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in out)
    assert found == test_warc.expected(data)
