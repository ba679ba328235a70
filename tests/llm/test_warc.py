"""WARC: what was written is what is read, revisits, and assembly of incomplete captures."""

import base64
import gzip
import hashlib
import io

import pytest

from tidemark.llm import common, warc

SCHEMA = "page_id long, url string, html string, URL string, n int, sha1 string"


def rows():
    same = "<p>same é</p>"
    out = [(5, "http://a/", same), (3, "http://b/ c\r\nX: y", same), (9, None, same), (1, "", None), (2, "http://e/", ""), (7, "http://f/", "x\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://n/", same), (8, "http://g/", "long" * 60_000), (None, None, None), (10, "http://h/", "only")]
    return [(*r, None, 1, "z") for r in out]


def expected(data, least=0):
    first = {}
    for i, _, h, *_ in data:
        if i is not None and (h or "") not in first or i is not None and i < first[h or ""]:
            first[h or ""] = i
    out = []
    for i, u, h, *_ in data:
        b = (h or "").encode()
        whole = len(b) >= least
        kind = "response" if not whole or i == first[h or ""] else "revisit"
        out.append((str(i), u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, first[h or ""] if kind == "revisit" else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 1, 10])
def test_round_trip(spark, least):
    data = rows()
    out = warc.round_trip(spark, spark.createDataFrame(data, SCHEMA), least).collect()
    found = sorted(repr((str(r["page_id"]), r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in out)
    assert found == expected(data, least)


def test_repeated_rows_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    data = [(i % 7, f"http://x/{i}", f"text {i % 5}", None, 1, "z") for i in range(40)]
    out = warc.round_trip(spark, spark.createDataFrame(data, SCHEMA)).collect()
    assert len(out) == 40
    assert sum(r["record_type"] == "response" for r in out) == 5
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_and_assembly(spark):
    folder = common.staged_path(spark, "test")
    archives = common.stage(warc.write(spark.createDataFrame(rows(), SCHEMA), folder), "test-list")
    records = warc.read(archives)
    whole = warc.assemble(records)
    got = {r["metadata"]["page_id"]: r for r in whole.where("metadata.page_id is not null").collect()}
    assert bytes(got[7]["response"]["payload"]) == b"x\r\n\r\nWARC/1.1\r\n\r\n" and got[7]["request"]["present"]
    assert got[5]["response"]["payload"] is None and got[5]["response"]["refers_to"] == 3
    lost = warc.assemble(records.where("kind <> 'metadata'"))
    assert lost.count() == whole.count() and lost.where("metadata is not null").count() == 0
    assert records.count() == 3 * len(rows())


def test_truncated_archives_are_noticed():
    data = warc.record("response", "urn:x", [], b"a" * 1000)
    assert [warc.parse(m)[1] for m in warc.members(io.BytesIO(data * 3))] == [b"a" * 1000] * 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5])))
    assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_revisits_name_their_response(spark):
    folder = common.staged_path(spark, "test")
    archives = common.stage(warc.write(spark.createDataFrame(rows(), SCHEMA), folder), "test-list")
    whole = {r["capture"]: r for r in warc.assemble(warc.read(archives)).collect()}
    revisits = [r for r in whole.values() if r["response"]["kind"] == "revisit"]
    assert revisits and all(r["request"]["present"] for r in whole.values())
    for r in revisits:
        first = whole[r["response"]["refers_to_id"]]
        assert first["response"]["kind"] == "response" and first["metadata"]["page_id"] == r["response"]["refers_to"]
        assert first["response"]["payload_digest"] == r["response"]["header_digest"] and first["response"]["payload_bytes"] == r["metadata"]["payload_length"]


def test_assembly_across_files_and_directions(spark, tmp_path):
    def file(name, *records):
        (tmp_path / name).write_bytes(b"".join(records))
        return (f"file://{tmp_path}/{name}",)

    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    response = lambda i, *more: warc.record("response", f"urn:r{i}", [("WARC-Payload-Digest", "sha1:X"), *more], http)
    fields = b"page-id: %d\r\npayload-length: 4"
    names = [
        file("a", response(1, ("WARC-Concurrent-To", "<urn:q1>"), ("WARC-Concurrent-To", "<urn:m1>")), warc.record("metadata", "urn:m2", [("WARC-Concurrent-To", "<urn:q2>")], fields % 2)),
        file("b", warc.record("request", "urn:q1", [], b"GET"), warc.record("request", "urn:q2", [("WARC-Concurrent-To", "<urn:r2>")], b"GET"), warc.record("request", "urn:q9", [], b"GET")),
        file("c", warc.record("metadata", "urn:m1", [], fields % 1), response(2)),
    ]
    out = {r["capture"]: r for r in warc.assemble(warc.read(spark.createDataFrame(names, "path string"))).collect()}
    assert set(out) == {"<urn:r1>", "<urn:r2>", "<urn:q9>"}
    for i in (1, 2):
        r = out[f"<urn:r{i}>"]
        assert r["request"]["present"] and r["response"]["payload_bytes"] == 4 and r["metadata"]["page_id"] == i
    assert out["<urn:q9>"]["response"] is None and out["<urn:q9>"]["metadata"] is None
