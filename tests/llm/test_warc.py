import hashlib

from modelkeel.llm import warc
from modelkeel.session import fresh_path

SCHEMA = "page_id long, url string, html string, digest int, data string"


def run(spark, rows, keep=True):
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    manifest = warc.write_archives(warc.plan_records(pages), "file://" + fresh_path(spark, "warc"))
    return [r.asDict() for r in warc.read_chunks(manifest, keep).collect()]


def test_payloads_come_back(spark, monkeypatch):
    big = "é" * (2 * warc.CHUNK_BYTES) + "end"
    rows = [(5, "http://a/\r\nX: y", big), (3, None, "a" * 100), (4, "u", "a" * 100), (9, "u", "b" * 99), (8, "u", "b" * 99),
            (7, "u", None), (6, "u", ""), (None, "u", "a" * 100), (None, "u", "only null ids" * 10), (2, "u", "WARC/1.1\r\n\r\n")]
    got = run(spark, rows)
    by = {}
    for r in sorted(got, key=lambda r: r["chunk_no"]):
        if r["data"] is not None:
            assert len(r["data"]) <= warc.CHUNK_BYTES
        by.setdefault((r["page_id"], r["refers_to"]), []).append(r)
    last = [r for r in got if r["is_last"]]
    assert len(last) == len(rows)
    want = {(p, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for p, _, h in rows}
    assert {(r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in last} == want
    assert {(r["page_id"], r["refers_to"]) for r in last if r["record_type"] == "revisit"} == {(4, 3), (None, 3)}
    assert b"".join(r["data"] for r in by[5, None]) == big.encode() and len(by[5, None]) == 5
    assert [r["data"] for r in by[2, None]] == [b"WARC/1.1\r\n\r\n"]


def test_repeated_rows_and_empty(spark):
    got = run(spark, [(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "u", "x" * 200)], keep=False)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(1, "response", None)] * 2 + [(2, "revisit", 1)]
    assert run(spark, []) == []
