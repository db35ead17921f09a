from __future__ import annotations

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import warc


def brute(rows):
    first = {}
    for i, html in sorted(rows):
        b = (html or "").encode()
        if len(b) >= 100:
            first.setdefault(b, i)
    out = {}
    for i, html in rows:
        b = (html or "").encode()
        to = first.get(b, i)
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "response" if to == i else "revisit", None if to == i else to)
    return out


def result(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


def test_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    out = warc.archive_pages(pages)
    assert result(out) == brute([(r["page_id"], r["html"]) for r in pages.collect()])
    order = [(r["url_key"], r["captured"], r["page_id"]) for r in out.collect()]
    assert order == sorted(order)


def test_tricky(spark):
    rows = [(1, "http://A.org/x", None), (2, None, ""), (3, "http://a.org", "é" * 49), (4, "http://a.org", "é" * 49), (5, "u", "é" * 50), (6, "u", "é" * 50), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (8, "u\r\nX: y", "z" * 300_000), (9, "u", "é" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "run": F.lit(2), "n": F.lit(3)})
    assert result(warc.archive_pages(df)) == brute([(i, h) for i, _, h in rows])
    assert warc.archive_pages(df.where("false")).count() == 0


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((r.randrange(50), i) for _ in range(r.randrange(6))) for i in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_url_key():
    urls = ["https://www.Example.org:80/a?b=1#c", "ftp://x.y", "", "a.b?q", "www2.a.b#x"]
    assert [warc.url_key(u) for u in urls] == ["org,example)/a?b=1", "y,x)/", ")/", "b,a)?q", "b,a)/"]


def rows_of(df):
    return sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_repeated_and_null_ids(spark):
    a, b, c = ("x" * 200, "y" * 200, "short")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(1, a), (2, a), (2, b), (2, a), (0, b), (None, a), (None, a), (None, "z" * 150), (3, c), (3, c), (1, a)]
    got = rows_of(warc.archive_pages(spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in rows], "page_id long, url string, html string")))
    want = [(1, a, None), (2, a, 1), (2, b, 0), (2, a, 1), (0, b, None), (None, a, None), (None, a, None), (None, "z" * 150, None), (3, c, None), (3, c, None), (1, a, None)]
    assert got == sorted(((i, sha(t), "revisit" if to is not None else "response", to) for i, t, to in want), key=str)


def test_any_id_and_session_zone(spark):
    ids = [0, 1, -5, 300_000_000_000, 2**63 - 1, -(2**63)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = warc.archive_pages(spark.createDataFrame([(i, "u", "t") for i in ids], "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r["page_id"]: r["captured"] for r in out} == {i: warc.EPOCH + i if warc.EPOCH + i < 2**63 else i for i in ids}


def test_dates_of_records(spark):
    df = spark.createDataFrame([(i, "u", "t") for i in (0, -1_700_000_001, 300_000_000_000)], "page_id long, url string, html string")
    dates = {r["page_id"]: r["record"].split("WARC-Date: ")[1][:20] for r in warc.records(df).collect()}
    assert dates == {0: "2023-11-14T22:13:20Z", -1_700_000_001: "1969-12-31T23:59:59Z", 300_000_000_000: "9999-12-31T23:59:59Z"}


def test_very_long_pages_have_files_of_their_own(spark, tmp_path):
    long = "0123456789" * 10_000_000
    rows = [(1, "u", long[:70_000]), (2, "u", long[:70_000]), (3, "v", "short"), (4, "w", long)]
    df = spark.createDataFrame([(i, u, n) for i, u, n in [(r[0], r[1], len(r[2])) for r in rows]], "page_id long, url string, n int")
    df = df.select("page_id", "url", F.when(F.col("n") == 5, "short").otherwise(F.expr("repeat('0123456789', n div 10)")).alias("html"))
    assert result(warc.archive_pages(df)) == brute([(i, t) for i, _, t in rows])
    warc.write_archives(df, str(tmp_path / "w"))
    assert {p.parent.name for p in (tmp_path / "w").glob("*/*.gz")} == {"0", "1", "2"}


def test_runs_are_sorted_as_they_are_read(spark, small, monkeypatch):
    from fieldloom.sources.staging import shared_path

    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    pages = spark.read.parquet(f"{small}/pages.parquet")
    path = shared_path(spark, "runs")
    warc.write_archives(pages, path)
    rows = warc.read_archives(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).collect()
    for run in {r["run"] for r in rows}:
        mine = sorted((r for r in rows if r["run"] == run), key=lambda r: r["run_at"])
        keys = [(r["url_key"], r["captured"], r["page_id"]) for r in mine]
        assert keys == sorted(keys)
    merged = [(r["url_key"], r["captured"], r["page_id"]) for r in warc.archive_pages(pages).collect()]
    assert merged == sorted((r["url_key"], r["captured"], r["page_id"]) for r in rows)


def test_archives_of_many_members(spark, tmp_path):
    def record(i):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + b"page %d " % i * (1 + i % 50)
        digest = hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(3000)))
    out = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path)))
    assert sorted(r["page_id"] for r in out.collect()) == list(range(3000))


def test_inflate():
    parts = [os.urandom(n) for n in (0, 1, 5000, 300)] + [b"x" * 100_000]
    whole = b"".join(gzip.compress(p) + b"\0" * (i % 2) for i, p in enumerate(parts))
    for step in (1, 7, 1000, 1 << 18):
        assert b"".join(warc._inflate(memoryview(whole), step)) == b"".join(parts)
        assert b"".join(warc._inflate(memoryview(b""), step)) == b""
        with pytest.raises(ValueError):
            list(warc._inflate(memoryview(whole[:-20]), step))


def test_pages_without_an_id(spark):
    page = "<p>" + "z" * 200
    rows = [(1, "http://a.org/x", page), (None, "http://a.org/x", page), (None, "http://a.org/x", page), (None, None, None), (2, "http://b.org", page), (0, "http://a.org/x", "y"), (None, "http://a.org/x", "w")]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted(((r["page_id"], r["url"] or None, r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)
    assert got == sorted(((i, u, hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, u, h in rows), key=str)
    order = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in out]
    assert order == sorted(order)


def test_equal_captures_are_split(spark, monkeypatch):
    """Pages without id and URL, and copies of one page, are as many ranges as any others."""
    monkeypatch.setattr(warc, "RANGE_ROWS", 500)
    monkeypatch.setattr(warc, "SIZES", ((1 << 16, 100), (1 << 22, 64), (1 << 40, 1)))
    for rows in ([(None, None, "")] * 3000, [(7, "http://a.org/x", "same " * 30)] * 3000):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        parts = warc.archive_pages(df).rdd.glom().map(len).collect()
        assert sum(parts) == 3000 and max(parts) <= 1000


def test_pages_are_read_at_most_once_a_class_and_once_for_all(spark, monkeypatch, tmp_path):
    calls = {"payloads": 0, "texts": 0}

    def counted(name, f):
        def g(*a):
            calls[name] += 1
            return f(*a)

        return g

    monkeypatch.setattr(warc, "payloads", counted("payloads", warc.payloads))
    monkeypatch.setattr(warc, "_texts", counted("texts", warc._texts))
    df = spark.createDataFrame([(i, "u", "x" * (70_000 if i % 5 == 0 else 200)) for i in range(20)], "page_id long, url string, html string")
    assert warc.write_archives(df, f"file://{tmp_path}/a") == 20
    assert calls == {"payloads": 1, "texts": 3}
