"""WARC archives: round trips, index and ranges, odd rows."""

import base64
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import warc

PAGES = "page_id long, url string, html string"


def rows_of(make_long=2000):
    rows = [(i, f"http://a.example/{i}", f"<p>page {i % 7}</p>") for i in range(40)]
    rows += [(100, None, None), (101, "http://b.example/\r\nX-Evil: 1", ""), (None, "http://c.example", "<p>page 1</p>"), (None, "http://d.example", "only null"), (None, None, "only null")]
    rows += [(7, "http://again.example", "<p>page 0</p>"), (200, "u", "é日本𓀀\r\n\r\nWARC/1.1\r\n" * make_long), (201, "u", "twice"), (201, "u", "twice"), (-5, "neg", "twice")]
    return rows


def expected(rows, least=0):
    """Brute force: (page_id, bytes, digest, type, refers_to) of every row."""
    low = lambda x: float("-inf") if x is None else x
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "")]
        top = max(same, key=low)
        response = len(raw) < least or page_id == top
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "response" if response else "revisit", None if response else top))
    return sorted(out, key=repr)


def test_pages_come_back(spark, tmp_path):
    rows = rows_of()
    spark.createDataFrame(rows, PAGES).withColumn("URL2", F.lit(1)).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op11_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_small_payloads_are_no_revisits(spark, tmp_path):
    rows = rows_of(3)
    index = warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"), least=10)
    got = warc.read_records(index, payload=False)
    got = got.select(warc.page_of("record_id"), "payload_bytes", "digest", "record_type", warc.page_of("refers_to"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows, 10)


@pytest.mark.parametrize("salts", [1, 3])
def test_payloads_and_urls(spark, tmp_path, salts):
    pages = spark.createDataFrame(rows_of(), PAGES)
    assert warc.deduplicated(pages, salts=salts).count() == pages.count()
    index = warc.write_archives(pages.repartition(3), str(tmp_path / "a"), roll=600)
    files = [r.file for r in index.select("file").distinct().collect()]
    assert len(files) > 3 and {os.path.basename(f) for f in files} == set(os.listdir(tmp_path / "a"))
    records = {(r.record_type, r.record_id, r.url): r.payload for r in warc.read_records(index).collect()}
    for page_id, url, html in rows_of():
        url = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
        kind = "response" if ("response", warc.record_name(page_id), url) in records else "revisit"
        payload = records[(kind, warc.record_name(page_id), url)]
        assert payload is None if kind == "revisit" else bytes(payload) == (html or "").encode()
    # the index that a scan of the archives gives is the one that was written, and any reader of gzip members sees them
    scanned = warc.index_archives(spark, index.select("file"))
    columns = ["file", "offset", "length", "digest", "record_type", "record_id", "page_id"]
    key = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert key(scanned) == key(index)
    raw = zlib.decompress(open(files[0], "rb").read(), wbits=31)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_selected_ranges_only(spark, tmp_path, monkeypatch):
    index = warc.write_archives(spark.createDataFrame(rows_of(), PAGES).coalesce(1), str(tmp_path / "a"))
    some = index.where("url LIKE '%/1_'")
    got = warc.read_records(some.unionByName(some.where("page_id = 11")), gap=0)
    assert sorted(r.url for r in got.collect()) == sorted([f"http://a.example/{i}" for i in range(10, 20)] + ["http://a.example/11"])
    assert warc.read_records(index.where("false")).collect() == []


def test_runs():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 44, 5), ("b", 49, 5), ("b", 49, 5)]
    assert list(warc.runs(rows, gap=0, most=100)) == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 40, 49, [(40, 5), (44, 5)]), ("b", 49, 54, [(49, 5), (49, 5)])]
    assert [x[1:3] for x in warc.runs(rows, gap=25, most=100)] == [(0, 49), (49, 54)]
    assert [x[1:3] for x in warc.runs(rows, gap=25, most=12)] == [(0, 10), (10, 15), (40, 49), (49, 54)]
    assert list(warc.runs([], 1, 1)) == []


def test_damage_is_seen():
    raw = warc.record("response", 1, "u", b"text", warc.base32_sha1(b"text"), None, "1970-01-01T00:00:00Z")
    assert warc.parsed(raw)["payload"] == b"text"
    for bad in (raw.replace(b"text\r\n\r\n", b"tExt\r\n\r\n"), raw[:-9], b"HTTP" + raw):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    foreign = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert warc.parsed(foreign)["payload"] == b"abc" and warc.parsed(foreign)["digest"] == warc.base32_sha1(b"abc")


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op11_warc(spark, str(tmp_path)).collect() == []
