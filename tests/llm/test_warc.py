import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from lorequarry.llm import queries, warc
from lorequarry.llm.warc import build_index, lookup, parse, read_archives, read_indexed, url_key, write_archives


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def check(rows, pages, least=0):
    first = {}
    for i, h in pages:
        if i is not None and len((h or "").encode()) >= least:
            first[digest(h)] = min(first.get(digest(h), i), i)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows}
    for i, h in pages:
        size, f = len((h or "").encode()), first.get(digest(h))
        assert got[i] == (size, digest(h), *(("response", None) if f is None or f == i else ("revisit", f)))


def test_the_query_reads_back_what_it_wrote(spark, sf_dir):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = queries.op10_warc(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    check(rows, pages)


def made(spark, tmp_path, rows, **how):
    path = f"file://{tmp_path}/archives"
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "'x' as payload", "'x' as least", "'x' as refers_to")
    captures = write_archives(frame, path, **how)
    build_index(captures, path)
    return captures, path


ROWS = [(1, "http://www.Example.com/a?b=1#f", "<p>é</p>"), (2, "https://example.com:8080/", "<p>é</p>"), (3, None, None), (4, "http://[bad", ""), (5, "http://10.0.0.1/x y", "z" * 3_000_000), (None, "http://n.org/", "<p>é</p>"), (6, "http://www.example.com/a?b=1", "new\r\n\r\nbody"), (7, "http://www.example.com/a?b=1", "<p>é</p>")]


def test_odd_pages_and_small_payloads(spark, tmp_path):
    captures, path = made(spark, tmp_path, ROWS)
    check(read_archives(captures, path).collect(), [(i, h) for i, _, h in ROWS])
    captures, path = made(spark, tmp_path / "b", ROWS, least_payload=100)
    assert {r["record_type"] for r in read_archives(captures, path).collect()} == {"response"}
    captures, path = made(spark, tmp_path / "c", [])
    assert read_archives(captures, path).count() == 0 and list(lookup(spark, path, "http://a/")) == [] and read_indexed(spark, path).count() == 0


def test_lookups_read_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    _, path = made(spark, tmp_path, ROWS)
    got = list(lookup(spark, path, "https://www.example.com/a?b=1"))
    assert sorted((m["page_id"], p) for m, p in got) == [(1, "<p>é</p>".encode()), (6, b"new\r\n\r\nbody"), (7, "<p>é</p>".encode())]
    ((m, p),) = lookup(spark, path, "http://example.com:8080")  # a revisit of a page with another URL
    assert (m["page_id"], m["record_type"], p) == (2, "revisit", "<p>é</p>".encode())
    assert list(lookup(spark, path, "http://nowhere.org/")) == []
    assert spark.read.parquet(f"{path}/directory").count() > 1


def test_the_index_reads_what_a_scan_reads(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i % 5}.org/{i % 11}", f"text {i % 17} " * 90) for i in range(300)] + ROWS
    for least, block in ((8_000_000, 1000), (700, 7)):
        monkeypatch.setattr(warc, "READ_BYTES", least)
        monkeypatch.setattr(warc, "BLOCK_LINES", block)
        captures, path = made(spark, tmp_path / str(block), rows)
        key = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert key(read_indexed(spark, path)) == key(read_archives(captures, path))


def test_archives_are_plain_gzip_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    captures, path = made(spark, tmp_path, [(i, f"http://h{i}.org/", f"text {i} " * 40) for i in range(20)])
    files = sorted(Path(f"{tmp_path}/archives").glob("*.warc.gz"))
    assert len(files) >= 3
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC/1.1\r\n") == 20
    for r in captures.collect():
        data = Path(f"{tmp_path}/archives/{r['archive']}").read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert parse(gzip.decompress(data))[2] == f"text {r['page_id']} ".encode() * 40


def test_a_damaged_record_is_told(spark, tmp_path):
    captures, path = made(spark, tmp_path, [(1, "http://a.org/", "abc" * 100)])
    (file,) = Path(f"{tmp_path}/archives").glob("*.warc.gz")
    text = gzip.decompress(file.read_bytes()).replace(b"abcabc", b"abcabd", 1)
    file.write_bytes(gzip.compress(text))
    with pytest.raises(Exception, match="does not match its digest"):
        read_archives(captures, path).collect()


def test_keys():
    assert url_key("HTTP://WWW.Example.COM:80/Path?Q=1#x") == "com,example,www)/path?q=1"
    assert url_key("http://127.0.0.1/") == "127.0.0.1)/" and url_key(None) == ")/" and url_key("http://a.b:81") == "b,a:81)/"


def test_a_payload_may_be_very_common(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.org/{i}", "same" if i % 3 else f"own {i}") for i in range(3000)]
    captures, path = made(spark, tmp_path, rows)
    check(read_archives(captures, path).collect(), [(i, h) for i, _, h in rows])
