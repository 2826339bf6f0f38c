import gzip
import hashlib

import pytest

from pulse.llm import warc
from pulse.llm.shared import file_system
from pulse.session import shared_dir

BIG, WIDE = "x" * 2000, "é" * 700
PAGES = [
    (1, "http://a.b.com/x", BIG),
    (2, "http://a.b.com/x", BIG),
    (3, None, BIG),
    (4, "http://é.com/ü\n?q=1", None),
    (5, "weird", "s"),
    (6, "weird", "s"),
    (7, "http://a.b.com/" + "p" * 500, WIDE),
    (8, "http://a.b.com/" + "p" * 500 + "q", WIDE),
    (8, "http://a.b.com/" + "p" * 500 + "q", WIDE),
    (None, "https://user@Host.ORG:8080?x", "y" * 999),
    (None, "http://none/", "z" * 1500),
    (None, "http://none/", "z" * 1500),
    (9, "http://long/", "long " * 200_000),
] + [(100 + k, "http://hot.com/", f"h{k}") for k in range(50)]


def brute(rows):
    largest = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            largest[data] = max(largest.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = data in largest and largest[data] != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", largest[data] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [warc.Settings(), warc.Settings(block_lines=3, key_bytes=8, file_bytes=500, ahead=100)])
def test_archive_reads_back(spark, settings):
    # Extra columns whose names the operator uses itself do not matter.
    pages = spark.createDataFrame([(*r, "k", 1, "p") for r in PAGES], "page_id long, url string, html string, key string, offset long, path string")
    found = warc.archived(pages.repartition(3), shared_dir(spark, "archive"), settings).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute(PAGES)


def test_lookup_finds_the_captures_of_a_url(spark):
    pages, folder = spark.createDataFrame(PAGES, "page_id long, url string, html string"), shared_dir(spark, "archive")
    settings = warc.Settings(block_lines=4)
    captures = warc.write(pages, folder, settings)
    directory = warc.index(captures, folder, settings)
    keys = [("com,hot)/",), ("com,b,a)/x",), ("none)/",), ("com,absent)/",), ("",), ("zzz",)]
    hits = warc.lookup(spark.createDataFrame(keys, "key string"), directory, folder, settings)
    counts = {r["key"]: r["count"] for r in hits.groupBy("key").count().collect()}
    assert counts == {"com,hot)/": 50, "com,b,a)/x": 2, "none)/": 2, "": 1}
    rows = warc.fetch(hits.where("key = 'com,hot)/'"), folder).collect()
    assert {r.payload.decode() for r in rows} == {f"h{k}" for k in range(50)}


def test_files_are_plain_warc(spark):
    folder = shared_dir(spark, "archive")
    captures = warc.write(spark.createDataFrame([(1, "http://a/", "hello")], "page_id long, url string, html string"), folder)
    system, place = file_system(f"{folder}/{captures.first().path}")
    with system.open_input_file(place) as file:
        text = gzip.decompress(file.read()).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("\r\n\r\nhello\r\n\r\n")
    assert "WARC-Target-URI: http://a/\r\n" in text and "WARC-Payload-Digest: sha1:" in text


def test_keys():
    assert warc.reversed_host("http://www.Example.com:80/A?b#c") == "com,example,www:80)/A?b#c"
    assert warc.reversed_host("https://host") == "host)/" and warc.reversed_host(None) == ""
    assert warc.reversed_host("http://h/a b\t") == "h)/a%20b%09"


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages, shared_dir(spark, "archive")).count() == 0


def test_one_payload_on_most_pages_is_spread(spark):
    """Hot payloads are revisits before they are packed, and their records are in the files of many tasks."""
    body = "the same error page " * 100
    rows = [(k, f"http://h{k}/", body if k % 3 else f"{k} " * 400) for k in range(3000)] + [(9000 + k, "http://p/", "twice " * 300) for k in range(2)]
    pages, folder = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), shared_dir(spark, "archive")
    captures = warc.write(pages, folder)
    files = [r["count"] for r in captures.groupBy("path").count().collect()]
    assert sum(files) == len(rows) and max(files) < len(rows) / 2
    found = warc.fetch(captures, folder, with_payload=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute(rows)
    # As no payload is hot, each meets its response by digest.
    cold = warc.Settings(hot_share=1.0)
    again = warc.archived(pages, shared_dir(spark, "archive"), cold).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in again), key=str) == brute(rows)
