"""WARC: round trip, revisits against brute force, hard payloads."""

import gzip
import hashlib
from pathlib import Path

from pixelloom.llm import shared, warc

SCHEMA = "page_id long, url string, html string, record_type string"


def rows():
    big = "x" * 1500
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "\r\n\r\nWARC/1.1\r\n" * 100
    out = [(1, "http://a/", big, "z"), (5, "http://b/", big, "z"), (3, None, big, "z"), (2, "u\r\nX: y", tricky, "z"), (9, "http://c/", tricky, "z")]
    out += [(10, "http://d/", "small", "z"), (11, "http://d/", "small", "z"), (12, "http://e/", None, "z"), (13, None, "", "z")]
    out += [(14, "http://f/", "é" * 500, "z"), (15, "http://f/", "é" * 500, "z"), (16, "http://f/", "é" * 499 + "x", "z"), (17, "http://f/", "é" * 499 + "x", "z")]
    out += [(None, "http://g/", big, "z"), (18, "http://h/", "\r\n" * 600, "z"), (5, "http://b/", big, "z"), (1, "http://a/", big, "z"), (20, "http://i/", "y" * 200_000, None)]
    return out


def brute(data):
    out = []
    for page, _, html, _ in data:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in data if (h or "").encode() == payload and p is not None]
        again = len(payload) >= 1000 and page is not None and page < max(same)
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=repr)


def test_revisits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", ((1 << 10, 4), (1 << 16, 2), (1 << 62, 1)))
    data = rows()
    path = str(tmp_path / "w")
    warc.write_archives(warc.headers(spark.createDataFrame(data, SCHEMA).repartition(3)), path)
    records = warc.read_archives(spark, path)
    payloads = {(r.page_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect()}
    assert payloads <= {(p, (h or "").encode()) for p, _, h, _ in data}
    assert records.where("record_type = 'revisit' and payload is not null").count() == 0
    got = warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == brute(data)
    files = list(Path(path).rglob("part-*.gz"))
    assert len(files) > 3
    assert sum(len(list(warc.parse(gzip.decompress(f.read_bytes())))) for f in files) == len(data)


def test_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(warc.headers(spark.createDataFrame([], SCHEMA)), path)
    assert warc.resolve(warc.read_archives(spark, path)).count() == 0


def test_shared_folder_is_the_sessions(spark):
    own = spark.conf.get("spark.checkpoint.dir", None)
    assert shared.folder(spark) == own if own else shared.folder(spark).startswith("file:///")
