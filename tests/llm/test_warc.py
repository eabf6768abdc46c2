from __future__ import annotations

import base64
import hashlib

import pytest

from provgraph.llm import warc
from provgraph.llm.common import scratch

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
ROWS = [
    (1, "u", "x" + FAKE + "tail"), (2, "u", "x" + FAKE + "tail"), (3, None, None), (4, "u", ""), (5, "é\r\nx", "ö" * 10), (6, "u", warc.MAGIC),
    (7, "u", warc.MAGIC * 2 + "\r\n\r\n"), (None, "u", "zz"), (8, "u", "x" + FAKE), (9, "u", FAKE), (10, "u", "\r\n\r\n"), (10, "u", "\r\n\r\n"),
    *((i, "u", f"q{i}" + FAKE * (i % 3)) for i in range(100, 160)),
]


def test_against_sql(spark, small, against_sql):
    against_sql(warc.op6_warc(spark, small), warc.OP6_SQL, small)


def want(rows):
    top: dict[str, int | None] = {}
    for i, _, html in rows:
        known = [x for x in (top.get(html or ""), i) if x is not None]
        top[html or ""] = max(known, default=None)
    out = []
    for i, _, html in rows:
        data, best = (html or "").encode(), top[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if best == i else "revisit", None if best == i else best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", ["128m", "700"])
def test_magic_in_payloads(spark, split):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write_warc(df.coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert sorted((tuple(r) for r in warc.read_warc(spark, path).collect()), key=repr) == want(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_shuffled_roles(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write_warc(df, path)
    assert sorted((tuple(r) for r in warc.read_warc(spark, path).collect()), key=repr) == want(ROWS)


def test_min_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "long one"), (4, "u", "long one")], "page_id long, url string, html string")
    path = scratch(spark, "warc-test")
    warc.write_warc(df, path, min_bytes=4)
    assert {r.page_id: r.refers_to for r in warc.read_warc(spark, path).collect()} == {1: None, 2: None, 3: 4, 4: None}
    path = scratch(spark, "warc-test")
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def archive(folder, *parts):
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"".join(p.encode() if isinstance(p, str) else p for p in parts))
    return str(folder)


def record(page, payload, said=None, kind="response"):
    block = "HTTP/1.1 200 OK\r\n\r\n" + payload
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(block.encode()) if said is None else said}\r\n\r\n{block}\r\n\r\n"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


@pytest.mark.parametrize("split", ["128m", "150"])
def test_foreign_files(spark, tmp_path, split):
    """A prefix, a gap, a cut and a wrong length; records end where they say, and chains where no record follows."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    read = lambda *parts: sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, archive(tmp_path / str(len(list(tmp_path.iterdir()))), *parts)).collect())
    try:
        one, two = record(1, "abc"), record(2, "dé")
        assert read(one, two) == [(1, 3, digest("abc")), (2, 3, digest("dé"))]
        assert read("junk", one, two) == []
        assert read(one, "gap", two) == [(1, 3, digest("abc"))]
        assert read(one, two[:-12]) == [(1, 3, digest("abc")), (2, None, None)]
        assert read(record(1, "abcdef", 24), two) == [(1, 5, digest("abcde"))]
        assert read(record(1, "abc", 99_999), two) == [(1, None, None)]
        assert read(record(1, FAKE * 40), two) == [(1, 40 * len(FAKE), digest(FAKE * 40)), (2, 3, digest("dé"))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_clashing_columns(spark):
    """Columns of the pages with the names of the reader's or writer's own give way."""
    df = spark.createDataFrame([(1, "u", "a", "x", 1), (2, "u", "a" * 300_000, "y", 2)], "page_id long, url string, html string, payload string, digest int")
    path = scratch(spark, "warc-test")
    warc.write_warc(df, path)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_warc(spark, path).collect()) == [(1, 1), (2, 300_000)]
