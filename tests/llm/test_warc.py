import base64
import gzip
import hashlib
import os

from samples import DATA

from lakequill.llm import warc


def expected(rows):
    largest = {}
    for page_id, _, html in rows:
        p = (html or "").encode()
        if p not in largest or largest[p] is None or page_id is not None and page_id > largest[p]:
            largest[p] = page_id
    out = []
    for page_id, url, html in rows:
        p = (html or "").encode()
        first = largest[p] == page_id or largest[p] is None
        out.append((page_id, url or "", "response" if first else "revisit", None if first else largest[p], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()))
    return sorted(out, key=repr)


def plain(df):
    return sorted(((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in df.collect()), key=repr)


ROWS = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (9, "http://c", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nx", "é" * 3000), (5, "http://e2", "é" * 3000), (None, "n", "lone"), (6, "http://f", "WARC/1.1\r\n\r\n\r\n")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS sha1", "2 AS offset", "3 AS n")
    folder = f"file://{tmp_path}/w"
    got = warc.round_trip(df, folder)
    want = [(p, (u or "").replace("\r", "%0D").replace("\n", "%0A"), *r) for p, u, *r in expected(ROWS)]
    assert plain(got) == sorted(want, key=repr)
    held = {r.page_id: r.payload for r in got.filter("record_type = 'response'").collect()}
    assert bytes(held[9]) == b"<p>x</p>" and bytes(held[5]) == ("é" * 3000).encode()
    whole = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/e").count() == 0


def test_ranges_are_joined_and_selected(spark, tmp_path):
    pages = [(i, f"http://p/{i}", f"<p>{i}</p>" * 200) for i in range(300)]
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.deduplicated(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)), folder, max_file_bytes=4000)
    assert index.select("file").distinct().count() > 2
    got = warc.read_archives(index.filter("page_id % 7 = 0"), folder, max_gap=100, max_range=500).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in got) == [(i, f"<p>{i}</p>" * 200) for i in range(0, 300, 7)]


def test_min_bytes(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.deduplicated(df, 5).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_long_payloads_repeated_pages_and_many_repeats(spark, tmp_path, monkeypatch):
    rows = [(1, "a", "é" * 3_000_000), (1, "a", "é" * 3_000_000), (1, "a", "x"), (2, None, "x"), (3, "c", "é" * 3_000_000)] + [(10 + i, "u", f"{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1_000_000, 0):  # digests broadcast, and joined by a shuffle
        monkeypatch.setattr(warc, "MOST_BROADCAST", most)
        assert plain(warc.round_trip(df, f"file://{tmp_path}/{most}")) == expected(rows)
    whole = b"".join(gzip.decompress((tmp_path / "0" / f).read_bytes()) for f in os.listdir(tmp_path / "0") if f.endswith(".gz"))
    ids = [x for x in whole.split(b"\r\n") if x.startswith(b"WARC-Record-ID: ")]
    assert len(ids) == len(set(ids)) == len(rows)


def test_schemes_of_hadoop(monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "pafs", type("fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(seen.append)})}))
    for uri in ("s3a://bucket/x", "abfss://c@a/x", "file:///x", "hdfs://n/x", "/x"):
        warc.filesystem(uri)
    assert seen == ["s3://bucket/x", "abfs://c@a/x", "file:///x", "hdfs://n/x", "/x"]


def test_whole_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()]
    got = warc.query(spark, f"{DATA}/sf0.001")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[4], r[5], r[2], r[3]) for r in expected(rows))
