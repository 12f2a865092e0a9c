import base64
import hashlib

from isospan.llm import warc

SCHEMA = "page_id long, url string, html string, key string, file string"


def brute(rows, least=0):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same) if same and len(raw) >= least else None
        refers = first if first is not None and (page_id is None or page_id > first) else None
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in warc.archive_pages(df, **options).collect()), key=str)


ROWS = [
    (5, "http://www.Example.com/a?b=1", "<html>é\r\n\r\nWARC/1.1\r\n</html>"),
    (3, "https://example.com:8080/a b", "<html>é\r\n\r\nWARC/1.1\r\n</html>"),
    (-7, None, None),
    (9, "", ""),
    (None, "http://[bad", ""),
    (None, "x", "only here"),
    (2**62, "http://example.org/\nnew", "x" * 300000),
    (11, "http://a.b/" + "p" * 5000, "long url"),
    (12, "http://a.b/", "twice"),
    (12, "http://a.b/", "twice"),
]


def test_round_trip(spark):
    assert got(spark, ROWS) == brute(ROWS)
    assert got(spark, ROWS, least_bytes=10) == brute(ROWS, 10)
    assert got(spark, []) == []


def test_on_sample(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(spark, rows) == brute(rows)


def test_index_lookup_and_bytes(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    archive = warc.Archive.write(pages, block_lines=4)
    firsts = [r.first_key for r in archive.blocks().collect()]
    assert len(firsts) >= pages.count() // 4
    some = archive.captures.orderBy("page_id").limit(7)
    wanted = some.union(some.selectExpr("concat(key, '0')", "file", "at", "size", "page_id"))
    want = sorted((r.key, r.file, r.at, r.size) for r in some.collect())
    for directory_bytes in (10**6, 600):
        assert sorted(tuple(r) for r in archive.lookup(wanted, directory_bytes).collect()) == want
    html = {r.page_id: r.html for r in pages.collect()}
    for r in archive.read(archive.lookup(some)).collect():
        if r.record_type == "response":
            assert bytes(r.payload).decode() == html[r.page_id]


def test_a_key_that_fills_several_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "INDEX_TASK_ROWS", 20)
    rows = [(None, "http://a.b/", "same")] * 90 + [(i, f"http://h{i % 7}.b/{i}", f"page {i}") for i in range(60)]
    assert got(spark, rows) == brute(rows)
    archive = warc.Archive.write(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), block_lines=4)
    assert archive.blocks().select("run").distinct().count() > 3
    for directory_bytes in (10**6, 200, 1):
        assert archive.lookup(archive.captures, directory_bytes).count() == 150


def test_keys_and_ids():
    assert warc.host_key("http://www.Example.com/a?b=1#c") == "com,example)/a?b=1"
    for page in (0, 7, -7, 2**63 - 1, -(2**63)):
        assert warc.page_of(warc.record_id(page, "x")) == page
    assert warc.page_of(warc.record_id(None, "x")) is None


def test_line_feeds_and_control_characters_in_urls(spark):
    urls = ["foo\nbar", "http://[bad\nx", "\n", "a\x0bb\tc\rd", "http://e.f/\x00\x1f g", "mailto:x\ny", "zz"]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    assert got(spark, rows) == brute(rows)
    assert all(c > " " for u in urls for c in warc.host_key(u))


def test_missing_records_fail(spark, monkeypatch):
    lookup = warc.Archive.lookup
    monkeypatch.setattr(warc.Archive, "lookup", lambda self, keys: lookup(self, keys).limit(1))
    try:
        got(spark, ROWS)
    except RuntimeError:
        return
    raise AssertionError("records were lost without an error")


def test_a_frequent_payload_meets_its_rows_by_broadcast(spark):
    """600 empty pages and others: the smallest id of each payload, whoever brings it."""
    from isospan.llm.warc import with_targets

    rows = [(i if i != 3 else None, None, None if i % 2 else "") for i in range(600)] + [(1000 + i, "u", f"page {i // 2}") for i in range(100)]
    got = {}
    for r in with_targets(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect():
        got.setdefault(r.page_id, []).append(r.refers_to)
    assert len(got) == 700 and got[0] == [None] and got[None] == [0]
    assert all(v == [0] for k, v in got.items() if k is not None and 0 < k < 600)
    assert all(v == [None if k % 2 == 0 else k - 1] for k, v in got.items() if k is not None and k >= 1000)
