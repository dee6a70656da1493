import gzip

import pytest

from tidemark.llm import shared, warc
from tidemark.llm.queries import op4_warc

HTML = ["", "<p>a</p>", "<p>a</p>", "WARC/1.0\r\nWARC-Type: response\r\n\r\nx\r\n\r\n", "a\n\nb\r\n\r\nhttp://x 0.0.0.0 20240101000000 text/html 3\n", "é🙂\n" * 2000, None, "", "\n", "x" * 200_000]


def test_pages_come_back(spark, tmp_path):
    rows = [(i, f"http://a b/{i}", h, 0) for i, h in enumerate(HTML)] + [(1, "u", "<p>a</p>", 0), (None, None, "<p>a</p>", 0), (77, None, "\x00\x01 odd", 0)]
    spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in op4_warc(spark, str(tmp_path)).collect()), key=repr)
    smallest = {}
    for i, _, h, _ in rows:
        if i is not None:
            smallest[h or ""] = min(i, smallest.get(h or "", i))
    want = [(i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if i == smallest[h or ""] else "revisit", None if i == smallest[h or ""] else smallest[h or ""]) for i, _, h, _ in rows]
    assert got == sorted(want, key=repr)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op4_warc(spark, str(tmp_path)).count() == 0


@pytest.fixture
def arc(tmp_path):
    def put(*files):
        for i, lines in enumerate(files):
            (tmp_path / f"{i}.gz").write_bytes(gzip.compress(lines))
        return f"file://{tmp_path}"

    return put


V1 = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 15\n1 0 x\nURL IP-a\n\n"
V2 = b"filedesc://b.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 b.arc 6\n2 0 x\n\n"


def test_versions_errors_and_types(spark, arc):
    path = arc(
        V1 + b"http://a/ 1.2.3.4 20010203040506 text/html 30\nHTTP/1.0 200 OK\r\n\r\nhello\nworld\nhttp://bad line\n\nhttp://b/ 1.2.3.4 20010203040506 text/plain 3\nabc\nhttp://c/ 1.2.3.4 20010203040506 text/plain 99\nshort\n",
        V2 + b"http://d/ 1.2.3.4 20010203040506 text/html 200 c - 0 b.arc 4\na\n\nb\n",
    )
    rows = {r.url: r for r in warc.read_arc(spark, path).collect()}
    assert bytes(rows["http://a/"].payload) == b"hello\nworld" and bytes(rows["http://a/"].head) == b"HTTP/1.0 200 OK\r\n\r\n"
    assert bytes(rows["http://b/"].payload) == b"abc" and bytes(rows["http://d/"].payload) == b"a\n\nb"
    assert sorted(r.kind for r in rows.values()) == ["error", "error", "filedesc", "filedesc", "record", "record", "record"]
    out = shared.shared_folder(spark, "warc")
    assert warc.convert(spark, path, out) == 2  # error rows, which are not converted
    back = {r.uri: r for r in warc.read_warc(spark, out, payload=True).collect() if r.type != "warcinfo"}
    assert {u: (r.type, bytes(r.payload), r.date, r.whole) for u, r in back.items()} == {"http://a/": ("response", b"hello\nworld", "2001-02-03T04:05:06Z", True), "http://b/": ("resource", b"abc", "2001-02-03T04:05:06Z", True), "http://d/": ("resource", b"a\n\nb", "2001-02-03T04:05:06Z", True)}


def test_plain_files_are_refused(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(V1)
    with pytest.raises(Exception, match="not a gzip file"):
        warc.read_arc(spark, f"file://{tmp_path}").collect()


def test_ids_differ_with_the_payload(spark):
    arc, out = shared.shared_folder(spark, "arc"), shared.shared_folder(spark, "warc")
    rows = [(None, "http://a/", "one"), (None, "http://a/", "two"), (3, "http://a/", "one"), (3, "http://a/", "two"), (3, "http://a/", "two"), (None, None, None)]
    warc.write_arc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), arc)
    assert warc.convert(spark, arc, out) == 0
    back = [r for r in warc.read_warc(spark, out, payload=True).collect() if r.type != "warcinfo"]
    assert len(back) == 6 and len({r.record_id for r in back}) == 5
