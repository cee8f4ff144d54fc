import gzip
import hashlib

import pytest

from loomwork.llm import warc as w


def brute(rows):
    data = [(p, (h or "").encode()) for p, _, h in rows]
    best = {}
    for i, (p, b) in enumerate(data):
        if len(b) >= 1000 and (b not in best or (p is not None and (data[best[b]][0] is None or p >= data[best[b]][0]))):
            best[b] = i
    out = []
    for i, (p, b) in enumerate(data):
        keep = best.get(b, i)
        same = keep == i
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if same else "revisit", None if same else data[keep][0]))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, no long").repartition(3)
    back = w.read_warc(w.convert(w.write_arc(df, f"file://{tmp_path}/arc"), f"file://{tmp_path}/warc"))
    return back.collect()


def test_round_trip(spark, tmp_path):
    big, other = "é\r\n\r\nWARC/1.1\n" * 200, "x" * 1000
    rows = [
        (1, "http://a/ b", big), (7, None, big), (3, "http://c", big), (4, "u", None), (5, "u", ""), (6, "u", "y" * 999), (8, "u", "y" * 999),
        (9, "u", other), (None, "u", other), (10, "u\n1", big), (11, "u", "z" * 300_000), (12, "u", "z" * 300_000), (10, "u", big),
    ]
    got = run(spark, rows, tmp_path)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(rows)
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(rows)
    for r in got:
        if r.record_type == "revisit":
            assert ids[r.refers_to_record].record_type == "response" and ids[r.refers_to_record].payload_digest == r.payload_digest
    assert {r.url for r in got} >= {"http://a/%20b", "-", "u%0A1"}
    assert {r.warc_date for r in got if r.page_id == 7} == {"2000-01-01T00:00:07Z"}


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_both_versions_parse_by_declared_length(tmp_path):
    for version in (1, 2):
        path = tmp_path / f"v{version}.arc.gz"
        body = [b"a\nb 1 2 3\n\n", b"", b"tail"]
        parts = [w.arc_head(version, "n")] + [w.arc_record(version, "n", 0, i, "http://x", b) for i, b in enumerate(body)]
        path.write_bytes(b"".join(gzip.compress(p) for p in parts))
        got = list(w.read_arc(f"file://{path}"))
        assert [w.split_http(b)[2] for _, b in got] == body
        assert all(h["version"] == version and h["date"].startswith("20000101") for h, _ in got)
        path.write_bytes(gzip.compress(b"".join(parts)[:-10]))
        with pytest.raises(ValueError):
            list(w.read_arc(f"file://{path}"))


def test_records_of_other_archives(spark, tmp_path):
    page = b"<p>caf\xe9</p>" * 200
    blocks = [
        (b"dns:example.org 1.2.3.4 20010101 text/dns", b"20010101\nexample.org. 300 IN A 1.2.3.4\n"),
        (b"http://example.org/a b\xe9 1.2.3.4 20010101020304 text/html", b"HTTP/1.0 200 OK\r\nServer: caf\xe9\r\nX-Long: one\r\n\ttwo\r\nno colon here\r\nX-Page-Id: x1\r\n\r\n" + page),
        (b"http://example.org/c 1.2.3.4 20010101020305 text/html", b"HTTP/1.0 200 OK\nServer: x\n\n" + page),
        (b"http://example.org/d 1.2.3.4 20010101020306 text/html", b"HTTP/1.0 204 No Content"),
        (b"ftp://example.org/e 1.2.3.4 20010101020307 application/octet-stream", page),
    ]
    path = tmp_path / "old.arc.gz"
    path.write_bytes(b"".join([gzip.compress(w.arc_head(1, "old")), *[gzip.compress(h + b" %d\n" % len(b) + b + b"\n") for h, b in blocks]]))
    files = spark.createDataFrame([(f"file://{path}",)], "path string")
    got = {r.url: r for r in w.read_warc(w.convert(files, f"file://{tmp_path}/warc")).collect()}
    assert len(got) == 5 and {u: r.record_type for u, r in got.items()} == {
        "dns:example.org": "resource", "http://example.org/a b\ufffd": "revisit", "http://example.org/c": "response", "http://example.org/d": "response",
        "ftp://example.org/e": "resource",
    }
    assert got["http://example.org/a b\ufffd"].payload_digest == hashlib.sha1(page).hexdigest() == got["ftp://example.org/e"].payload_digest
    assert got["http://example.org/a b\ufffd"].payload_bytes == len(page) and got["dns:example.org"].warc_date == "2001-01-01T00:00:00Z"
    heads, http, payload = w.split_http(blocks[1][1])
    assert heads["x-long"] == "one two" and payload == page and http + payload == blocks[1][1] and w.page_of(heads) is None
