import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc as A

SCHEMA = "page_id long, url string, html string, row string, type string, key string"


def folder(tmp_path):
    return f"file://{tmp_path}/archives"


def digests(spark, tmp_path, pages):
    df = spark.createDataFrame([(*p, "c", "d", "e") for p in pages], SCHEMA)
    A.write_archives(df, folder(tmp_path), key="page_id", payload="html", url="url")
    out = A.capture_digests(spark, folder(tmp_path)).collect()
    return sorted(((r.key and int(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in out), key=repr)


def brute(pages):
    out, groups = [], {}
    for i, (k, _, h) in enumerate(pages):
        groups.setdefault(h or "", []).append((k is None, k or 0, i))
    for h, rows in groups.items():
        rows.sort()
        n, sha = len(h.encode()), hashlib.sha256(h.encode()).hexdigest()
        for place, (none, k, _) in enumerate(rows):
            again = n >= 100 and place > 0
            out.append((None if none else k, n, sha, "revisit" if again else "response", rows[0][1] if again and not rows[0][0] else None))
    return sorted(out, key=repr)


def test_round_trip_of_odd_pages(spark, tmp_path):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 4
    pages = [(5, "http://a.b/c", "x" * 100), (3, "http://a.b/d?e#f", "x" * 100), (9, None, "x" * 99), (10, "", "x" * 99), (1, "no scheme", None), (2, "http://e\r\nEvil: 1", "")]
    pages += [(20, "u", tricky), (21, "u", tricky), (22, "http://ü.de/ä", "ü€😀" * 30), (23, None, "ü€😀" * 30), (24, "u", "\x00\r\n\r\n\x1f\x8b" * 40), (25, "u", "long é\n" * 400_000)]
    pages += [(None, "u", "y" * 200), (None, "u", "y" * 200), (None, "u", "x" * 100), (7, "u", "z" * 150), (7, "v", "z" * 150), (7, "v", "other")]
    assert digests(spark, tmp_path, pages) == brute(pages)


def test_no_pages_and_one_payload_in_most(spark, tmp_path):
    assert digests(spark, tmp_path / "a", []) == []
    pages = [(i, "u", "same " * 50) for i in range(300)] + [(300 + i, "u", f"page {i} " * 30) for i in range(20)]
    assert digests(spark, tmp_path / "b", pages) == brute(pages)


def test_payloads_come_back_nested(spark, tmp_path):
    pages = [(i, f"http://h/{i}", "\r\n\r\n".join("abc"[: i + 1]) * 60) for i in range(3)] + [(7, "http://h/7", "a" * 60), (8, "http://h/8", "a\r\n\r\nb" * 60)]
    A.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder(tmp_path), key="page_id", payload="html", url="url")
    found = {r.metadata[0].payload.decode().strip(): r for r in A.assemble(A.read_records(spark, folder(tmp_path))).collect()}
    assert sorted(found) == [f"key: {i}" for i in (0, 1, 2, 7, 8)]
    for i, url, html in pages[:4]:
        r = found[f"key: {i}"]
        assert (r.response.type, bytes(r.response.payload).decode(), r.response.target_uri) == ("response", html, url)
        assert r.response.http.startswith("HTTP/1.1 200 OK") and r.requests[0].http == f"GET /{i} HTTP/1.1\r\nHost: h"
        assert r.requests[0].concurrent_to == r.metadata[0].concurrent_to == [r.record_id]
    again = found["key: 8"].response
    assert (again.type, again.refers_to, bytes(again.payload)) == ("revisit", found["key: 1"].record_id, b"") and again.payload_digest == found["key: 1"].response.payload_digest


def test_archives_are_plain_warc(spark, tmp_path):
    A.write_archives(spark.createDataFrame([(1, "http://h/", "body " * 30)], "k long, u string, p string"), folder(tmp_path), key="k", payload="p", url="u")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "archives").glob("*.gz") if p.stat().st_size)
    assert text.count(b"WARC/1.1\r\n") == 3 and text.endswith(b"key: 1\r\n\r\n\r\n") and b"\nWARC-Type: response\r\n" in text


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_records_of_other_archives(size):
    def record(kind, block, *lines):
        return b"\r\n".join([b"WARC/1.0", b"warc-type: " + kind, *lines, b"content-length:  %d" % len(block), b"", block]) + b"\r\n\r\n"

    text = record(b"warcinfo", b"") + record(b"resource", b"\r\n\r\nx\r\n\r\n", b"A: b: c") + b"\r\n" + record(b"response", b"z" * 5000)
    cut = lambda text: list(A.cut_records(text[i : i + size] for i in range(0, len(text), size)))
    whole = cut(text)
    assert [(b, w) for _, b, w in whole] == [(b"", True), (b"\r\n\r\nx\r\n\r\n", True), (b"z" * 5000, True)]
    assert A.header_lines(whole[1][0])[1] == ("a", "b: c")
    assert cut(text[:-1000])[2][2] is False and cut(text[:30])[0][2] is False and cut(b"") == []
    assert cut(b"no archive\r\n\r\n")[0][2] is False
    members = gzip.compress(text[:100]) + gzip.compress(text[100:]) + bytes(20)
    assert list(A.cut_records(A._unpacked(members))) == whole


def test_links_either_way_and_orphans(spark):
    rows = [("a", "response", ["r"]), ("r", "request", []), ("m", "metadata", ["a"]), ("n", "metadata", ["gone"]), ("b", "revisit", []), ("b", "revisit", []), (None, "response", []), ("w", "warcinfo", ["a"])]
    df = spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")
    got = {r.record_id: (r.response and r.response.type, [x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in A.assemble(df).collect()}
    assert got == {"a": ("response", ["r"], ["m"]), "gone": (None, [], ["n"]), "b": ("revisit", [], [])}
    assert A.assemble(df.filter(F.lit(False))).count() == 0
