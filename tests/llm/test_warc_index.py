import hashlib

from celerix.llm import warc_index as X
from celerix.llm.common import work_dir

PAGES = [
    (5, "https://www.example.org/a?b=1", "x" * 200),
    (3, "http://example.org:8080/a b", "x" * 200),
    (9, "https://sub.example.org/", "x" * 200),
    (1, "https://example.com/ü", "short"),
    (2, "https://example.com/ü", "short"),
    (4, None, None),
    (6, "not a url", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20),
    (7, "http://[bad", ""),
    (None, "https://example.org/a?b=1", "x" * 200),
    (8, "https://example.com/long", "long " * 200000),
    (10, "https://example.org/dup", "y" * 100),
    (10, "https://example.org/dup", "y" * 100),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def want(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        first = min(same, default=None)
        revisit = len(raw) >= 100 and first is not None and page != first
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    directory = X.archive(spark, pages(spark))
    got = X.read_archives(directory, with_payload=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want(PAGES)
    by = {(r["page_id"], r["record_type"]): bytes(r["payload"]) for r in got}
    for page, _, html in PAGES:
        if (page, "response") in by:
            assert by[page, "response"] == (html or "").encode()
    assert X.read_archives(X.archive(spark, pages(spark).limit(0))).count() == 0


def test_lookup_by_bisection(spark):
    many = [(100 + k, f"https://h{k % 40}.example.net/{k}", f"page {k}") for k in range(300)] + PAGES
    captures = X.write_archives(pages(spark, many), work_dir(spark, "t") + "/a")
    directory = X.write_index(captures, work_dir(spark, "t") + "/i", block=8)
    assert directory.count() >= 30
    for index in (X.CaptureIndex(directory).load(), X.CaptureIndex(directory)):
        for page, url, html in [many[0], many[77], many[299]]:
            assert [(r["page_id"], r["payload"]) for r in index.lookup(url)] == [(page, html.encode())]
        hits = index.lookup("https://example.org/a?b=1")
        assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in hits] == [(5, "revisit", 3), (None, "revisit", 3)]
        assert index.lookup("https://example.org/none") == []


def test_keys_reverse_the_host():
    assert X.surt("http://WWW.Example.org:80/A?x=1") == "org,example)/A?x=1"
    assert X.surt("https://a.b.example.org:8080") == "org,example,b,a:8080)/" and X.surt(None) == ""
