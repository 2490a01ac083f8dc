"""Cases that earlier versions of operators 1, 2, 3 and 9 got wrong."""

import gzip

import pytest
from pyspark.sql import functions as F

from hearthlake.llm import decontaminate, mixing, url_filter, warc

DOCS = "doc_id long, text string, source string, key string"


@pytest.mark.parametrize("ids", ["null", "equal", "same row"])
def test_mix_meets_targets_whatever_the_ids(spark, ids):
    rows = [(k, "w " * (5 + k % 9), "a", "x") for k in range(900)]
    of = {"null": lambda k: None, "equal": lambda k: 3 * 10**6, "same row": lambda k: 7}[ids]
    text = {"same row": lambda k: "u " * 10}.get(ids, lambda k: "u " * (3 + k % 20) + str(k))
    rows += [(of(k), text(k), "b", "x") for k in range(600)]
    table = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mixing.mix(table, mixing.cyclic_weights(5, 2), share=0.9, epochs=2)
    taken = {r.source: (r.taken, r.target) for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(t - target) <= 25 and target > 0 for t, target in taken.values()), taken
    with_rows = mixing.mix(table, mixing.cyclic_weights(5, 2), share=0.9, epochs=2, columns=table.columns)
    sums = with_rows.select("row.source", F.size(F.split(F.trim("row.text"), " ")).alias("n"), "taken_times").groupBy("source").agg(F.sum(F.expr("n * taken_times")).alias("t")).collect()
    assert all(abs(r.t - taken[r.source][1]) <= 25 for r in sums)


PAGE = "page_id long, url string, html string, host string"


def links(spark, html):
    rows = spark.createDataFrame([(1, "http://a.com/x", html, None)], PAGE)
    return sorted(r.b for r in url_filter.page_links(rows).collect())


def test_links_as_pages_state_them(spark):
    assert links(spark, '<link rel="canonical" href="http://b.com/p?a=1&amp;b=2">') == ["b.com/p?a=1&b=2"]
    assert links(spark, "<link href='/p?q=&#x26;&#47;' rel='nofollow Canonical'>") == ["a.com/p?q=&/"]
    assert links(spark, '<!-- <link rel="canonical" href="http://b.com/"> --><LINK REL=canonical HREF=http://c.com/>') == ["c.com/"]
    assert links(spark, '<link rel="canonicalized" href="http://b.com/"><link data-rel="canonical" href="http://c.com/">') == []
    assert links(spark, '<meta http-equiv="refresh" content="0; url=http://b.com/?x=1&amp;amp;y">') == ["b.com/?x=1&amp;y"]
    assert links(spark, "<!-- open <link rel=canonical href=http://b.com/>") == []


def test_aliases_meet_through_entities(spark):
    pages = [(1, "http://blocked.org/p?a=1&b=2", "", None), (2, "http://alias.io/", '<link rel="x canonical" href="http://blocked.org/p?a=1&amp;b=2">', None)]
    a, b = (sorted(r) for r in zip(*((r.a, r.b) for r in url_filter.page_links(spark.createDataFrame(pages, PAGE)).collect()), strict=True))
    assert a == ["alias.io/"] and b == ["blocked.org/p?a=1&b=2"]


def test_archives_of_others_are_read(spark, tmp_path):
    def record(kind, ident, block, more=b""):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <" + ident + b">\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"Content-Type: application/http; msgtype=response\r\n"
    records = [
        record(b"warcinfo", b"urn:i", b"software: x\r\nformat: WARC 1.0\r\n", b"Content-Type: application/warc-fields\r\n"),
        record(b"request", b"urn:q", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"Content-Type: application/http; msgtype=request\r\n"),
        record(b"response", b"urn:r", b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\nhello", http),
        record(b"response", b"urn:s", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", http + b"WARC-Payload-Digest: sha256:00\r\n"),
        record(b"metadata", b"urn:m", b"", b""),
        record(b"resource", b"urn:b", bytes(range(256)) * 9, b"Content-Type: image/png\r\n"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    files = spark.createDataFrame([("x.warc.gz",)], "file string")
    got = {r.record_id: r for r in warc.whole_records(files, f"file://{tmp_path}").collect()}
    assert {k: (r.record_type, r.bytes_so_far, r.stated_digest) for k, r in got.items()} == {
        "urn:i": ("warcinfo", 31, None), "urn:q": ("request", 0, None), "urn:r": ("response", 5, None), "urn:s": ("response", 2, None), "urn:m": ("metadata", 0, None), "urn:b": ("resource", 2304, None),
    }


def test_long_windows_are_refused(spark):
    rows = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    with pytest.raises(ValueError, match="window"):
        decontaminate.contamination(rows, rows.withColumnRenamed("doc_id", "item_id"), window=14)


@pytest.mark.parametrize("edges", [1 << 20, 4])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, edges):
    """What one task holds is contracted at once; more goes through rounds with the same result."""
    import random

    from hearthlake.llm import components

    monkeypatch.setattr(components, "EDGES", edges)
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            u, v = sorted((find(a), find(b)))
            parent[v] = u
    want = {x: find(x) for x in parent}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
