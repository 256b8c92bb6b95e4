"""Top-k search, WARC archives and URL filters."""

import base64
import gzip
import hashlib
import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelore.llm import topk_search, url_filter, warc
from tablelore.llm.url_filter import Rule
from tablelore.session import shared_dir

VECTORS = "vec_id long, embedding array<double>, score string, rank string, tile string, cell string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *"abcd") for i, v in rows], VECTORS)


def plain_top_k(items, queries, k):
    whole = lambda v: None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(64.0 * x)) for x in v]
    items = [(i, whole(v)) for i, v in items if i is not None and whole(v) is not None]
    out = []
    for q, v in queries:
        if q is None or whole(v) is None:
            continue
        scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole(v), w)))), i) for i, w in items if i != q]
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:k]
        out += [(q, rank, i, s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def check_top_k(spark, rows, asked, k, **sizes):
    got = topk_search.top_k(vectors(spark, rows), vectors(spark, asked), k, **sizes).collect()
    assert sorted(map(tuple, got)) == plain_top_k(rows, asked, k)


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(120)]  # a third are the same vector
    rows += [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [9.0] * 8), (504, []), (505, [1.0, 2.0])]
    rows += [(7, rows[7][1])]  # a repeated row
    check_top_k(spark, rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(600, [-1.0] * 8), (None, [1.0] * 8)], 20)


def test_top_k_in_many_cells(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(150)]
    check_top_k(spark, rows, rows[::6], 7, tile_bytes=8 * 6 * 5, cell=(4, 2))


def test_top_k_of_huge_components_and_few_items(spark):
    rows = [(1, [1e17, -3.0]), (2, [1e17, 5.0]), (3, [-1e17, 1e3]), (4, [0.1, 0.2])]
    check_top_k(spark, rows, rows, 20)


def test_top_k_of_empty_tables(spark):
    rows = [(1, [1.0]), (2, [2.0])]
    assert topk_search.top_k(vectors(spark, []), vectors(spark, rows), 3).collect() == []
    assert topk_search.top_k(vectors(spark, rows), vectors(spark, []), 3).collect() == []


def plain_pages(pages, least):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == data and j is not None]
        last = max(same, default=None)
        revisit = len(data) >= least and last is not None and i != last
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (1, "http://a/", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "x"), (3, "http://a/\r\nX: y", "x"), (4, "http://b/", None),
    (5, "http://b/ c", ""), (None, "http://c/", "x"), (None, "http://d/", "alone"), (7, "u", "long " * 100_000), (8, "u", "long " * 100_000),
    (9, "u", "\n\r\n"), (9, "u", "\n\r\n"), (10, "u", "\x00\x1f🙂"),
]


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, least, tmp_path):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, key string")
    got = warc.archive(pages.repartition(3), f"file://{tmp_path}/w", least).collect()
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=str) == plain_pages(PAGES, least)
    bodies = {(r["page_id"], r["payload_digest"]): r["payload"] for r in warc.read_records(spark, f"file://{tmp_path}/w/records", payload=True).collect()}
    for i, _, html in PAGES:
        data = (html or "").encode()
        body = bodies[i, base64.b32encode(hashlib.sha1(data).digest()).decode()]
        assert body is None or bytes(body) == data


def test_normalised_files(spark, tmp_path):
    """One member a record, an index that names each, and nothing lost from the one stream."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.archive(pages.coalesce(1), f"{tmp_path}/w")
    (stream,) = (tmp_path / "w/stream").glob("*.gz")
    (done,) = (tmp_path / "w/records").glob("*.warc.gz")
    one = zlib.decompressobj(31)
    whole = one.decompress(stream.read_bytes())
    assert one.eof and not one.unused_data  # a single gzip member
    assert gzip.decompress(done.read_bytes()) == whole
    index = [json.loads(x) for x in open(str(done).replace(".warc.gz", ".idx"))]
    data, at = done.read_bytes(), 0
    assert len(index) == len(PAGES)
    for entry in index:
        assert entry["offset"] == at
        member = zlib.decompressobj(31)
        record = member.decompress(data[at : at + entry["length"]])
        assert member.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        at += entry["length"]
    assert at == len(data)
    assert not [f for f in os.listdir(tmp_path / "w/records") if not f.startswith("part-") and not f.endswith(".crc")]


def test_normalise_again_and_empty(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    first = warc.archive(pages, f"{tmp_path}/w").collect()
    warc.normalise(spark, f"{tmp_path}/w/records", f"{tmp_path}/again")  # many members in a file are one stream too
    fields = ("page_id", "payload_digest", "record_type")
    again = warc.read_records(spark, f"{tmp_path}/again").collect()
    assert sorted((tuple(r[f] for f in fields) for r in again), key=str) == sorted((tuple(r[f] for f in fields) for r in first), key=str)
    assert warc.archive(pages.limit(0), f"{tmp_path}/none").collect() == []


def test_broken_archive():
    with pytest.raises(ValueError):
        list(warc.split_records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort"])))


RULES = [
    Rule("allow", "com"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]
URLS = [
    None, "", "no scheme/here", "http://", "http://Example.COM/en/x?q#f", "https://WWW.example.com/en/", "http://notexample.com/en/",
    "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "http://x.org", "http://x.org/", "https://X.org:443/#top", "http://x.org?utm_source=a",
    "http://x.org/p?b=1&utm_medium=q&a=2", "https://x.org/p/?b=1&a=2&ref=z", "http://x.org/p?a=2&b=1", "a://b://c/d", "http://É.org/İ", "x\nhttp://n.org/a\nb",
    "http://x.org/" + "a" * 50_000,
]


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:].split("#", 1)[0]
    path, _, query = tail.partition("?")
    kept = [p for p in query.split("&") if p and not p.startswith(("utm_", "ref="))]
    name = host.removesuffix(":80").removesuffix(":443").removesuffix(":") + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")
    return host, path, name if host else None


def plain_filter(urls, listed):
    known = {plain_url(u)[2] for u in listed} - {None}
    out = []
    for k, u in enumerate(urls):
        host, path, name = plain_url(u)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        verdict = rule.verdict if rule else "block" if name in known else "allow"
        out.append((k, host, path, rule and rule.host + rule.path, verdict, name in known))
    return out


def pages_of(spark, urls):
    return spark.createDataFrame([(k, u, *"abcd") for k, u in enumerate(urls)], "page_id long, url string, host string, hit string, block string, found string")


@pytest.mark.parametrize("broadcast_bytes", [url_filter.BROADCAST_BYTES, 0])
def test_filter_urls(spark, broadcast_bytes):
    listed = ["http://X.org/?utm_campaign=1", "http://x.org/p?b=1&a=2", None, "nothing", "http://b://c/d", "http://a.net/es/1"]
    urls = URLS + URLS[9:12] + [f"http://h{k}.org/{k % 50}" for k in range(400)]
    listed += [f"https://h{k}.org/{k % 50}/" for k in range(0, 400, 3)]
    table = spark.createDataFrame([(u,) for u in listed], "url string")
    got = url_filter.filter_urls(pages_of(spark, urls), table, RULES, broadcast_bytes=broadcast_bytes)
    rows = got.select("page_id", "host", "path", "rule", "verdict", "listed").collect()
    assert sorted(map(tuple, rows)) == plain_filter(urls, listed)
    assert got.where("listed and not possible_hit").count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_few_false_positives(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("http://h/"), "id").alias("url"), F.col("id").alias("page_id"))
    got = url_filter.filter_urls(urls, urls.where("page_id < 2000"), [])
    assert got.where("possible_hit and not listed").count() < 200
    assert got.where("listed").count() == 2000


def test_url_filter_of_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, none, RULES).collect() == []
    assert {r["verdict"] for r in url_filter.filter_urls(pages_of(spark, ["http://x.org/"]), none, RULES).collect()} == {"allow"}


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark)
