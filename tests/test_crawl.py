"""Pages over HTTP from a server on this machine; vectors in the map that makes index rows."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from tessera.plans import build
from tessera.sources import crawl, discovery


@pytest.fixture
def site():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.monotonic(), self.path))
            root = f"http://127.0.0.1:{self.server.server_port}"
            first = sum(p == self.path for _, p in asked) == 1
            code, body = {
                "/index.xml": (200, f"<sitemapindex><sitemap><loc>{root}/a.xml</loc></sitemap><sitemap><loc>{root}/none.xml</loc></sitemap></sitemapindex>"),
                "/a.xml": (200, "<urlset>" + "".join(f"<url><loc> {root}/docs/{n} </loc></url>" for n in ("good", "good", "flaky", "gone", "big", "moved")) + f"<url><loc>{root}/blog/x</loc></url></urlset>"),
                "/docs/good": (200, "<p>good</p>"),
                "/docs/flaky": (503, "") if first else (200, "<p>at last</p>"),
                "/docs/big": (200, "x" * 3000),
                "/docs/moved": (200, '<meta http-equiv="refresh" content="0; url=good">'),
            }.get(self.path, (404, ""))
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_sites_are_a_data_source(spark, site):
    root, asked = site
    spark.dataSource.register(crawl.SitePages)
    seeds = [{"library": "core", "base": f"{root}/docs/", "sitemap": f"{root}/index.xml"}, {"library": "other", "base": "http://localhost/", "sitemap": root.replace("127.0.0.1", "localhost") + "/nothing.xml"}]
    pages = spark.read.format("site_pages").option("seeds", json.dumps(seeds)).option("delay", "0.05").option("limit", "2000").load()
    assert pages.rdd.getNumPartitions() == 2  # one a host
    asked.clear()
    got = {(r.library, r.url.rpartition("/")[2]): (r.html, r.error and r.error.partition(":")[0]) for r in pages.collect()}
    assert got == {
        ("core", "good"): ("<p>good</p>", None), ("core", "flaky"): ("<p>at last</p>", None), ("core", "gone"): (None, "Permanent"), ("core", "big"): (None, "Permanent"),
        ("core", "moved"): ("<p>good</p>", None), ("core", "none.xml"): (None, "Permanent"), ("other", "nothing.xml"): (None, "Permanent"),
    }
    times = [t for t, p in asked if p != "/nothing.xml"]
    assert min(b - a for a, b in zip(times, times[1:], strict=False)) > 0.045
    assert spark.read.format("site_pages").load().count() == 0


def test_a_host_is_read_by_one_task_at_its_pace(spark, site):
    root, asked = site
    urls = spark.createDataFrame([("l", f"{root}/docs/{n}?{i}") for n in ("good", "gone") for i in range(6)], "library string, url string").repartition(6)
    rows = discovery.fetch_pages(urls, delay=0.05).collect()
    assert len(rows) == 12 and len(asked) == 12
    assert min(b[0] - a[0] for a, b in zip(asked, asked[1:], strict=False)) > 0.045


def test_pace_is_by_host():
    now, waits = [0.0], []

    def wait(seconds):
        waits.append(round(seconds, 3))
        now[0] += seconds

    get = discovery.Pace(lambda url: b"", 2.0, wait, lambda: now[0])
    for url in ("http://a/1", "http://b/1", "http://A:80/2", "http://b/2", "http://c/"):
        get(url)
    assert waits == [2.0]  # by then b is free as well


def test_a_batch_model_needs_no_join(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], np.float32)

    model = build.BatchModel(load, 2)
    units = spark.createDataFrame([(f"k{i}", "x" * i) for i in range(7)], "chunk_key string, text string")
    for c in ("url", "anchor", "content_hash", "kind", "library", "page_title", "source_link", "synopsis", "content"):
        units = units.selectExpr("*", f"'' AS {c}")
    units = units.selectExpr("*", "array('h') AS heading_path", "0 AS part", "0 AS ordinal")
    rows = build.index_rows(units, model, lambda c: build.F.split(c, " "), "v", 4)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.chunk_key: list(r.embedding) for r in rows.collect()} == {f"k{i}": [min(i, 4), 1.0] for i in range(7)}
    assert {r.chunk_key: list(r.embedding) for r in model(units).collect()} == {f"k{i}": [i, 1.0] for i in range(7)}
