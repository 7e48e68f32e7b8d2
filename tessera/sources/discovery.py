"""Inventories, sitemaps and fetched pages as DataFrames."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Config

# The published line format of a version-2 inventory.
_line = re.compile(r"(.+?)\s+(\S+)\s+(-?\d+)\s+?(\S*)\s+(.*)")
_HEADER = b"# Sphinx inventory version 2"
ENTRY = "library string, name string, role string, page_url string, anchor string"


def inventory_entries(data: bytes, base: str) -> list[tuple[str, str, str, str]]:
    """(name, role, page url, anchor) of an inventory; another header is an error, an odd line is skipped."""
    lines = data.split(b"\n", 4)
    if not lines[0].startswith(_HEADER):
        raise ValueError(f"not a version 2 inventory: {lines[0][:50]!r}")
    out = []
    for line in zlib.decompress(lines[4]).decode().splitlines():
        hit = _line.match(line.rstrip())
        if hit:
            name, role, _, place, _ = hit.groups()
            place = place[:-1] + name if place.endswith("$") else place
            page, _, anchor = place.partition("#")
            out.append((name, role, f"{base.rstrip('/')}/{page}", anchor))
    return out


def parse_inventories(files: DataFrame) -> DataFrame:
    """Entries of (library, base, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b.itertuples(index=False):
                rows = [(f.library, *e) for e in inventory_entries(bytes(f.content), f.base)]
                yield pd.DataFrame(rows, columns=["library", "name", "role", "page_url", "anchor"])

    return files.select("library", "base", "content").mapInPandas(run, ENTRY)


def sitemap_urls(xml: Column) -> Column:
    """Each entry's own location, whatever the namespace; nested image locations are not pages."""
    found = F.xpath(xml, F.lit("/*/*[local-name()='url' or local-name()='sitemap']/*[local-name()='loc'][text()][1]/text()"))
    return F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def is_sitemap_index(xml: Column) -> Column:
    return F.xpath_boolean(xml, F.lit("/*[local-name()='sitemapindex']"))


def sitemap_pages(sitemaps: DataFrame, fetched: DataFrame) -> DataFrame:
    """(library, url): pages of (library, xml), one level of index followed among ``fetched`` (url, xml)."""
    urls = sitemaps.select("library", is_sitemap_index(F.col("xml")).alias("index"), F.explode(sitemap_urls(F.col("xml"))).alias("url"))
    below = urls.where("index").join(fetched, "url").select("library", F.explode(sitemap_urls(F.col("xml"))).alias("url"))
    return urls.where("not index").select("library", "url").union(below).distinct()


def discovered(inventory: DataFrame, sitemap: DataFrame, seeds: DataFrame) -> DataFrame:
    """(library, url): .html pages of inventories and sitemap pages below their library's base."""
    own = inventory.where(F.endswith("page_url", F.lit(".html"))).select("library", F.col("page_url").alias("url"))
    below = sitemap.join(seeds.select("library", "base"), "library").where(F.startswith("url", F.col("base"))).select("library", "url")
    return own.union(below).distinct()


class Permanent(Exception):
    """A failure that another try will not mend."""


def http_get(url: str, timeout: float = 30.0, limit: int = Config.page_bytes) -> bytes:
    """One GET with a cap on the body; 4xx but 429 is permanent."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "tessera"}), timeout=timeout) as answer:
            body = answer.read(limit + 1)
    except HTTPError as e:
        if e.code < 500 and e.code != 429:
            raise Permanent(f"{url}: {e.code}") from e
        raise
    if len(body) > limit:
        raise Permanent(f"{url}: over {limit} bytes")
    return body


def fetch(url: str, get: Callable[[str], bytes] = http_get, tries: int = Config.fetch_tries, wait: Callable[[float], None] = time.sleep) -> bytes:
    """Up to ``tries`` attempts, with pauses of 1, 2, 4 ... seconds."""
    for n in range(tries):
        try:
            return get(url)
        except (Permanent, ValueError):
            raise
        except Exception:
            if n + 1 == tries:
                raise
            wait(2.0**n)
    raise ValueError("tries must be positive")


class Pace:
    """``get`` with at least ``delay`` seconds between two requests to one host, other tries and hops included."""

    def __init__(self, get: Callable[[str], bytes], delay: float, wait: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.get, self.delay, self.wait, self.clock = get, delay, wait, clock
        self.free: dict[str | None, float] = {}

    def __call__(self, url: str) -> bytes:
        host = urlsplit(url).hostname
        pause = self.free.get(host, 0.0) - self.clock()
        if pause > 0:
            self.wait(pause)
        try:
            return self.get(url)
        finally:
            self.free[host] = self.clock() + self.delay


def fetched_page(url: str | None, get: Callable[[str], bytes], wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(html, error) of a page: one of them is null.  Bytes that are no UTF-8 become replacement characters."""
    try:
        return fetch(url, get, wait=wait).decode("utf-8", "replace"), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:500]


PAGE = "library string, url string, html string, error string"


def fetch_pages(urls: DataFrame, get: Callable[[str], bytes] = http_get, delay: float = Config.crawl_delay, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(library, url, html, error) of (library, url): a page that fails has its error and does not end the crawl.

    With a ``delay`` all pages of a host are read by one task, whose requests to that host are at least so
    far apart; hosts of one task take turns as their pages come, so one does not wait for another.  Without
    one there is no rate to keep and rows stay where they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paced = Pace(get, delay, wait) if delay > 0 else get
        for b in batches:
            rows = [(r.library, r.url, *fetched_page(r.url, paced, wait)) for r in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["library", "url", "html", "error"])

    rows = urls.select("library", "url")
    if delay > 0:
        host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), host)
    return rows.mapInPandas(run, PAGE)


def snapshot_first(pages: DataFrame, live: DataFrame) -> DataFrame:
    """(url, body): the snapshot's page, else the live one."""
    both = pages.select("url", F.col("body").alias("own")).join(live.select("url", F.col("body").alias("other")), "url", "full_outer")
    return both.select("url", F.coalesce("own", "other").alias("body"))


def follow_live(url: str, get: Callable[[str], bytes], hops: int = Config.redirect_hops, wait: Callable[[float], None] = time.sleep) -> str:
    """The page behind at most ``hops`` client-side redirects; one that comes back to a page seen before,
    or that cannot be read, ends at the page before it."""
    from tessera.operators.html import redirect_of

    page, seen, at = fetch(url, get, wait=wait).decode("utf-8", "replace"), {url}, url
    for _ in range(hops):
        target = redirect_of(page, at)
        if target is None or target in seen:
            break
        try:
            page = fetch(target, get, wait=wait).decode("utf-8", "replace")
        except Exception:
            break
        seen.add(target)
        at = target
    return page


def live_pages(urls: DataFrame, get: Callable[[str], bytes] = http_get, delay: float = Config.crawl_delay, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Snapshot rows of (library, url) read now, redirects followed; a page that fails drops out."""
    from tessera.operators.html import clean_pages

    once = lambda url: follow_live(url, get, wait=wait).encode()
    raw = fetch_pages(urls, once, delay, wait).where("html is not null")
    return clean_pages(raw, F.col("library"))


def read_through(urls: DataFrame, pages: DataFrame, cache: DataFrame | None = None, **live) -> DataFrame:
    """Snapshot rows of (library, url): from the snapshot, else from ``cache`` (earlier live pages), else read now.

    Write what was read now to the cache to ask for it once.
    """
    columns = ["url", "title", "library", "content_hash", "crawled_at", "body"]
    held = pages.select(*columns, F.lit(0).alias("_place"))
    if cache is not None:
        held = held.unionByName(cache.select(*columns, F.lit(1).alias("_place")))
    own = held.join(urls.select("url").distinct(), "url", "left_semi")
    first = own.groupBy("url").agg(F.min_by(F.struct(*columns[1:]), "_place").alias("p")).select("url", "p.*")
    return first.unionByName(live_pages(urls.join(first, "url", "left_anti"), **live).select(*columns))
