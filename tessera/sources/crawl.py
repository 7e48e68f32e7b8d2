"""Sites as a data source: ``spark.read.format("site_pages")``, one partition a host.

Register it with ``spark.dataSource.register(SitePages)``.  Options:

``seeds``   JSON list of {"library", "base", "sitemap"}; the seeds of a host are one partition
``delay``   seconds between two requests to a host (default ``Config.crawl_delay``)
``limit``   bytes of a body, more is an error (default ``Config.page_bytes``)
``hops``    client-side redirects that are followed (default ``Config.redirect_hops``)

Rows are (library, url, html, error): the pages of each sitemap below the seed's base, one level of a sitemap
index followed, each page once a seed.  A page that cannot be read has its error; a sitemap that cannot be read is one row
with its own address and error.  A partition that is tried again reads its sites again from the start.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import urlsplit
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.config import Config
from tessera.sources.discovery import PAGE, Pace, fetch, fetched_page, follow_live, http_get


@dataclass
class HostPartition(InputPartition):
    host: str
    seeds: list[dict]

    def __init__(self, host: str, seeds: list[dict]):
        super().__init__(host)
        self.host, self.seeds = host, seeds


def locations(xml: bytes) -> tuple[bool, list[str]]:
    """Whether a sitemap is an index, and each entry's own location."""
    local = lambda e: e.tag.rpartition("}")[2]
    root = ElementTree.fromstring(xml)
    own = ((place.text or "").strip() for entry in root if local(entry) in ("url", "sitemap") for place in entry if local(place) == "loc")
    return local(root) == "sitemapindex", [u for u in own if u]


class SitePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> SiteReader:
        return SiteReader(dict(self.options))


class SiteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.seeds = json.loads(options.get("seeds") or "[]")
        self.delay = float(options.get("delay", Config.crawl_delay))
        self.limit = int(options.get("limit", Config.page_bytes))
        self.hops = int(options.get("hops", Config.redirect_hops))

    def partitions(self) -> list[HostPartition]:
        by: dict[str, list[dict]] = {}
        for s in self.seeds:
            by.setdefault(urlsplit(s["sitemap"]).hostname or "", []).append(s)
        return [HostPartition(h, by[h]) for h in sorted(by)]

    def read(self, partition: HostPartition | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        get = Pace(partial(http_get, limit=self.limit), self.delay)
        for s in partition.seeds:
            seen: set[str] = set()
            for url, error in self._urls(s["sitemap"], get):
                if error:
                    yield s["library"], url, None, error
                elif url.startswith(s["base"]) and url not in seen:
                    seen.add(url)
                    yield s["library"], url, *fetched_page(url, lambda u: follow_live(u, get, self.hops, time.sleep).encode())

    def _urls(self, sitemap: str, get: Pace) -> Iterator[tuple[str, str | None]]:
        """(url, error) of a sitemap's pages."""
        index, found, error = self._locations(sitemap, get)
        if error:
            yield sitemap, error
        for one in found:
            if not index:
                yield one, None
                continue
            _, pages, error = self._locations(one, get)
            if error:
                yield one, error
            yield from ((u, None) for u in pages)

    def _locations(self, sitemap: str, get: Pace) -> tuple[bool, list[str], str | None]:
        try:
            return *locations(fetch(sitemap, get)), None
        except Exception as e:
            return False, [], f"{type(e).__name__}: {e}"[:500]
