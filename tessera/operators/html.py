"""HTML pages to (title, markdown), and redirect stubs, with the standard library's parser.

Row-local, so pages are converted where they lie, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

# Where the content of a documentation page is, most specific first, and what is not content.
MAIN_PLACES = (("article", "class", "pytorch-article"), ("div", "role", "main"), ("main", None, None), ("article", None, None), ("body", None, None))
CHROME = frozenset("nav header footer script style aside form iframe".split())
_PAGE = StructType().add("title", StringType()).add("body", StringType())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div section article main body ul ol li table tr dl dt dd blockquote pre figure h1 h2 h3 h4 h5 h6 html head title".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack += reversed(item.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


def main_content(root: Node) -> tuple[str, Node]:
    """(title, content without chrome); the whole page where none of the places is there."""
    title = next((n.text().strip() for n in root.walk() if n.tag == "title"), "")
    found = root
    for tag, name, value in MAIN_PLACES:
        hit = next((n for n in root.walk() if n.tag == tag and (name is None or value in n.attrs.get(name, "").split())), None)
        if hit is not None:
            found = hit
            break
    for node in found.walk():
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in CHROME]
    return title, found


def _inline(node: Node | str) -> str:
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node.replace("*", r"\*").replace("_", r"\_"))
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if node.tag in ("code", "tt", "kbd", "samp"):
        return f"`{node.text().strip()}`" if node.text().strip() else ""
    body = "".join(map(_inline, node.children))
    core = body.strip()
    if not core:
        return body
    before, after = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
    if node.tag == "a" and node.attrs.get("href"):
        title = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        return f"{before}[{core}]({node.attrs['href']}{title}){after}"
    if node.tag in ("b", "strong"):
        return f"{before}**{core}**{after}"
    if node.tag in ("i", "em"):
        return f"{before}*{core}*{after}"
    return body


def _is_block(node: Node | str) -> bool:
    return isinstance(node, Node) and (node.tag in _BLOCK or any(map(_is_block, node.children)))


def _blocks(node: Node, depth: int = 0) -> list[str]:
    out, line = [], []

    def flush():
        text = re.sub(r" *\n *", "\n", re.sub(r" {2,}(?!\n)", " ", "".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    for child in node.children:
        if not _is_block(child) or depth > 200:
            line.append(_inline(child))
            continue
        flush()
        tag = child.tag
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            text = re.sub(r"\s+", " ", "".join(map(_inline, child.children))).strip()
            if text:
                out.append(f"{'#' * int(tag[1])} {text}")
        elif tag == "pre":
            out.append("```\n" + child.text().strip("\n") + "\n```")
        elif tag in ("ul", "ol"):
            items = [c for c in child.children if isinstance(c, Node) and c.tag == "li"]
            marks = [f"{i}." if tag == "ol" else "*" for i in range(1, len(items) + 1)]
            rows = [f"{m} " + "\n\n".join(_blocks(i, depth + 1)).replace("\n", "\n" + " " * (len(m) + 1)) for m, i in zip(marks, items, strict=True)]
            if rows:
                out.append("\n".join(rows))
        elif tag == "blockquote":
            out.append("\n".join(f"> {x}" for x in "\n\n".join(_blocks(child, depth + 1)).split("\n")))
        elif tag == "dd":
            text = "\n\n".join(_blocks(child, depth + 1))
            head = out.pop() + "\n" if out else ""
            out.append(f"{head}:   " + text.replace("\n", "\n    "))
        elif tag == "table":
            rows = [[re.sub(r"\s+", " ", "".join(map(_inline, c.children))).strip() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in child.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                rows.insert(1, ["---"] * len(rows[0]))
                out.append("\n".join("| " + " | ".join(r) + " |" for r in rows))
        elif tag not in ("head", "title"):
            out += _blocks(child, depth + 1)
    flush()
    return out


def markdown(node: Node) -> str:
    """ATX headings, ``*`` bullets, fenced code; no blank line at the ends."""
    return "\n\n".join(_blocks(Node("", {}, [node]))).strip()


def convert(html: str | None) -> tuple[str, str]:
    """(title, markdown body) of a page; a null page is empty."""
    title, found = main_content(tree(html))
    return title, markdown(found)


def redirect_of(html: str | None, base: str) -> str | None:
    """Where a client-side redirect stub points: a refresh first, else a canonical link elsewhere."""
    nodes = list(tree(html).walk())
    for n in nodes:
        if n.tag == "meta" and n.attrs.get("http-equiv", "").lower() == "refresh":
            hit = re.search(r"(?i)url\s*=\s*(.+)$", n.attrs.get("content", ""))
            if hit:
                return urljoin(base, hit[1].strip().strip("'\""))
            break
    link = next((n for n in nodes if n.tag == "link" and "canonical" in n.attrs.get("rel", "").split()), None)
    if link is not None and link.attrs.get("href"):
        target = urljoin(base, link.attrs["href"].strip())
        if target.rstrip("/") != base.rstrip("/"):
            return target
    return None


@pandas_udf(_PAGE)
def page_text(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([convert(x) for x in html], columns=["title", "body"])


@pandas_udf(StringType())
def redirect_target(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([redirect_of(h, b or "") for h, b in zip(html, base, strict=True)], dtype=object)


@pandas_udf(StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", x or "") for b, x in zip(base, link, strict=True)], dtype=object)


def clean_pages(raw: DataFrame, library: Column, crawled_at: Column | None = None) -> DataFrame:
    """Raw pages (url, html) as snapshot pages (url, title, library, content_hash, crawled_at, body)."""
    page = raw.select("url", library.alias("library"), page_text("html").alias("p"))
    at = F.date_format(crawled_at if crawled_at is not None else F.current_timestamp(), "yyyy-MM-dd")
    return page.select("url", F.col("p.title").alias("title"), "library", F.sha2("p.body", 256).alias("content_hash"), at.alias("crawled_at"), F.col("p.body").alias("body"))


def follow_redirects(pages: DataFrame, hops: int = 3) -> DataFrame:
    """(url, html) of every page after at most ``hops`` client-side redirects among ``pages``.

    The original url stays the key; a target that was seen before or is not among the pages ends
    the chain.  One equi-join a hop.
    """
    known = pages.select(F.col("url").alias("target"), F.col("html").alias("next_html"))
    now = pages.select("url", F.col("url").alias("at"), "html", F.array("url").alias("seen"))
    for _ in range(hops):
        step = now.withColumn("target", redirect_target("html", "at"))
        both = step.join(known, "target", "left")
        go = F.col("target").isNotNull() & F.col("next_html").isNotNull() & ~F.array_contains("seen", F.col("target"))
        go = F.coalesce(go, F.lit(False))
        now = both.select("url", F.when(go, F.col("target")).otherwise(F.col("at")).alias("at"), F.when(go, F.col("next_html")).otherwise(F.col("html")).alias("html"), F.when(go, F.array_append("seen", F.col("target"))).otherwise(F.col("seen")).alias("seen"))
    return now.select("url", "html")
