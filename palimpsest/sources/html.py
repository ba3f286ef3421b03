"""Links and elements of raw pages, robots files and sitemaps."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import urls


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, None] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            href = next((v for k, v in attrs if k == "href" and v), None)
            if href:
                self.found[href] = None


def links_of(html: str | None, base: str) -> list[str]:
    """The absolute addresses of a page's anchors, each once; a broken page gives what stands before the break."""
    parser = _Anchors()
    try:
        parser.feed(html or "")
    except (AssertionError, ValueError):
        pass
    out: dict[str, None] = {}
    for href in parser.found:
        try:
            out[urljoin(base, href)] = None
        except ValueError:
            continue
    return list(out)


def page_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): the edges between pages and what they link to, by a parser of HTML."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, x) for u, h in zip(b["src"], b["html"], strict=True) if u for x in links_of(h, u)]
            yield pd.DataFrame(rows, columns=["src", "dst"])

    return pages.select(F.col(url).alias("src"), F.col(html).alias("html")).mapInPandas(run, "src string, dst string").distinct()


def anchors(html: Column) -> Column:
    """The href of each anchor as written, by a regular expression: for pages whose markup is known to be plain."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(url, sitemap) of robots files (url, text)."""
    lines = files.select("url", F.explode(F.split("text", r"\R")).alias("line")).select("url", F.trim("line").alias("line"))
    named = lines.where(F.col("line").rlike("(?i)^sitemap:")).select("url", F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    return named.where("value <> ''").select("url", urls.absolute(F.col("url"), F.col("value")).alias("sitemap")).distinct()


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(url, kind, target) of sitemaps (url, text): pages, or sitemaps if the root is an index. A malformed file and one without an address have none, a malformed address is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u, t in zip(b["url"], b["text"], strict=True):
                if not u:
                    continue
                try:
                    root = ET.fromstring(t or "")
                except ET.ParseError:
                    continue
                name = lambda e: e.tag.rpartition("}")[2].lower()
                kind = "sitemap" if name(root) == "sitemapindex" else "page"
                for e in root.iter():
                    if name(e) == "loc" and (e.text or "").strip():
                        try:
                            rows.append((u, kind, urljoin(u, e.text.strip())))
                        except ValueError:
                            continue
            yield pd.DataFrame(rows, columns=["url", "kind", "target"])

    return files.select("url", "text").mapInPandas(run, "url string, kind string, target string").distinct()


def standard_resources(entries: DataFrame) -> DataFrame:
    """(url, kind, target): where a site's robots file and sitemaps usually are."""
    origin = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")))
    known = F.array(*[F.struct(F.lit(k).alias("kind"), F.concat(origin, F.lit(p)).alias("target")) for k, p in (("robots", "/robots.txt"), ("sitemap", "/sitemap.xml"), ("sitemap", "/sitemap_index.xml"))])
    web = entries.where(urls.is_web(F.col("url")) & (urls.netloc(F.col("url")) != ""))
    return web.select("url", F.explode(known).alias("r")).select("url", "r.kind", "r.target")
