"""The frontier of addresses: which are visited, in which order, and which pages are copies."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import urls
from palimpsest.plans.storage import written

SAMPLES = 2


def schedule(found: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """found (url, source, seq) as (url, pattern, source_rank, pattern_rank, seq): addresses once, the first of each pattern before the rest.

    source_rank is the best that an address was found by, seq its first. Order by the three to visit.
    """
    ranked = found.select(urls.canonical(F.col("url")).alias("url"), urls.source_rank(F.col("source")).alias("source_rank"), "seq").where(urls.is_page(F.col("url")))
    once = ranked.groupBy("url").agg(F.min("source_rank").alias("source_rank"), F.min("seq").alias("seq")).withColumn("pattern", urls.pattern(F.col("url")))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("seq", "url"))
    return once.select("url", "pattern", "source_rank", (place > samples).cast("int").alias("pattern_rank"), "seq")


def state_digest(html: Column) -> Column:
    """The digest of a page's rendered document; line ends don't matter."""
    return F.sha2(F.replace(html, F.lit("\r\n"), F.lit("\n")), 256)


def content_fingerprint(url: Column, states: Column) -> Column:
    """The digest of path, query keys and rendered states: only the query's values may differ between copies."""
    keys = F.array_sort(F.transform(urls.pairs(url), lambda p: p["key"]))
    where = F.when(urls.path(url) == "", "/").otherwise(urls.path(url))
    return F.sha2(F.concat_ws("\x01", where, F.array_join(keys, "&"), states), 256)


def content_dedup(pages: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """pages (url, html, seq, partial) with pattern, fingerprint and kept: the first of each pattern always, then what isn't a copy, and whatever was read in part.

    A page whose html is null has no fingerprint and is kept: nothing is known of what it holds.
    """
    named = pages.withColumn("pattern", urls.pattern(F.col("url"))).withColumn("fingerprint", F.when(F.col("html").isNotNull(), content_fingerprint(F.col("url"), state_digest(F.col("html")))))
    in_pattern = F.row_number().over(Window.partitionBy("pattern").orderBy("seq"))
    in_copies = F.row_number().over(Window.partitionBy("pattern", "fingerprint").orderBy("seq"))
    kept = (F.col("_p") <= samples) | (F.col("_c") == 1) | F.col("fingerprint").isNull() | F.coalesce(F.col("partial"), F.lit(False))
    return named.withColumn("_p", in_pattern).withColumn("_c", in_copies).withColumn("kept", kept).drop("_p", "_c")


def crawl(links: DataFrame, entry: DataFrame) -> DataFrame:
    """(url, depth) of all pages that links (src, dst) lead to from entry (url).

    Breadth first: each round's new addresses are what the last round's link to, less those visited. A round
    is written to the shared folder, so plans don't grow; the loop ends when a round finds nothing, however
    deep that is.
    """
    now = written(entry.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited = now
    for depth in itertools.count(1):
        reached = now.join(links, now["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        now = written(reached.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if now.isEmpty():
            break
        visited = written(visited.unionByName(now), "visited")
    return visited


#: Content types of pages; an answer without one counts as a page.
PAGE_TYPES = ("", "text/html", "application/xhtml+xml")


def fetched_pages(answers: DataFrame) -> DataFrame:
    """Of fetched answers (url, status, content_type) those that are pages: no error status, and a page's content type, parameters aside; null types count as none, null statuses are no pages."""
    kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    return answers.where((F.col("status") < 400) & kind.isin(*PAGE_TYPES))


def allowed_hosts(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """(host): the hosts of entries (url), and those that answers (url, final_url) to an entry's address redirect to."""
    known = entries.select(urls.canonical(F.col("url")).alias("url")).distinct()
    led = answers.select(urls.canonical(F.col("url")).alias("url"), "final_url").join(known, "url", "left_semi").select(F.col("final_url").alias("url"))
    return entries.select("url").unionByName(led).select(urls.host(F.col("url")).alias("host")).where("host <> ''").distinct()


def capped(scheduled: DataFrame, max_pages: int) -> DataFrame:
    """The first pages of a schedule that a run may visit at most."""
    return scheduled.orderBy("source_rank", "pattern_rank", "seq", "url").limit(max_pages)
