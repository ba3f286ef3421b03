"""Addresses as Column expressions. They are taken apart by regular expressions: parse_url rejects hosts and paths that browsers accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import fixed

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def host(url: Column) -> Column:
    """The host in small letters, without credentials and port."""
    return F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def _decode(part: Column) -> Column:
    # A bad escape stays as it is.
    return F.coalesce(F.try_url_decode(part), part)


def _encode(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(url: Column) -> Column:
    """The decoded (key, value) pairs of the query; values may be empty, empty pairs are left out."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("key"), _decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def _tracking(key: Column, challenges: bool) -> Column:
    low = F.lower(key)
    out = low.startswith(fixed.TRACKING_PREFIX) | low.isin(*fixed.TRACKING_KEYS)
    return out | low.startswith(fixed.CHALLENGE_PREFIX) if challenges else out


def canonical(url: Column, *, challenges: bool = True) -> Column:
    """An address without fragment and tracking (and challenge) keys, its pairs sorted, scheme and host in small letters; only the fragment goes of others than http(s)."""
    kept = F.array_sort(F.filter(pairs(url), lambda p: ~_tracking(p["key"], challenges)))
    line = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))), "&")
    where = F.when(path(url) == "", "/").otherwise(path(url))
    whole = F.concat(scheme(url), F.lit("://"), F.lower(netloc(url)), where, F.when(line == "", "").otherwise(F.concat(F.lit("?"), line)))
    return F.when(is_web(url), whole).otherwise(F.regexp_replace(url, "(?s)#.*$", ""))


def pattern(url: Column) -> Column:
    """The structure that similar addresses share: numbers and items of collections as placeholders, query keys only."""
    low = F.lower(_decode(F.replace(F.when(path(url) == "", "/").otherwise(path(url)), F.lit("+"), F.lit("%2B"))))
    steps = F.filter(F.split(low, "/"), lambda s: s != "")
    named = F.transform(
        steps,
        lambda s, i: F.when(F.get(steps, i - 1).isin(*fixed.DYNAMIC_GROUPS), "{item}")
        .when(s.endswith("-all.html"), "{item}-all.html")
        .otherwise(F.regexp_replace(s, r"(?U)\d+", "{n}")),
    )
    keys = F.array_sort(F.transform(F.filter(pairs(url), lambda p: ~_tracking(p["key"], False)), lambda p: F.lower(p["key"])))
    line = F.concat(F.lit("/"), F.array_join(named, "/"))
    slash = F.when(low.endswith("/") & (line != "/"), "/").otherwise("")
    return F.concat(scheme(url), F.lit("://"), host(url), line, slash, F.lit("?"), F.array_join(keys, "&"))


def is_page(url: Column) -> Column:
    """Whether an address can be a page: http, https or file, and no static file's extension."""
    endings = "|".join(e.replace(".", r"\.") for e in fixed.STATIC_EXTENSIONS)
    return scheme(url).isin("http", "https", "file") & ~F.lower(path(url)).rlike(f"(?:{endings})$")


def same_site(url: Column, hosts: list[str], entry_scheme: str = "https") -> Column:
    """Whether an address is on the inspected site; ports don't matter."""
    if entry_scheme == "file":
        return scheme(url) == "file"
    return is_web(url) & host(url).isin(*hosts)


def target(text: Column) -> Column:
    """What a user typed as an address: https unless a scheme is given; null for nothing."""
    bare = F.trim(text)
    return F.when(bare == "", None).when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def absolute(base: Column, href: Column) -> Column:
    """A reference resolved against the address of its page, dot segments included."""
    origin = F.concat(scheme(base), F.lit("://"), netloc(base))
    at = F.regexp_extract(path(base), "(?s)^(.*/)", 1)
    rooted = F.regexp_extract(href, "(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(href, "(?s)^[^?#]*(.*)$", 1)
    joined = F.when(rooted.startswith("/"), rooted).otherwise(F.concat(F.when(at == "", "/").otherwise(at), rooted))
    steps = F.split(joined, "/")
    solid = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    ends = F.when(joined.rlike(r"/\.{1,2}$"), "/").otherwise("")
    where = F.concat(F.lit("/"), F.array_join(solid, "/"), F.when(F.size(solid) > 0, ends).otherwise(""))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, path(base), href))
        .otherwise(F.concat(origin, where, tail))
    )


def error_kind(message: Column) -> Column:
    """transient, download, timeout or other, by what a browser's error says."""
    low = F.lower(message)
    hints = [low.contains(h) for h in fixed.TRANSIENT_ERRORS]
    transient = hints[0]
    for h in hints[1:]:
        transient |= h
    timeout = low.contains("page.goto") & low.contains("timeout") & low.contains("exceeded")
    return F.when(transient, "transient").when(low.contains("download is starting"), "download").when(timeout, "timeout").otherwise("other")


def source_rank(source: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in fixed.SOURCE_RANK.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def download_event(requested: Column, page: Column, download: Column) -> Column:
    """(type, risk, page_url, page_triggered): a download from another address than was asked for is suspicious."""
    asked, got = canonical(F.coalesce(requested, F.lit(""))), canonical(F.coalesce(download, F.lit("")))
    hit = (asked != "") & (got != "") & (asked != got)
    shown = F.coalesce(F.nullif(page, F.lit("")), requested, F.lit(""))
    return F.struct(
        F.when(hit, "AUTO_DOWNLOAD_ATTEMPT").otherwise("DOWNLOAD_NAVIGATION").alias("type"),
        F.when(hit, "SUSPICIOUS").otherwise("INFO").alias("risk"),
        F.when(shown == "about:blank", F.coalesce(requested, F.lit(""))).otherwise(shown).alias("page_url"),
        hit.alias("page_triggered"),
    )
