"""Host names that pass themselves off as a brand's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed, text, urls
from palimpsest.plans.storage import written

SIGNALS = ("BRAND_ALIAS", "DOMAIN_HOMOGLYPH", "DOMAIN_TYPOSQUAT")


def _aliases() -> Column:
    """Every brand's aliases as one constant array, in order of precedence."""
    rows = [(i, j, brand, alias, domains) for i, (brand, aliases, domains) in enumerate(fixed.BRANDS) for j, alias in enumerate(aliases)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("brand_ord"), F.lit(j).alias("alias_ord"), F.lit(brand).alias("brand"), F.lit(alias).alias("alias"), F.lit(alias.isascii() and len(alias) >= 5).alias("fuzzy"), F.array(*map(F.lit, domains)).alias("domains"))
            for i, j, brand, alias, domains in rows
        ]
    )


def _rank(a: Column, s: Column) -> Column:
    """0 for an alias itself, 1 for what looks like it, 2 for what is one edit away, else null."""
    near = a["fuzzy"] & s["shape"].rlike(r"^[\x00-\x7F]*$")
    return F.when(s["part"] == a["alias"], 0).when(near & (s["shape"] == a["alias"]), 1).when(near & (F.levenshtein(s["shape"], a["alias"]) == 1), 2)


def url_risk(pages: DataFrame, *, url: str = "url") -> DataFrame:
    """(url, hostname, display_hostname, brand, signal, matched_text, official_domains, confidence) of suspicious addresses.

    A host's labels and their parts between hyphens are compared with every brand's aliases, in order of
    precedence: an alias itself, else what looks like one, else what is one edit away. Of several parts
    that match, the look-alike and then the least counts. All of that is one expression over a host: the
    brands are a constant of the plan. It is worked out once for each host, and addresses are joined with the suspicious ones.
    """
    web = pages.select(F.col(url).alias("url")).where(urls.is_web(F.col(url)))
    addresses = web.select("url", F.regexp_replace(urls.host(F.col("url")), r"^\.+|\.+$", "").alias("hostname")).where("hostname <> ''")
    # Written, as Catalyst would work out what is asked of a host for every address, before they are made distinct.
    named = written(addresses.select("hostname").distinct(), "hosts")
    plain = F.col("hostname").rlike(r"^[\x00-\x7F]*$") & ~F.col("hostname").contains("xn--")
    shown = named.withColumn("display_hostname", F.when(plain, F.col("hostname")).otherwise(text.decoded_host(F.when(~plain, F.col("hostname")))))
    labels = F.filter(F.split("display_hostname", r"\."), lambda x: x != "")
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: x != "")
    cut = shown.select("*", F.array_distinct(F.concat(F.array(text.registrable(F.col("display_hostname"))), labels, parts)).alias("parts"))
    # The skeleton of each part: translation reaches into arrays, normalisation doesn't, so parts are joined for it.
    cut = cut.withColumn("shape", F.split(text.skeleton(F.array_join("parts", "\n")), "\n"))
    shapes = cut.select("hostname", "display_hostname", F.arrays_zip(F.col("parts").alias("part"), F.col("shape").alias("shape")).alias("shapes"))
    host = F.col("hostname")
    foreign = F.filter(_aliases(), lambda a: ~F.exists(a["domains"], lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))))

    def matches(a: Column) -> Column:
        ranked = F.transform("shapes", lambda s: F.struct(a["brand_ord"].alias("brand_ord"), a["alias_ord"].alias("alias_ord"), _rank(a, s).alias("rank"), s["part"].alias("matched_text"), a["brand"].alias("brand"), a["domains"].alias("official_domains")))
        return F.filter(ranked, lambda m: m["rank"].isNotNull())

    best = shapes.select("hostname", "display_hostname", F.array_min(F.flatten(F.transform(foreign, matches))).alias("m")).where("m is not null")
    # And would infer from the join that every address has to pass the filter on its host.
    best = addresses.join(written(best, "host-risks"), "hostname").dropDuplicates(["url"])
    signal = F.get(F.array(*map(F.lit, SIGNALS)), F.col("m.rank"))
    return best.select("url", "hostname", "display_hostname", "m.brand", signal.alias("signal"), "m.matched_text", "m.official_domains", F.when(F.col("m.rank") < 2, "HIGH").otherwise("MEDIUM").alias("confidence"))
