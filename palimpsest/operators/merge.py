"""One candidate for each address, place and technique, from all its observations.

The merge depends on order (the longest text, reasons in the order met, sources of the richest
observation): reasons and sources are a fold over the group's observations by seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_passes(candidates: DataFrame) -> DataFrame:
    """Merged candidates, with observation_count, scan_passes and the seq of the first observation.

    Null addresses and places are keys like others. The normalised text is the first there is, and stays
    when a longer text is found later; rect and sources are taken over from an observation with at least
    as many reasons as were known before it.

    Texts are aggregated by themselves, so that of the many observations of a place one text is shuffled.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    length = F.coalesce(F.length("evidence_text"), F.lit(0))
    plain = blank(F.col("normalized_text"))
    groups = candidates.groupBy("url", "location", "technique").agg(
        F.min(F.struct((-length).alias("less"), "seq", "evidence_text")).alias("longest"),
        F.min(F.when(plain.isNotNull(), F.struct("seq", plain.alias("text")))).alias("normal"),
        F.array_sort(F.collect_list(F.struct("seq", "reason", "rect", "opacity_source", "display_source"))).alias("rows"),
        F.array_sort(F.collect_list(F.struct("seq", "scan_pass"))).alias("met"),
        F.count("*").alias("observation_count"),
        F.min("seq").alias("seq"),
    )
    first = F.get("rows", F.lit(0))
    rest = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    some = ("rect", "opacity_source", "display_source")

    def take(acc, r):
        richer = F.size(r["reason"]) >= F.size(acc["reason"])
        return F.struct(F.array_union(acc["reason"], r["reason"]).alias("reason"), *[F.when(richer & r[c].isNotNull(), r[c]).otherwise(acc[c]).alias(c) for c in some])

    start = F.struct(F.array_distinct(first["reason"]).alias("reason"), *[first[c].alias(c) for c in some])
    seen = F.filter(F.transform("met", lambda r: r["scan_pass"]), lambda p: p.isNotNull() & (p != ""))
    return groups.select(
        "url",
        "location",
        "technique",
        F.col("longest.evidence_text").alias("evidence_text"),
        F.col("normal.text").alias("normalized_text"),
        F.aggregate(rest, start, take).alias("m"),
        "observation_count",
        F.array_distinct(seen).alias("scan_passes"),
        "seq",
    ).select("url", "location", "technique", "evidence_text", "normalized_text", "m.*", "observation_count", "scan_passes", "seq")
