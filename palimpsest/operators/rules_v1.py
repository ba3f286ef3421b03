"""The first verifier: words decide, repetition only words the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed, urls
from palimpsest.operators.detect import candidate_text
from palimpsest.operators.model import key_of


def signal_level(said: Column) -> Column:
    """strong, context or none, by the words in a text."""
    low = F.lower(said)
    return F.when(low.rlike("|".join(fixed.CORE_WORDS)), "strong").when(low.rlike("|".join(fixed.CONTEXT_WORDS)), "context").otherwise("none")


def verify_by_words(merged: DataFrame) -> DataFrame:
    """merged with signal_level, repeat_count (pages with this technique, place and text), outcome and is_violation."""
    # Words are looked for before anything is joined, and texts are counted by their hashes: so a text that isn't asked for isn't shuffled.
    said = F.lower(candidate_text())
    merged = merged.withColumn("signal_level", signal_level(said)).withColumn("_sample", said.contains("sample") | said.contains("test")).withColumn("_key", key_of(F.col("evidence_text")))
    keys = ["technique", "location", "_key"]
    pages = merged.groupBy(*keys).agg(F.count_distinct("url").alias("repeat_count")).alias("p")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    full = merged.alias("c").join(pages, on).select("c.*", "repeat_count")
    local = (urls.scheme(F.col("url")) == "file") | urls.host(F.col("url")).isin("localhost", "127.0.0.1", "[::1]")
    marked = local & F.col("_sample")
    none_only = (F.col("technique") == "OFFSCREEN") & (F.size("reason") > 0) & F.forall("reason", lambda r: r.startswith("DISPLAY"))
    outcome = (
        F.when(marked, "LOCAL_TEST")
        .when(F.col("signal_level") == "strong", "STRONG_WORDS")
        .when(F.col("signal_level") == "context", "CONTEXT_WORDS")
        .when(none_only, "DISPLAY_NONE_ONLY")
        .otherwise("NO_WORDS")
    )
    done = full.withColumn("outcome", outcome).drop("_sample", "_key")
    return done.withColumn("repeated", (F.col("repeat_count") >= 3) & ~F.col("outcome").isin("LOCAL_TEST", "STRONG_WORDS")).withColumn("is_violation", F.col("outcome").isin("LOCAL_TEST", "STRONG_WORDS"))
