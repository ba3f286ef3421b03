"""Evaluation against ground truth, and profiles of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, detected, hits, missing, unexpected, precision, recall, f1; ratios without a denominator are 0."""
    marked = truth.select(*keys, F.lit(1).alias("_true"), F.lit(0).alias("_found")).unionByName(found.select(*keys, F.lit(0).alias("_true"), F.lit(1).alias("_found")))
    cases = marked.groupBy(*keys).agg(F.max("_true").alias("_true"), F.max("_found").alias("_found"))
    both = cases.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for c, name in (("_true", "expected"), ("_found", "detected"), (F.col("_true") * F.col("_found"), "hits"))])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = share(F.col("hits"), F.col("detected")), share(F.col("hits"), F.col("expected"))
    return both.select("*", (F.col("expected") - F.col("hits")).alias("missing"), (F.col("detected") - F.col("hits")).alias("unexpected"), p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))


def breakdown(truth: DataFrame, found: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, expected, detected) of the true cases."""
    marked = truth.select(by, *keys).distinct().join(found.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return marked.groupBy(by).agg(F.count("*").alias("expected"), F.count("_hit").alias("detected"))


def technique_counts(candidates: DataFrame) -> DataFrame:
    """(technique, raw, distinct): observations, and addresses and places."""
    return candidates.groupBy("technique").agg(F.count("*").alias("raw"), F.count_distinct("url", "location").alias("merged"))


def reason_histogram(candidates: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent reasons of each technique."""
    counted = candidates.select("technique", F.explode("reason").alias("reason")).groupBy("technique", "reason").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "technique", "reason").limit(top)


def pass_profile(candidates: DataFrame) -> DataFrame:
    """(technique, passes, n): in how many render passes merged candidates were met."""
    return candidates.groupBy("technique", F.size("scan_passes").alias("passes")).agg(F.count("*").alias("n"))


def slowest(rows: DataFrame, by: str, cost: str, top: int) -> DataFrame:
    """The costliest groups: n, total and most; ties by name."""
    summed = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(cost).alias("total"), F.max(cost).alias("most"))
    return summed.where("total > 0").orderBy(F.desc("total"), by).limit(top)


def choose_workers(runs: DataFrame, *, margin: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Of error-free runs with observations the one with the fewest workers whose speed is within a margin of the best."""
    valid = runs.where("errors = 0 AND observations > 0")
    best = valid.groupBy(*(by or [])).agg(F.max("pages_per_sec").alias("best"))
    valid = valid.join(best, by) if by else valid.join(F.broadcast(best))  # one row
    near = valid.where(F.col("pages_per_sec") >= F.col("best") * (1 - margin))
    return near.groupBy(*(by or [])).agg(F.min_by(F.struct("workers", "pages_per_sec"), F.struct("workers", -F.col("pages_per_sec"))).alias("r")).select(*(by or []), "r.*")


def candidate_workers(machines: DataFrame) -> DataFrame:
    """machines (cpu_count, memory_total_mb) with the worker counts worth trying."""
    cpus, mb = F.coalesce("cpu_count", F.lit(1)), F.col("memory_total_mb")
    few, some, many = (F.array(*map(F.lit, x)) for x in ((4,), (4, 6), (6, 8)))
    tried = F.when(cpus <= 4, few).when(F.coalesce(mb < 6144, F.lit(False)), few).when((cpus <= 8) | F.coalesce(mb < 12288, F.lit(False)), some).otherwise(many)
    return machines.withColumn("workers", tried)


def stage_totals(timings: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, seconds): how long all pages took in each stage."""
    sums = timings.agg(*[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in stages])
    return sums.select(F.explode(F.create_map(*[x for s in stages for x in (F.lit(s), F.col(s))])).alias("stage", "seconds"))


def pass_stats(passes: DataFrame) -> DataFrame:
    """(scan_pass, pages, seconds, mean_seconds, observations) of pages' passes (scan_pass, seconds, observations)."""
    return passes.groupBy("scan_pass").agg(F.count("*").alias("pages"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"), F.sum("observations").alias("observations"))


def retention(cases: DataFrame) -> DataFrame:
    """(expectation, total, kept) of cases (expectation, status): what must be retained, and what is only probed."""
    return cases.groupBy("expectation").agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col("status") != "BENIGN_LIKELY", F.lit(False))).alias("kept"))


def matrix_rollup(runs: DataFrame) -> DataFrame:
    """One row over runs (generated, required, hits, elapsed, detector_recall, recall, precision) of several seeds: sums, means and worst."""
    return runs.agg(
        F.count("*").alias("runs"), F.sum("generated").alias("generated"), F.sum("required").alias("required"), F.sum("hits").alias("hits"), F.avg("elapsed").alias("mean_elapsed"), F.max("elapsed").alias("most_elapsed"),
        *[F.min(c).alias(f"least_{c}") for c in ("detector_recall", "recall", "precision")],
    )


def weakest(verified: DataFrame, top: int = 10) -> DataFrame:
    """The retained candidates of least score."""
    return verified.where("verification_status <> 'BENIGN_LIKELY'").orderBy("verification_score", "url", "location", "technique").limit(top)


def machine_fingerprint(fields: dict[str, str]):
    """The first 20 digits of the digest of a machine's properties (a column each, by name) but for its free memory."""
    kept = sorted(k for k in fields if k != "memory_available_mb")
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(fields[k]).alias(k) for k in kept])), 256), 1, 20)


def usable_tuning(cache: DataFrame, *, schema: int, fingerprint: str, now: float, tried: tuple[int, ...] = (4, 6, 8), age: float = 30 * 86_400) -> DataFrame:
    """The cached tuning results that still hold: of this schema and machine, not too old, with workers that are tried at all."""
    return cache.where((F.col("schema") == schema) & (F.col("fingerprint") == fingerprint) & (F.lit(now) - F.col("created_at_epoch") <= age) & F.col("selected_workers").isin(*tried))


def status_match(cases: DataFrame) -> DataFrame:
    """(total, mismatched, missing, rate) of cases (expected_status, verification_status): a case without a status is missing, one without an expected status can't mismatch."""
    wrong = F.col("expected_status").isNotNull() & (F.col("expected_status") != "") & (F.col("verification_status") != F.col("expected_status"))
    sums = cases.agg(F.count("*").alias("total"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("mismatched"), F.count_if(F.col("verification_status").isNull()).alias("missing"))
    return sums.withColumn("rate", F.coalesce(F.try_divide(F.col("total") - F.col("mismatched") - F.col("missing"), F.col("total")), F.lit(0.0)))


def scale_metrics(expected: DataFrame, controls: DataFrame, found: DataFrame, kept: DataFrame, keys: list[str], *, pages: int, seconds: float) -> DataFrame:
    """One row: recall of detectors (found) and of the verifier (kept) over what is expected, what it kept of controls and of neither, its precision, pages a second."""
    sides = {"expected": expected, "control": controls, "found": found, "kept": kept}
    marked = [df.select(*keys, *[F.lit(int(name == side)).alias(f"_{name}") for name in sides]) for side, df in sides.items()]
    cases = reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(*[(F.max(f"_{name}") == 1).alias(name) for name in sides])
    c = F.col
    n = cases.agg(
        F.count_if("expected").alias("expected"), F.count_if(c("expected") & c("found")).alias("detected"), F.count_if(c("expected") & c("kept")).alias("hits"), F.count_if(c("control") & c("kept")).alias("leaks"),
        F.count_if(c("kept") & ~c("expected") & ~c("control")).alias("unexpected"),
    )
    recall = lambda x: F.coalesce(F.try_divide(c(x), c("expected")), F.lit(1.0))
    precision = c("hits") / F.greatest(F.lit(1), c("hits") + c("unexpected") + c("leaks"))
    return n.select("*", recall("detected").alias("detector_recall"), recall("hits").alias("recall"), precision.alias("precision"), F.lit(pages / max(seconds, 0.001)).alias("pages_per_second"))
