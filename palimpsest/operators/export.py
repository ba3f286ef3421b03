"""Findings, auxiliary findings, their validation and their files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import fixed
from palimpsest.plans.storage import written


def _numbered(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """df with a running id in an order.

    Rows are written in ranges of that order, each sorted; a row's number is its place in its file and the
    rows of the files before. Only a count for each file is gathered, so no task holds all rows.
    """
    key = F.struct(*order)
    stored = written(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order), "numbered")
    placed = stored.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = placed.groupBy("_file").agg(F.count("*").alias("_many"), F.min(key).alias("_first"))  # a row for each partition
    before = F.coalesce(F.sum("_many").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = files.select("_file", before.alias("_before"))
    number = F.col("_before") + F.col("_row") + 1
    return placed.join(F.broadcast(offset), "_file").withColumn("id", F.format_string(f"{prefix}_%03d", number)).drop("_file", "_row", "_before")


def findings(candidates: DataFrame, *, order: str = "seq") -> DataFrame:
    """(id, url, is_violation, location, evidence_text, technique): the first candidate of each address, place and technique."""
    kept = [c for c in ("evidence_text", "is_violation") if c in candidates.columns]
    first = candidates.groupBy("url", "location", "technique").agg(F.min_by(F.struct(*kept), order).alias("f"), F.min(order).alias(order))
    violation = F.coalesce("f.is_violation", F.lit(True)) if "is_violation" in kept else F.lit(True)
    rows = first.select("url", violation.alias("is_violation"), "location", F.col("f.evidence_text").alias("evidence_text"), "technique", order)
    return _numbered(rows, "f", [order, "url", "location", "technique"]).select("id", "url", "is_violation", "location", "evidence_text", "technique")


AUX_KEY = ("type", "page_url", "download_url", "suggested_filename", "hostname", "signal")


def auxiliary_findings(events: DataFrame, *, order: str = "seq") -> DataFrame:
    """Distinct auxiliary events with ids; a missing part of the key counts as ''."""
    keyed = events.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in AUX_KEY])
    keys = [f"_{c}" for c in AUX_KEY]
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1")
    return _numbered(first, "aux", [order]).drop("_n", *keys)


def violations(rows: DataFrame) -> DataFrame:
    """(row_ord, problem) of findings that break the format: one row for each, in the order in which rules are checked."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    again = F.row_number().over(Window.partitionBy("url", "location", "technique").orderBy("row_ord")) > 1
    checked = rows.select("row_ord", "technique", blank("url").alias("no_url"), blank("location").alias("no_location"), again.alias("again"))
    problem = (
        F.when(F.col("no_url"), "BLANK_URL")
        .when(F.col("no_location"), "BLANK_LOCATION")
        .when(F.col("technique").isNull() | ~F.col("technique").isin(*fixed.TECHNIQUES), "UNKNOWN_TECHNIQUE")
        .when(F.col("again"), "DUPLICATE")
    )
    return checked.select("row_ord", problem.alias("problem")).where("problem is not null")


def write_result(rows: DataFrame, meta: dict, path: str) -> None:
    """One JSON file of findings: UTF-8 without a mark, indented by two, LF, a newline at the end. Findings are few; the driver writes."""
    found = [r.asDict(recursive=True) for r in rows.orderBy("id").collect()]
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump({"meta": meta, "findings": found}, f, ensure_ascii=False, indent=2)
        f.write("\n")


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a result file, numbered in their order."""
    finding = "struct<id:string,url:string,is_violation:boolean,location:string,evidence_text:string,technique:string>"
    whole = spark.read.schema(f"findings array<{finding}>").json(path, multiLine=True)
    return whole.select(F.posexplode("findings").alias("row_ord", "f")).select("row_ord", "f.*")


def run_summary(verified: DataFrame) -> DataFrame:
    """How many candidates of each technique have each status, with totals."""
    return verified.rollup("technique", "verification_status").agg(F.count("*").alias("n"))


def write_auxiliary(rows: DataFrame, entry_url: str, path: str) -> None:
    """One JSON file of auxiliary findings, marked as not official; a field that an event doesn't have is left out."""
    found = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None and k != "seq"} for r in rows.orderBy("id").collect()]
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump({"meta": {"entry_url": entry_url, "official_findings": False}, "auxiliary_findings": found}, f, ensure_ascii=False, indent=2)
        f.write("\n")


def file_problems(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of result files that can't be read: a byte order mark, bytes that aren't UTF-8, no findings."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    found = F.get_json_object("text", "$.findings")
    problem = (
        F.when(F.substring(F.hex("content"), 1, 6) == "EFBBBF", "BYTE_ORDER_MARK")
        .when(F.col("text").isNull(), "NOT_UTF8")
        .when(F.get_json_object("text", "$").isNull(), "NOT_JSON")
        .when(F.get_json_object("text", "$.meta").isNull(), "NO_META")
        .when(found.isNull() | ~found.startswith("["), "NO_FINDINGS")
    )
    return raw.select("path", problem.alias("problem")).where("problem is not null")


def auxiliary_summary(aux: DataFrame) -> DataFrame:
    """One row: how many auxiliary findings are suspicious, and the first that concerns a host."""
    return aux.agg(F.count_if(F.col("risk") == "SUSPICIOUS").alias("suspicious"), F.min_by("hostname", F.when(F.col("type") == "DOMAIN_IMPERSONATION_RISK", F.col("id"))).alias("first_host"))


META_TEXTS = ("topic", "entry_url", "started_at", "finished_at", "tool_version")


def meta_problems(results: DataFrame) -> DataFrame:
    """(path, problem) of results (path, text) whose meta part has a text field that is none, or seconds that are no number or below 0."""
    meta = lambda c: F.expr(f"try_variant_get(try_parse_json(text), '$.meta.{c}', 'variant')")
    kind = lambda c: F.schema_of_variant(meta(c))
    told = F.array(*[F.when(meta(c).isNotNull() & (kind(c) != "STRING"), F.concat(F.lit("NOT_TEXT:"), F.lit(c))) for c in META_TEXTS])
    seconds = F.expr("try_variant_get(try_parse_json(text), '$.meta.elapsed_sec', 'double')")
    number = kind("elapsed_sec").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    bad = F.when(meta("elapsed_sec").isNotNull() & (~number | (seconds < 0)), "BAD_ELAPSED")
    return results.select("path", F.explode(F.array_compact(F.concat(told, F.array(bad)))).alias("problem"))


def validate(spark: SparkSession, path: str) -> int:
    """The exit code for a result file: 0 if it is sound, else 1."""
    if not file_problems(spark, path).isEmpty():
        return 1
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    return int(not meta_problems(raw).isEmpty() or not violations(read_result(spark, path)).isEmpty())
