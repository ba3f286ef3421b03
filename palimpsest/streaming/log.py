"""Run logs as events and state, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text

#: What a run prints: fixed words of its lines, and the metric that each summary key sets.
SCAN, COMPLETE, DISCOVERED, WARNING = "페이지 정밀 탐색", "완료", "발견 URL", "주의"
SUMMARY = {
    "발견 고유 URL 수": "discovered", "정밀검사 시도 수": "attempted", "분석 완료 페이지": "completed", "CONFIRMED": "confirmed", "SUSPICIOUS": "suspicious",
    "BENIGN_LIKELY": "benign", "최종 findings": "findings", "자동 다운로드 의심": "aux_downloads", "result.json": "result_path", "result_extra.json": "extra_result_path", "탐지 시간": "elapsed_sec",
}
SILENT = ("브라우저 worker", "discovery worker", "분석 frame 수")

_WORKER = r"^\[\w+\]\[W(\d+)\] "
_KEYS = "|".join(k.replace(".", r"\.") for k in [*SUMMARY, *SILENT])


def event(line: Column) -> Column:
    """A line as (type, worker, number, url, key, value); the first form that fits counts, log if none does."""
    t = F.regexp_replace(line, r"[\r\n]+$", "")
    part = lambda p, i: F.regexp_extract(t, p, i)
    scan, done = rf"{_WORKER}{SCAN} (\d+): (.+)$", rf"{_WORKER}{COMPLETE} (\d+): (.+)$"
    found, tune, total = rf"^\[\w+\] {DISCOVERED} (\d+): (.+)$", r"^\[\w+\] Auto-Tune\s*:\s*(.+?)\s*$", rf"^\s*({_KEYS})\s*:\s*(.+?)\s*$"
    null = F.lit(None).cast("string")

    def made(kind: str, worker=null, number=null, url=null, key=null, value=null) -> Column:
        return F.struct(F.lit(kind).alias("type"), worker.try_cast("int").alias("worker"), number.try_cast("int").alias("number"), url.alias("url"), key.alias("key"), value.alias("value"))

    return (
        F.when(t.rlike(scan), made("scan", part(scan, 1), part(scan, 2), part(scan, 3)))
        .when(t.rlike(done), made("complete", part(done, 1), part(done, 2), part(done, 3)))
        .when(t.rlike(found), made("discovered", number=part(found, 1), url=part(found, 2)))
        .when(t.rlike(tune), made("autotune", value=part(tune, 1)))
        .when(t.rlike(total), made("summary", key=part(total, 1), value=part(total, 2)))
        .when(t.startswith(WARNING), made("warning", value=t))
        .otherwise(made("log", value=t))
    )


def changes(events: DataFrame) -> DataFrame:
    """(run, seq, metric, value) of events (run, seq, event): what each sets, as a string."""
    e = F.col("event")
    pair = lambda m, v: F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value"))
    metric = F.element_at(F.create_map(*[F.lit(x) for kv in SUMMARY.items() for x in kv]), e["key"])
    value = F.when(metric.isin("result_path", "extra_result_path"), F.trim(e["value"])).when(metric == "elapsed_sec", text.seconds(e["value"]).cast("string")).otherwise(text.number(e["value"]).cast("string"))
    sets = (
        F.when(e["type"] == "scan", F.array(pair("attempted", e["number"]), pair("current_url", e["url"])))
        .when(e["type"] == "complete", F.array(pair("completed", e["number"]), pair("current_url", e["url"])))
        .when(e["type"] == "discovered", F.array(pair("discovered", e["number"])))
        .when(e["type"].isin("autotune", "warning"), F.array(F.struct(e["type"].alias("metric"), e["value"].alias("value"))))
        .when((e["type"] == "summary") & metric.isNotNull(), F.array(F.struct(metric.alias("metric"), value.alias("value"))))
    )
    return events.select("run", "seq", F.explode(sets).alias("s")).select("run", "seq", "s.metric", "s.value")


def state(events: DataFrame) -> DataFrame:
    """(run, metric, value): the last value of each metric. The same on a stream, in update or complete mode."""
    return changes(events).groupBy("run", "metric").agg(F.max_by("value", "seq").alias("value"))


def stream_state(spark: SparkSession, folder: str, name: str = "run_state"):
    """A streaming query that keeps the state of the logs in a folder (JSON lines of run, seq, line) in a memory table."""
    lines = spark.readStream.schema("run string, seq long, line string").json(folder)
    live = state(lines.select("run", "seq", event(F.col("line")).alias("event")))
    return live.writeStream.outputMode("complete").format("memory").queryName(name).start()


def outcome(final: DataFrame) -> DataFrame:
    """final (run, cancelled, return_code, findings, aux) with the run's status and what is said of it."""
    status = F.when(F.col("cancelled"), "cancelled").when(F.col("return_code") != 0, "error").otherwise("complete")
    said = F.when(status != "complete", status).when(F.col("findings") > 0, "findings").when(F.col("aux") > 0, "auxiliary only").otherwise("nothing")
    return final.withColumn("status", status).withColumn("said", said)
