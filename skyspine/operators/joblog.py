"""Run ledger, job status, logs and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.clean import truncate_text
from skyspine.functions.text import contains
from skyspine.operators.filters import optional_filters
from skyspine.operators.keys import keep_first
from skyspine.operators.ordering import latest_n


def run_ledger(run_events: DataFrame) -> DataFrame:
    """Start and finish events folded into one row per run.

    Events: run_id, service, ts, status, trigger, error, result. A run without a finish is running.
    """
    # The first start and the last finish of a run, each cut to one row per run before the exchange.
    start = keep_first(run_events.where("status = 'running'"), ["run_id"], ["ts", "trigger"]).select(
        "run_id", F.struct("ts", "trigger", "service").alias("_start"))
    end = keep_first(run_events.where("status <> 'running'"), ["run_id"], [F.col(c).desc() for c in ("ts", "status", "error", "result")]).select(
        "run_id", F.struct("ts", "status", "error", "result", "service").alias("_end"))
    ledger = start.join(end, "run_id", "full_outer").withColumn("service", F.coalesce("_start.service", "_end.service"))
    started, ended = F.col("_start.ts"), F.col("_end.ts")
    micros = F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return ledger.select(
        F.col("run_id").alias("id"), "service", started.alias("started_at"), ended.alias("finished_at"),
        F.coalesce(F.col("_end.status"), F.lit("running")).alias("status"),
        F.floor(micros / 1000).cast("bigint").alias("duration_ms"), F.col("_start.trigger").alias("trigger"),
        truncate_text(F.col("_end.error"), V.RUN_ERROR_CHARS).alias("error"), F.col("_end.result").alias("result"))


def job_status(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each job with its newest run, its error and result, when it is due next, and the status to show.

    A job that is switched off shows as paused and is not due; one that never ran is idle.
    """
    latest = newest_per_key(ledger.where("service IS NOT NULL"), "service", "started_at", "id").select(
        F.col("service").alias("name"), F.col("started_at").alias("last_run_at"),
        F.col("finished_at").alias("last_finished_at"), F.col("duration_ms").alias("last_duration_ms"),
        F.col("status").alias("run_status"), truncate_text(F.col("error"), V.JOB_ERROR_CHARS).alias("last_error"),
        F.col("result").alias("last_result"))
    due = F.col("last_finished_at") + F.make_dt_interval(secs=F.col("interval_seconds").cast("decimal(18,6)"))
    return (jobs.join(latest, "name", "left")
            .withColumn("next_run_at", F.when(F.col("enabled"), due))
            .withColumn("status", F.coalesce("run_status", F.lit("idle"))).drop("run_status")
            .withColumn("shown_status", F.when(F.col("enabled"), F.col("status")).otherwise(F.lit("paused"))))


def log_rows(rows: DataFrame) -> DataFrame:
    """Log rows as stored: level in upper case, message cut to the stored length, day for partitioning."""
    return rows.select("id", "ts", "service", "run_id", F.upper("level").alias("level"),
                       truncate_text(F.col("message"), V.LOG_MESSAGE_CHARS).alias("message"),
                       F.to_date("ts").alias("day"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows, one folder per day; a busy day is spread over several files."""
    log_rows(rows).hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(path)


def _chosen_logs(logs: DataFrame, level: str | None, service: str | None, q: str | None) -> DataFrame:
    return optional_filters(logs, (level, F.col("level") == F.lit((level or "").upper())),
                            (service, F.col("service") == F.lit(service)),
                            (q, contains(F.col("message"), q or "")))


def search_logs(logs: DataFrame, limit: int = 300, level: str | None = None, service: str | None = None,
                q: str | None = None) -> DataFrame:
    """Newest log rows that fit all given arguments."""
    return latest_n(_chosen_logs(logs, level, service, q), "ts", limit, "id")


def log_days(logs: DataFrame) -> list[str | None]:
    """The days of a stored log, newest first and rows without a time before them, as the newest rows come. Read off its folders."""
    folders = {part[4:] for f in logs.inputFiles() for part in f.split("/") if part.startswith("day=")}
    none = {f for f in folders if f.startswith("__HIVE_DEFAULT")}
    return [None] * bool(none) + sorted(folders - none, reverse=True)


def search_stored_logs(spark: SparkSession, path: str, limit: int = 300, level: str | None = None, service: str | None = None,
                       q: str | None = None) -> DataFrame:
    """The same rows from a log written by ``append_log``, opening the newest days first.

    Days are added, twice as many each time, until they hold ``limit`` rows that fit; older ones cannot hold newer rows. Only as many
    rows as wanted are counted in a step.
    """
    logs = spark.read.parquet(path)
    days = log_days(logs)
    taken = 1
    while True:
        some = days[:taken]
        in_days = F.col("day").cast("string").isin([d for d in some if d is not None])
        rows = logs.where(F.coalesce(in_days, F.lit(False)) | (F.col("day").isNull() if None in some else F.lit(False)))
        if taken >= len(days) or _chosen_logs(rows, level, service, q).limit(limit).count() >= limit:
            return search_logs(rows.drop("day"), limit, level, service, q)
        taken *= 2


def unread_count(notifications: DataFrame) -> DataFrame:
    return notifications.where(~F.col("read")).agg(F.count(F.lit(1)).alias("unread"))


def fresh_only(df: DataFrame, ts: str, as_of: Column, max_age_seconds: float) -> DataFrame:
    """Rows younger than the maximum age at ``as_of``."""
    return df.where(F.col(ts) > as_of - F.make_dt_interval(secs=F.lit(max_age_seconds).cast("decimal(18,6)")))


def newest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest row of each key, cut to one row per key before anything is exchanged."""
    rest = [c for c in df.columns if c not in (key, ts, tie)]
    return keep_first(df, [key], [F.col(ts).desc(), F.col(tie).desc()]).select(key, ts, tie, *rest)
