"""Run ledger, job, log and notification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspine.operators import joblog as J
from skyspine.operators import ordering, upsert
from skyspine.plans import jobs as plans
from skyspine.session import scratch
from skyspine.workload.registry import query

LEDGER = """SELECT run_id AS id, min(service) AS service, min(ts) FILTER (WHERE status = 'running') AS started_at,
  max(ts) FILTER (WHERE status <> 'running') AS finished_at,
  coalesce(max(status) FILTER (WHERE status <> 'running'), 'running') AS status,
  CAST(floor((epoch_us(max(ts) FILTER (WHERE status <> 'running')) - epoch_us(min(ts) FILTER (WHERE status = 'running')))
    / 1000.0::DOUBLE) AS BIGINT) AS duration_ms,
  max(trigger) FILTER (WHERE status = 'running') AS trigger, max(error) AS error, max(result) AS result
FROM v_run_events GROUP BY run_id"""


@query("run_ledger", LEDGER)
def _(t, spark):
    return J.run_ledger(t.run_events)


STATUS = f"""SELECT j.*, l.started_at AS last_run_at, l.finished_at AS last_finished_at, l.duration_ms AS last_duration_ms,
  l.error[:2000] AS last_error, l.result AS last_result,
  CASE WHEN j.enabled THEN l.finished_at + to_seconds(j.interval_seconds) END AS next_run_at,
  coalesce(l.status, 'idle') AS status, CASE WHEN j.enabled THEN coalesce(l.status, 'idle') ELSE 'paused' END AS shown_status
FROM v_jobs j LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY service ORDER BY started_at DESC, id DESC) AS rn
  FROM ({LEDGER}) a) l ON l.service = j.name AND l.rn = 1"""


@query("job_status", STATUS)
def _(t, spark):
    return J.job_status(t.services, J.run_ledger(t.run_events))


@query("job_list", STATUS)
def _(t, spark):
    return plans.job_list(t)


@query("job_runs", f"SELECT * FROM ({LEDGER}) q WHERE service = 'svc4' ORDER BY started_at DESC NULLS FIRST, id DESC NULLS FIRST LIMIT 25")
def _(t, spark):
    return plans.job_runs(t, "svc4")


LOGS = "SELECT id, ts, service, run_id, level, message FROM v_logs"


@query("search_logs", LOGS + " WHERE level = 'ERROR' AND message ILIKE '%9%' ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 300")
def _(t, spark):
    return J.search_logs(t.service_logs, level="error", q="9")


@query("log_search", LOGS + " WHERE service = 'svc3' ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 200")
def _(t, spark):
    return plans.log_search(t, limit=200, service="svc3")


@query("search_logs_stored", LOGS + " WHERE level = 'ERROR' ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 50")
def _(t, spark):
    path = scratch(spark, "logs")
    J.append_log(t.service_logs, path)
    return J.search_stored_logs(spark, path, 50, level="error")


@query("latest_n", LOGS + " ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 100")
def _(t, spark):
    return ordering.latest_n(t.service_logs, "ts", 100, "id")


@query("append_log", """SELECT id, ts, service, run_id, upper(level) AS level, substr(message, 1, 8000) AS message,
  CAST(ts AS DATE) AS day FROM v_logs""")
def _(t, spark):
    path = scratch(spark, "append_log")
    logs = t.service_logs
    # Two appends: what the first one wrote stays.
    J.append_log(logs.where("level = 'ERROR'"), path)
    J.append_log(logs.where("level <> 'ERROR'"), path)
    return spark.read.parquet(path)


@query("unread_count", "SELECT count(*) AS unread FROM v_notes WHERE NOT read")
def _(t, spark):
    return J.unread_count(t.notifications)


@query("mark_read", "SELECT id, ts, level, source, title, body, true AS read FROM v_notes")
def _(t, spark):
    return upsert.mark_read(t.notifications)


@query("notification_feed", """SELECT *, (SELECT count(*) FROM v_notes WHERE NOT read) AS unread FROM v_notes
ORDER BY ts DESC NULLS FIRST, id DESC LIMIT 50""")
def _(t, spark):
    return plans.notification_feed(t)


@query("fresh_only", "SELECT event_id, user_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 6 HOUR")
def _(t, spark):
    as_of = F.lit("2024-01-30 23:00:00").cast("timestamp_ntz")
    return J.fresh_only(t.events, "ts", as_of, 6 * 3600.0).select("event_id", "user_id", "ts")


@query("newest_per_key", """SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) AS rn FROM events) q WHERE rn = 1""")
def _(t, spark):
    return J.newest_per_key(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")
