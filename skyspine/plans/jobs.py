"""Job, log and notification products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.operators import joblog as J
from skyspine.operators.ordering import latest_n, up
from skyspine.tables import Tables


def log_search(t: Tables, limit: int = 300, level: str | None = None, service: str | None = None,
               q: str | None = None) -> DataFrame:
    return J.search_logs(t.service_logs, limit, level, service, q)


def job_runs(t: Tables, service: str | None = None, limit: int = 25) -> DataFrame:
    """Newest runs, of one job or of all."""
    events = t.run_events
    if service:
        events = events.where(F.col("service") == F.lit(service))
    return latest_n(J.run_ledger(events), "started_at", limit, "id")


def job_list(t: Tables) -> DataFrame:
    """All jobs with their newest run and what to show for them."""
    return J.job_status(t.services, J.run_ledger(t.run_events)).orderBy(up("category"), up("display_name"))


def notification_feed(t: Tables, limit: int = 50) -> DataFrame:
    """Newest notifications, each beside the number of unread ones."""
    unread = J.unread_count(t.notifications).scalar()
    return latest_n(t.notifications, "ts", limit, "id").withColumn("unread", unread)
