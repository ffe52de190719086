"""The platform summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyspine.operators import spine
from skyspine.operators.joblog import job_status, run_ledger
from skyspine.operators.ordering import down, up
from skyspine.operators.traffic import charter_routes
from skyspine.tables import Tables


#: Operators shown by rank.
OPERATORS_SHOWN = 10


def platform_stats(t: Tables) -> DataFrame:
    """Counts, categories with their share, largest operators by rank and job states, each with the columns that it has.

    The spine's figures come from one pass (``spine_totals``); the other counts read no column of their tables.
    """
    sums = spine.spine_totals(t)
    # Only operators compete for a place, so the limit reaches them before the exchange and no task ranks them all.
    rivals = Window.partitionBy("section", F.when(F.col("section") != "operator", F.col("name"))).orderBy(down("n"), up("name"))
    shown = sums.withColumn("place", F.row_number().over(rivals)).where(F.col("place") <= OPERATORS_SHOWN)
    shown = shown.withColumn("top", F.greatest(F.max("n").over(Window.partitionBy("section")), F.lit(1)).cast("double"))
    whole = F.col("section") == "all"
    parts = F.when(whole, F.array(*[F.struct(F.lit(k).alias("name"), F.col(c).alias("n")) for k, c in (("aircraft", "n"), ("adsb_ready", "ready"))])
                   ).otherwise(F.array(F.struct(F.col("name").alias("name"), F.col("n").alias("n"))))
    rows = shown.select("section", "place", "top", F.explode(parts).alias("part"))
    figures = rows.select(
        F.when(F.col("section") == "all", F.lit("count")).otherwise(F.col("section")).alias("section"), F.col("part.name").alias("name"),
        F.col("part.n").alias("n"), F.when(F.col("section") == "category", F.round(F.col("part.n") * 100.0 / F.col("top"), 1)).alias("share"),
        F.when(F.col("section") == "operator", F.col("place")).cast("int").alias("position"))
    counts = spine.table_counts({"operators": t.operators, "registry": t.faa_registry, "reference": t.aircraft_ref, "emails": t.emails,
                                 "charter_segments": charter_routes(t), "airports": t.airports}).select(
        F.lit("count").alias("section"), F.col("relation").alias("name"), F.col("rows").alias("n"))
    jobs = job_status(t.services, run_ledger(t.run_events)).select(
        F.lit("job").alias("section"), F.col("display_name").alias("name"), F.col("shown_status").alias("note"), "enabled",
        "last_finished_at")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (counts, figures, jobs))
