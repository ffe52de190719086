"""Charter traffic: the route view and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.decode import city_of, class_desc, pad_code, round_measure
from skyspine.operators.ordering import down, page, up
from skyspine.tables import Tables

ROUTE_KEYS = ["unique_carrier", "carrier_name", "origin", "origin_city", "origin_state", "dest", "dest_city",
              "dest_state"]
VIEW_COLUMNS = ["year", "month", "unique_carrier", "carrier_name", "origin", "origin_city", "origin_state", "dest",
                "dest_city", "dest_state", "aircraft_type", "aircraft_config", "departures", "seats", "passengers",
                "distance"]


def charter_routes(t: Tables) -> DataFrame:
    """Non-scheduled civil segments with their class spelled out."""
    return (t.t100_segment.where(F.col("class").isin(list(V.CHARTER_CLASSES)))
            .select(*VIEW_COLUMNS, class_desc(F.col("class")).alias("class_desc")))


def _months():
    return F.count_distinct(F.struct("year", "month")).alias("months")


def _distance():
    return round_measure(F.max("distance")).alias("distance")


def route_totals(routes: DataFrame, limit: int | None = None, cap: int | None = None) -> DataFrame:
    """Traffic per carrier and route, busiest first; routes without a departure are left out.

    Groups are formed on the raw city names, so two spellings of one city stay two rows.
    """
    totals = (routes.groupBy(*ROUTE_KEYS)
              .agg(F.sum("departures").alias("departures"), F.sum("passengers").alias("passengers"), _distance(),
                   _months())
              .where(F.col("departures") > 0)
              .withColumn("raw_origin_city", F.col("origin_city"))
              .withColumn("raw_dest_city", F.col("dest_city"))
              .withColumn("origin_city", city_of(F.col("origin_city")))
              .withColumn("dest_city", city_of(F.col("dest_city"))))
    if limit is not None:
        totals = page(totals, [down("departures"), *[up(c) for c in (
            "unique_carrier", "origin", "dest", "carrier_name", "raw_origin_city", "raw_dest_city", "origin_state",
            "dest_state")]], limit, cap)
    return totals.drop("raw_origin_city", "raw_dest_city")


def route_summary(routes: DataFrame) -> DataFrame:
    """One row per carrier, origin and destination; the labels are those of its newest period.

    Raw rows are hashed to one row per labels and period first; only those few are sorted for the newest.
    """
    labels = ["carrier_name", "origin_city", "origin_state", "dest_city", "dest_state"]
    newest = F.max(F.struct("year", "month", *labels)).alias("_newest")
    periods = routes.groupBy(*ROUTE_KEYS, "year", "month").agg(
        *[F.sum(c).alias(c) for c in ("departures", "passengers", "seats")], F.max("distance").alias("distance"))
    return (periods.groupBy("unique_carrier", "origin", "dest")
            .agg(newest, F.sum("departures").alias("departures"), F.sum("passengers").alias("passengers"),
                 F.sum("seats").alias("seats"), _distance(), _months())
            .select("unique_carrier", "origin", "dest",
                    *[city_of(F.col(f"_newest.{c}")).alias(c) if c.endswith("city") else F.col(f"_newest.{c}")
                      for c in labels],
                    "departures", "passengers", "seats", "distance", "months"))


def route_monthly(routes: DataFrame) -> DataFrame:
    """Traffic per carrier, route and month."""
    return routes.groupBy("unique_carrier", "origin", "dest", "year", "month").agg(
        F.sum("departures").alias("departures"), F.sum("seats").alias("seats"),
        F.sum("passengers").alias("passengers"))


def route_report(routes: DataFrame) -> DataFrame:
    """Summary, months and aircraft of every route from one pass, told apart by ``section``.

    Rows are reduced once to carrier, route, labels, period and aircraft type. Those few rows, bounded for a route, are moved to
    their route and listed there once for each section, so that the three sections are formed in place. Columns that a section lacks
    are NULL; the labels of the summary are those of the newest period.
    """
    labels = ["carrier_name", "origin_city", "origin_state", "dest_city", "dest_state"]
    route = ["unique_carrier", "origin", "dest"]
    reduced = routes.groupBy(*ROUTE_KEYS, "year", "month", "aircraft_type").agg(
        *[F.sum(c).alias(c) for c in ("departures", "passengers", "seats")], F.max("distance").alias("distance"))
    listed = reduced.repartition(*route).withColumn("section", F.explode(F.array(*[F.lit(s) for s in ("summary", "month", "aircraft")])))
    summary, month, aircraft = (F.col("section") == s for s in ("summary", "month", "aircraft"))
    # What a section does not show is left out before its sums are formed.
    listed = listed.select(
        *route, "section", *[F.when(month, F.col(c)).alias(c) for c in ("year", "month")],
        F.when(aircraft, F.col("aircraft_type")).alias("aircraft_type"), "departures", "passengers",
        F.when(~aircraft, F.col("seats")).alias("seats"), F.when(summary, F.col("distance")).alias("distance"),
        F.when(summary, F.struct("year", "month")).alias("_period"), F.when(summary, F.struct("year", "month", *labels)).alias("_labels"))
    sums = listed.groupBy(*route, "section", "year", "month", "aircraft_type").agg(
        F.sum("departures").alias("departures"), F.sum("passengers").alias("passengers"), F.sum("seats").alias("seats"), _distance(),
        F.size(F.collect_set("_period")).cast("bigint").alias("months"), F.max("_labels").alias("_newest"))
    summary = F.col("section") == "summary"
    label = [(city_of(F.col(f"_newest.{c}")) if c.endswith("city") else F.col(f"_newest.{c}")).alias(c) for c in labels]
    return sums.select("section", *route, *label, "year", "month", "aircraft_type", "departures", "passengers", "seats", "distance",
                       F.when(summary, F.col("months")).alias("months"))


def decode_join(df: DataFrame, type_ref: DataFrame, column: str = "aircraft_type") -> DataFrame:
    """Attach the aircraft name by the padded type code."""
    names = type_ref.select(F.col("code").alias("_code"), F.col("description").alias("aircraft_name"))
    return df.withColumn("_code", pad_code(F.col(column))).join(names, "_code", "left").drop("_code")


def route_aircraft_mix(routes: DataFrame, type_ref: DataFrame) -> DataFrame:
    """Traffic per carrier, route and aircraft type; the name is attached to the totals."""
    totals = routes.groupBy("unique_carrier", "origin", "dest", "aircraft_type").agg(
        F.sum("departures").alias("departures"), F.sum("passengers").alias("passengers"))
    return decode_join(totals, type_ref)
