"""Charter route products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.decode import period_label, ratio
from skyspine.functions.text import contains
from skyspine.operators import traffic
from skyspine.operators.airports import airport_by_code
from skyspine.operators.filters import optional_filters
from skyspine.tables import Tables


def _on_route(carrier: str | None, origin: str | None, dest: str | None) -> list[tuple[object, Column]]:
    return [(carrier, F.col("unique_carrier") == F.lit(carrier)),
            (origin, F.col("origin") == F.lit((origin or "").upper())),
            (dest, F.col("dest") == F.lit((dest or "").upper()))]


def charter_route_list(t: Tables, q: str | None = None, origin: str | None = None, dest: str | None = None,
                       limit: int = 300, cap: int | None = None) -> DataFrame:
    """Busiest charter routes under those filters that were given; the filters reach the scan."""
    rows = optional_filters(traffic.charter_routes(t), (q, contains(F.col("carrier_name"), q or "")),
                            *_on_route(None, origin, dest))
    return traffic.route_totals(rows, limit, cap)


def charter_route_detail(t: Tables, carrier: str | None = None, origin: str | None = None,
                         dest: str | None = None) -> DataFrame:
    """Summary of each route (or of one), with load ratio and the airports its codes stand for."""
    rows = optional_filters(traffic.charter_routes(t), *_on_route(carrier, origin, dest))
    codes = airport_by_code(t)
    ends = [codes.select(F.col("code").alias(end), F.col("ident").alias(f"{end}_ident"),
                         F.col("name").alias(f"{end}_airport")) for end in ("origin", "dest")]
    summary = traffic.route_summary(rows).withColumn(
        "pax_per_departure", ratio(F.col("passengers"), F.nullif(F.col("departures"), F.lit(0).cast("decimal(18,2)"))))
    return summary.join(ends[0], "origin", "left").join(ends[1], "dest", "left")


def charter_route_months(t: Tables, carrier: str | None = None, origin: str | None = None,
                         dest: str | None = None) -> DataFrame:
    """Traffic by month of each route (or of one) with the period spelled out."""
    rows = optional_filters(traffic.charter_routes(t), *_on_route(carrier, origin, dest))
    return traffic.route_monthly(rows).withColumn("period", period_label(F.col("year"), F.col("month")))


def charter_route_aircraft(t: Tables, carrier: str | None = None, origin: str | None = None,
                           dest: str | None = None) -> DataFrame:
    """Traffic by aircraft type of each route (or of one); a dash for a type without a name."""
    rows = optional_filters(traffic.charter_routes(t), *_on_route(carrier, origin, dest))
    mix = traffic.route_aircraft_mix(rows, t.aircraft_type_ref)
    return mix.withColumn("aircraft_name", F.coalesce("aircraft_name", F.lit(V.DASH)))


def charter_route_report(t: Tables, carrier: str | None = None, origin: str | None = None, dest: str | None = None) -> DataFrame:
    """Everything the page of a route (or of each) shows, one row per item: summary, months and aircraft, from one scan of the segments.

    The columns are those of the three products above; an item has NULL where its section has no such column.
    """
    rows = traffic.route_report(optional_filters(traffic.charter_routes(t), *_on_route(carrier, origin, dest)))
    is_summary, is_month, is_aircraft = (F.col("section") == s for s in ("summary", "month", "aircraft"))
    codes = airport_by_code(t)
    ends = [codes.select(F.col("code").alias(f"_{end}"), F.col("ident").alias(f"{end}_ident"), F.col("name").alias(f"{end}_airport"))
            for end in ("origin", "dest")]
    rows = rows.withColumn("pax_per_departure", F.when(is_summary, ratio(
        F.col("passengers"), F.nullif(F.col("departures"), F.lit(0).cast("decimal(18,2)")))))
    rows = rows.withColumn("period", F.when(is_month, period_label(F.col("year"), F.col("month"))))
    rows = rows.withColumn("_origin", F.when(is_summary, F.col("origin"))).withColumn("_dest", F.when(is_summary, F.col("dest")))
    rows = traffic.decode_join(rows, t.aircraft_type_ref).withColumn(
        "aircraft_name", F.when(is_aircraft, F.coalesce("aircraft_name", F.lit(V.DASH))))
    return rows.join(ends[0], "_origin", "left").join(ends[1], "_dest", "left").drop("_origin", "_dest")
