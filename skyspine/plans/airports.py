"""Airport products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.clean import first_nonblank, strip
from skyspine.functions.decode import clean_type, coord_text, distinct_codes, format_count, pair_label, title_case
from skyspine.functions.weather import (altimeter_inhg, ceiling, change_label, cloud_text, forecast_wind_text, wind_text,
                                        zulu)
from skyspine.functions.clean import truncate_text
from skyspine.functions.decode import whole_number
from skyspine.functions.text import contains
from skyspine.operators import airports as A
from skyspine.operators import hazards as H
from skyspine.operators.filters import exclude_types, min_threshold, optional_filters
from skyspine.operators.joblog import newest_per_key
from skyspine.operators.ordering import down_nulls_last, page, up
from skyspine.tables import Tables


def airport_filter(t: Tables, q: str | None = None, country: str | None = None, type: str | None = None,
                   min_runway: int = 0) -> DataFrame:
    """Airports with their capability under those filters that were given."""
    words = q or ""
    hit = (contains(F.col("name"), words) | contains(F.col("municipality"), words)
           | contains(F.col("iata_code"), words) | contains(F.col("ident"), words))
    rows = optional_filters(A.airport_capability(t), (q, hit),
                            (country, F.col("iso_country") == F.lit((country or "").upper())),
                            (type, F.col("type") == F.lit(type)))
    rows = rows if type else exclude_types(rows)
    return min_threshold(rows, "longest_runway_ft", min_runway)


def airport_search(t: Tables, q: str | None = None, country: str | None = None, type: str | None = None,
                   min_runway: int = 0, limit: int = 200, cap: int | None = None) -> DataFrame:
    """One page of airports, longest runway first; ``cap`` is for a caller that holds requests to a size."""
    return page(airport_filter(t, q, country, type, min_runway), [down_nulls_last("longest_runway_ft"), up("ident")],
                limit, cap)


def airport_detail(t: Tables, ident: str | None = None) -> DataFrame:
    """Airport profiles ready for display, of all airports or of one; one row per runway."""
    rows = A.airport_profile(t)
    if ident is not None:
        rows = rows.where(F.col("ident") == F.lit(ident))
    extra = distinct_codes([F.col("ident"), F.col("local_code"), F.col("gps_code")],
                           [F.col("iata_code"), F.col("icao_code")])
    feet = F.col("longest_runway_ft")
    return rows.select(
        "ident", "name", clean_type(F.col("type")).alias("size"),
        F.when(F.coalesce(feet, F.lit(0)) == 0, F.lit(V.DASH)).otherwise(
            F.concat(format_count(feet), F.lit(" ft"))).alias("longest_runway"),
        "runway_count", title_case(F.col("municipality")).alias("city"), "iso_region", "iso_country",
        coord_text(F.col("latitude_deg"), F.col("longitude_deg")).alias("coordinates"),
        F.when(F.col("elevation_ft").isNotNull(), F.concat(format_count(F.col("elevation_ft")), F.lit(" ft"))).alias(
            "elevation"),
        F.when(F.col("scheduled_service"), F.lit("Yes")).otherwise(F.lit("No")).alias("scheduled"),
        F.array_join(extra, " ").alias("other_codes"), title_case(F.col("owner_name")).alias("owner"), "owner_phone",
        title_case(F.col("manager_name")).alias("manager"), "manager_phone", "runway_id",
        F.when(F.col("runway_id").isNotNull(), pair_label(F.col("le_ident"), F.col("he_ident"))).alias("runway"),
        "length_ft", "width_ft", "surface", "lighted", "closed")


def stations(t: Tables) -> DataFrame:
    """Airports as weather stations: the ICAO code, else the ident."""
    return t.airports.select("ident", strip(first_nonblank(F.col("icao_code"), F.col("ident"))).alias("station"),
                             F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))


#: Hours for which an observation, a pilot report and a forecast count as current.
OBSERVATION_HOURS, FORECAST_HOURS = 2.0, 30.0


def current(reports: DataFrame, time: str, as_of: int | None, hours: float) -> DataFrame:
    """Reports of the last hours before ``as_of`` (seconds since 1970); all of them if that is not given."""
    if as_of is None:
        return reports
    return reports.where((F.col(time) <= F.lit(as_of)) & (F.col(time) > F.lit(as_of - int(hours * 3600))))


def station_report(t: Tables, as_of: int | None = None) -> DataFrame:
    """Per station the newest observation and forecast that are current. Stations without either stay, with NULLs."""
    metar = newest_per_key(current(t.metar, "obs_time", as_of, OBSERVATION_HOURS), "station", "obs_time", "report_id")
    taf = newest_per_key(current(t.taf, "issue_time", as_of, FORECAST_HOURS), "station", "issue_time", "taf_id").withColumnRenamed("raw_ob", "raw_taf")
    return (stations(t).join(metar.withColumnRenamed("report_id", "metar_id"), "station", "left")
            .join(taf.drop("from1"), "station", "left"))


def current_conditions(metar: DataFrame) -> DataFrame:
    """Observations ready for display."""
    dash = F.lit(V.DASH)

    def degrees(column: str):
        return F.coalesce(F.concat(whole_number(F.col(column)).cast("string"), F.lit("°C")), dash)

    top = ceiling(F.col("clouds"))
    return metar.select(
        "station", "report_id", F.coalesce("flt_cat", dash).alias("flight_category"),
        wind_text(F.col("wdir"), F.col("wspd"), F.col("wgst")).alias("wind"),
        F.coalesce(F.concat("visib", F.lit(" SM")), dash).alias("visibility"),
        F.coalesce(F.concat(F.format_number(top, 0), F.lit(" ft")), F.lit("Unlimited")).alias("ceiling"),
        cloud_text(F.col("clouds")).alias("clouds"), degrees("temp").alias("temperature"),
        degrees("dewp").alias("dewpoint"), altimeter_inhg(F.col("altim")).alias("altimeter_inhg"),
        zulu(F.col("obs_time")).alias("observed"), "raw_ob")


def forecast_periods(taf: DataFrame) -> DataFrame:
    """One row per forecast period; a forecast without periods gives one row of NULLs."""
    rows = taf.select("station", "taf_id", F.posexplode_outer("fcsts").alias("pos", "f"))
    return rows.select(
        "station", "taf_id", F.col("pos").cast("bigint").alias("pos"),
        zulu(F.col("f.timeFrom")).alias("time_from"), zulu(F.col("f.timeTo")).alias("time_to"),
        change_label(F.col("f.fcstChange"), F.col("f.probability")).alias("change"),
        forecast_wind_text(F.col("f.wdir"), F.col("f.wspd"), F.col("f.wgst")).alias("wind"),
        F.coalesce(F.concat("f.visib", F.lit(" SM")), F.lit(V.DASH)).alias("visibility"), F.col("f.wxString").alias("weather"),
        cloud_text(F.col("f.clouds")).alias("clouds"))


def _as_shown() -> list[Column]:
    """What is shown of a hazard, the raw text cut to the shown length."""
    return [F.coalesce("hazard", "source").alias("title"), F.col("source"), F.col("severity"), zulu(F.col("valid_time_to")).alias("until"),
            F.when(F.col("altitude_low").isNotNull(),
                   F.concat(F.lit("FL"), F.col("altitude_low").cast("string"), F.lit("–"),
                            F.col("altitude_hi").cast("string"))).alias("levels"),
            truncate_text(F.col("raw"), V.HAZARD_TEXT_CHARS).alias("raw")]


def hazards_shown(points: DataFrame, hazards: DataFrame) -> DataFrame:
    """Hazards over each point ready for display."""
    return H.hazards_over_points(points, hazards).select("ident", "station", "hazard_id", *_as_shown())


def hazards_shown_once(points: DataFrame, hazards: DataFrame) -> DataFrame:
    """The distinct rows of ``hazards_shown`` without the id of the hazard.

    Two rows can be equal only where two hazards read alike or a station has two places. Both are found before the join, so that its
    pairs, which grow with the product of both, are moved and compared for those alone.
    """
    shown = ["title", "source", "severity", "until", "levels", "raw"]
    areas = H.shown_areas(hazards).select("coords", *_as_shown()).withColumn("_alike", F.count(F.lit(1)).over(Window.partitionBy(*shown)) > 1)
    places = points.dropDuplicates(["ident", "station", "lat", "lon"]).withColumn(
        "_again", F.count(F.lit(1)).over(Window.partitionBy("ident", "station")) > 1)

    def pairs(points: DataFrame, areas: DataFrame) -> DataFrame:
        return H.point_in_polygon_join(points.drop("_again"), areas.drop("_alike")).select("ident", "station", *shown)

    lone = areas.where(~F.col("_alike"))
    twice = pairs(places, areas.where("_alike")).unionByName(pairs(places.where("_again"), lone))
    return pairs(places.where(~F.col("_again")), lone).unionByName(twice.distinct())


def airport_weather(t: Tables, ident: str | None = None, as_of: int | None = None, once: bool = False) -> DataFrame:
    """Everything the weather panel of an airport shows, one row per item: ident, station, part, place, and typed columns.

    Parts are conditions, forecast, hazard and report; columns that a part lacks are NULL. A list inside one row could not be
    bounded for a busy station. With ``ident`` only that station's reports are looked at, before the newest are formed; with ``as_of``
    only current ones; with ``once`` no two rows are equal but for their place, which is left out.
    """
    at = stations(t)
    if ident is not None:
        at = at.where(F.col("ident") == F.lit(ident))
    here = at.select("ident", "station")

    def chosen(reports: DataFrame) -> DataFrame:
        return reports if ident is None else reports.join(here, "station", "left_semi")

    def part(name: str, place: Column) -> list[Column]:
        return ["ident", "station", F.lit(name).alias("part"), place.cast("bigint").alias("place")]

    metar = newest_per_key(chosen(current(t.metar, "obs_time", as_of, OBSERVATION_HOURS)), "station", "obs_time", "report_id")
    conditions = current_conditions(metar).join(here, "station").select(
        *part("conditions", F.lit(0)), "flight_category", "wind", "visibility", "ceiling", "clouds", "temperature", "dewpoint",
        "altimeter_inhg", "observed", F.col("raw_ob").alias("raw"))
    taf = newest_per_key(chosen(current(t.taf, "issue_time", as_of, FORECAST_HOURS)), "station", "issue_time", "taf_id")
    heads = taf.select("station", zulu(F.col("issue_time")).alias("issued"), F.col("raw_taf").alias("raw"))
    forecast = forecast_periods(taf).join(heads, "station").join(here, "station").select(
        *part("forecast", F.col("pos")), "issued", "time_from", "time_to", "change", "wind", "visibility", "weather", "clouds", "raw")
    hazards = t.hazards if as_of is None else t.hazards.where(F.col("valid_time_to") > F.lit(as_of))
    fields = ["title", "source", "severity", "until", "levels", "raw"]
    if once:
        over = hazards_shown_once(at, hazards).select("ident", "station", F.lit("hazard").alias("part"), *fields)
    else:
        over = hazards_shown(at, hazards).select(*part("hazard", F.col("hazard_id")), *fields)
    reports = current(t.pireps, "obs_time", as_of, OBSERVATION_HOURS)
    near = H.nearby_reports(at, reports).select(
        *part("report", F.col("position")), "ac_type", F.concat(F.lit("FL"), "flt_lvl").alias("levels"),
        zulu(F.col("obs_time")).alias("observed"), F.col("raw_ob").alias("raw"))
    if once:
        conditions, forecast, near = (x.drop("place").distinct() for x in (conditions, forecast, near))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (conditions, forecast, over, near))
