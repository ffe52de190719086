"""Airports: capability, code resolution, contacts, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.clean import blank_to_null, nonblank
from skyspine.operators.keys import keep_first, parents_with_children
from skyspine.operators.ordering import down, up
from skyspine.tables import Tables

CAPABILITY_COLUMNS = ["ident", "name", "type", "iso_country", "iso_region", "municipality", "iata_code", "icao_code",
                      "local_code", "latitude_deg", "longitude_deg", "elevation_ft"]


def open_runways(runways: DataFrame) -> DataFrame:
    """Longest open runway and number of open runways per airport; a runway of unknown state is not open."""
    return (runways.where(~F.col("closed")).groupBy(F.col("airport_ident").alias("ident"))
            .agg(F.max("length_ft").alias("longest_runway_ft"), F.count("id").alias("runway_count")))


def airport_capability(t: Tables) -> DataFrame:
    """Each airport with its longest open runway; runways are counted before the join."""
    return (t.airports.select(*CAPABILITY_COLUMNS).join(open_runways(t.runways), "ident", "left")
            .withColumn("runway_count", F.coalesce("runway_count", F.lit(0)).cast("bigint")))


def jet_capable(t: Tables, least_ft: int = V.JET_RUNWAY_FT) -> DataFrame:
    """Number of airports whose longest open runway reaches the length."""
    long_enough = open_runways(t.runways).where(F.col("longest_runway_ft") >= least_ft)
    return (t.airports.select("ident").join(long_enough, "ident", "left_semi")
            .agg(F.count(F.lit(1)).alias("jet_capable")))


def airport_by_code(t: Tables) -> DataFrame:
    """The airport each code stands for: large airports first, then by ident.

    A code may be the IATA or the local code, so both are listed and one row per code is kept before
    anything is joined to it.
    """
    large = (F.coalesce(F.col("type") == "large_airport", F.lit(False))).alias("large")
    def listed(column: str) -> DataFrame:
        return t.airports.where(nonblank(F.col(column))).select(F.col(column).alias("code"), "ident", "name", large)
    both = listed("iata_code").unionByName(listed("local_code"))
    return keep_first(both, ["code"], [down("large"), up("ident")]).drop("large")


def best_airport(codes: DataFrame, t: Tables) -> DataFrame:
    """Each code with its airport, or NULLs when no airport has that code."""
    return codes.join(airport_by_code(t), "code", "left")


def contacts(t: Tables) -> DataFrame:
    return t.faa_airport_detail.select(F.col("location_id").alias("local_code"), "owner_name", "owner_phone",
                                       "manager_name", "manager_phone")


def airport_contacts(t: Tables) -> DataFrame:
    """Airports with their owner and manager; a blank local code finds none."""
    airports = t.airports.select("ident", "name", blank_to_null(F.col("local_code")).alias("local_code"))
    return airports.join(contacts(t), "local_code", "left")


def airport_profile(t: Tables) -> DataFrame:
    """Airport, capability and contacts with one row per runway, or one row when it has none."""
    airports = (t.airports.withColumn("_contact", blank_to_null(F.col("local_code")))
                .join(contacts(t).withColumnRenamed("local_code", "_contact"), "_contact", "left").drop("_contact")
                .join(open_runways(t.runways), "ident", "left")
                .withColumn("runway_count", F.coalesce("runway_count", F.lit(0)).cast("bigint")))
    runways = t.runways.select(F.col("airport_ident").alias("ident"), F.col("id").alias("runway_id"), "le_ident",
                               "he_ident", "length_ft", "width_ft", "surface", "lighted", "closed")
    return parents_with_children(airports, runways, ["ident"])


def jet_base_totals(detail: DataFrame) -> DataFrame:
    """Airports with based jets, and how many jets in all."""
    return detail.where(F.col("based_jet") > 0).agg(
        F.count(F.lit(1)).alias("airports"), F.coalesce(F.sum("based_jet"), F.lit(0)).cast("bigint").alias("jets"))
