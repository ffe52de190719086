"""Weather report scalars over nested documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.clean import blank_to_null, first_nonblank


def ceiling(clouds: Column) -> Column:
    """Lowest base among the layers that make a ceiling."""
    layers = F.filter(clouds, lambda c: c["cover"].isin(V.CEILING_COVERS) & c["base"].isNotNull())
    return F.array_min(F.transform(layers, lambda c: c["base"]))


def cloud_text(clouds: Column) -> Column:
    """``BKN 2,500, OVC 4,000``; ``Clear`` without layers."""
    parts = F.transform(
        clouds,
        lambda c: F.concat(c["cover"], F.coalesce(F.concat(F.lit(" "), F.format_number(c["base"], 0)), F.lit(""))),
    )
    return F.coalesce(blank_to_null(F.array_join(parts, ", ")), F.lit("Clear"))


def altimeter_inhg(hpa: Column) -> Column:
    return F.round(hpa / F.lit(V.HPA_PER_INHG), 2)


def _gust(gust: Column, prefix: str) -> Column:
    return F.when(gust.isNotNull() & (gust != 0), F.concat(F.lit(prefix), gust.cast("string"))).otherwise(F.lit(""))


def wind_text(direction: Column, speed: Column, gust: Column) -> Column:
    """Observed wind; direction 0 with a speed is variable."""
    speed0 = F.coalesce(speed, F.lit(0))
    heading = F.when((direction.try_cast("int") == 0) & (speed0 != 0), F.lit("VRB")).otherwise(
        F.concat(direction.cast("string"), F.lit("°")))
    shown = F.concat(heading, F.lit(" @ "), F.format_number(speed0, 0), F.lit(" kt"), _gust(gust, " G"))
    return F.when(direction.isNull(), F.lit(V.DASH)).otherwise(shown)


def forecast_wind_text(direction: Column, speed: Column, gust: Column) -> Column:
    shown = F.concat(direction.cast("string"), F.lit("° @ "), F.format_number(F.coalesce(speed, F.lit(0)), 0),
                     F.lit("kt"), _gust(gust, "G"))
    return F.when(direction.isNull(), F.lit(V.DASH)).otherwise(shown)


def zulu(epoch_seconds: Column) -> Column:
    """Day and UTC time, ``05 14:30Z``."""
    return F.date_format(F.timestamp_seconds(epoch_seconds), "dd HH:mm'Z'")


def change_label(change: Column, probability: Column) -> Column:
    """Kind of forecast period, with its probability; ``FROM`` when none is given."""
    suffix = F.when(probability.isNotNull() & (probability != 0),
                    F.concat(F.lit(" "), probability.cast("string"), F.lit("%"))).otherwise(F.lit(""))
    return F.coalesce(F.concat(blank_to_null(change), suffix), F.lit("FROM"))


def first_photo(photos: Column) -> Column:
    """The first photo of an answer, its large thumbnail else the small one; no photo is a result too."""
    p = F.try_element_at(photos, F.lit(1))
    return F.struct(
        (F.coalesce(F.array_size(photos), F.lit(0)) > 0).alias("has_photo"),
        p["id"].alias("photo_id"),
        first_nonblank(p["thumbnail_large"]["src"], p["thumbnail"]["src"]).alias("thumbnail_url"),
        p["link"].alias("page_link"),
        p["photographer"].alias("photographer"),
    )
