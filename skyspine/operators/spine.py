"""The spine: tail -> operator -> aircraft -> transponder code, and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyspine.functions.clean import blank_to_null, nonblank
from skyspine.operators.keys import parents_with_children
from skyspine.operators.ordering import down, down_nulls_last, page, up
from skyspine.tables import Tables


def charter_fleet(t: Tables) -> DataFrame:
    """The spine view: every certificate tail with its operator and, where known, its registration."""
    links = t.part135_aircraft.select("n_number", "certificate_designator",
                                      blank_to_null(F.col("make_model_series")).alias("make_model_series"))
    holders = t.operators.select("certificate_designator", "operator_name", "fsdo")
    registry = t.faa_registry.select("n_number", "mode_s_hex", F.col("registrant_name").alias("registered_owner"),
                                     "registrant_type", "year_mfr", "status_code")
    return (links.join(holders, "certificate_designator").join(registry, "n_number", "left")
            .select("n_number", "operator_name", "certificate_designator", "fsdo", "make_model_series", "mode_s_hex",
                    "registered_owner", "registrant_type", "year_mfr", "status_code"))


def _registry_decoded(t: Tables) -> DataFrame:
    registry = t.faa_registry.select(
        "n_number", "mfr_mdl_code", "mode_s_hex", F.col("registrant_name").alias("registered_owner"),
        "registrant_type", "year_mfr", "status_code")
    reference = t.aircraft_ref.select(F.col("code").alias("mfr_mdl_code"), "manufacturer", "model", "category",
                                      "aircraft_type", "engine_type", "num_seats")
    return registry.join(reference, "mfr_mdl_code", "left").drop("mfr_mdl_code")


def fleet_enriched(t: Tables) -> DataFrame:
    """The spine with the decoded make, model and category."""
    links = t.part135_aircraft.select("n_number", "certificate_designator", "make_model_series")
    holders = t.operators.select("certificate_designator", "operator_name", "fsdo")
    return (links.join(holders, "certificate_designator").join(_registry_decoded(t), "n_number", "left")
            .select("n_number", "operator_name", "certificate_designator", "fsdo", "make_model_series", "mode_s_hex",
                    "registered_owner", "registrant_type", "year_mfr", "status_code", "manufacturer", "model",
                    "category", "aircraft_type", "engine_type", "num_seats"))


def adsb_ready(df: DataFrame) -> DataFrame:
    """Rows with a transponder code."""
    return df.where(nonblank(F.col("mode_s_hex")))


def operators_left_fleet(t: Tables) -> DataFrame:
    """Every operator with its tails and their categories; operators without a tail are kept."""
    links = t.part135_aircraft.select("certificate_designator", "n_number")
    owned = parents_with_children(t.operators.select("certificate_designator", "operator_name", "fsdo"), links,
                                  ["certificate_designator"])
    return (owned.join(tail_category(t), "n_number", "left")
            .select("certificate_designator", "operator_name", "fsdo", "n_number", "category"))


def tail_category(t: Tables) -> DataFrame:
    """Registered tail -> category."""
    reference = t.aircraft_ref.select(F.col("code").alias("mfr_mdl_code"), "category")
    return t.faa_registry.select("n_number", "mfr_mdl_code").join(reference, "mfr_mdl_code", "left").select(
        "n_number", "category")


def photo_backlog(t: Tables, limit: int | None = None) -> DataFrame:
    """Tails without a photo record, jets first.

    Tails are made distinct before the joins: the category depends on the tail alone.
    """
    waiting = (t.part135_aircraft.select("n_number").distinct()
               .join(t.aircraft_photos.select("n_number"), "n_number", "left_anti"))
    rows = waiting.join(tail_category(t), "n_number", "left").select(
        "n_number", (F.col("category") == "Jet").alias("is_jet"))
    if limit is None:
        return rows
    return page(rows, [down_nulls_last("is_jet"), up("n_number")], limit)


def aircraft_profile(t: Tables) -> DataFrame:
    """Everything known about each tail: one row per tail and certificate, or one for a tail without any.

    A tail is listed when it is registered or on a certificate. Photos meet the registrations first: what a full outer join gives moves
    once more for the next join, and registrations with photos are fewer than certificates with both.
    """
    reference = t.aircraft_ref.select(
        F.col("code").alias("mfr_mdl_code"), "manufacturer", "model", "aircraft_type", "engine_type", "category",
        "num_engines", "num_seats")
    registry = (t.faa_registry.withColumn("registered", F.lit(True))
                .join(reference, "mfr_mdl_code", "left"))
    held = (t.part135_aircraft.withColumnRenamed("serial_number", "certificate_serial")
            .join(t.operators.select("certificate_designator", "operator_name", "fsdo"), "certificate_designator"))
    photos = t.aircraft_photos.where("has_photo").select("n_number", "local_path", "page_link", "photographer")
    # A tail has one registration and one photo, so the only rows that repeat it are its certificates.
    known = registry.join(photos, "n_number", "full_outer")
    return (held.join(known, "n_number", "full_outer").where(F.col("registered") | F.col("certificate_designator").isNotNull())
            .withColumn("registered", F.coalesce("registered", F.lit(False))))


def count_by_category(t: Tables) -> DataFrame:
    """Certificate tails per category, ``Unknown`` when there is none; counted per tail before the join."""
    tails = t.part135_aircraft.groupBy("n_number").agg(F.count(F.lit(1)).alias("links"))
    return (tails.join(tail_category(t), "n_number", "left")
            .groupBy(F.coalesce("category", F.lit("Unknown")).alias("category"))
            .agg(F.sum("links").alias("n")))


def top_operators(t: Tables, k: int = 10) -> DataFrame:
    """Largest fleets by operator name; certificates with one name are merged."""
    per_certificate = t.part135_aircraft.groupBy("certificate_designator").agg(F.count(F.lit(1)).alias("links"))
    named = per_certificate.join(t.operators.select("certificate_designator", "operator_name"),
                                 "certificate_designator")
    totals = named.groupBy("operator_name").agg(F.sum("links").alias("n"))
    return page(totals, [down("n"), up("operator_name")], k)


def _count_of(category: str) -> Column:
    return F.count_if(F.col("category") == category)


def operator_fleet_agg(t: Tables, operators: DataFrame | None = None) -> DataFrame:
    """Fleet size and category counts per certificate; an operator without tails counts zero.

    The tails are counted per certificate before the operators are joined. ``operators`` narrows the
    result; the narrowing reaches the tails by a semi join.
    """
    links = t.part135_aircraft.select("certificate_designator", "n_number")
    holders = (operators if operators is not None else t.operators).select(
        "certificate_designator", "operator_name", "fsdo")
    if operators is not None:
        links = links.join(holders.select("certificate_designator"), "certificate_designator", "left_semi")
    counts = (links.join(tail_category(t), "n_number", "left")
              .groupBy("certificate_designator")
              .agg(F.count("n_number").alias("fleet_size"), _count_of("Jet").alias("jets"),
                   _count_of("Turboprop").alias("turboprops"), _count_of("Helicopter").alias("helicopters")))
    totals = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
              for c in ("fleet_size", "jets", "turboprops", "helicopters")]
    return holders.join(counts, "certificate_designator", "left").select(
        "certificate_designator", "operator_name", "fsdo", *totals)


def fsdo_totals(t: Tables) -> DataFrame:
    """Operators and tails per district."""
    per_certificate = t.part135_aircraft.groupBy("certificate_designator").agg(F.count("n_number").alias("tails"))
    return (t.operators.select("certificate_designator", "fsdo")
            .join(per_certificate, "certificate_designator", "left")
            .groupBy("fsdo")
            .agg(F.count_distinct("certificate_designator").alias("ops"),
                 F.coalesce(F.sum("tails"), F.lit(0)).cast("bigint").alias("aircraft")))


def table_counts(relations: dict[str, DataFrame]) -> DataFrame:
    """Row count of each relation, one row per name."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("relation"), "rows")
              for name, df in relations.items()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total


def share_of_max(counts: DataFrame, n: str = "n") -> DataFrame:
    """Each count as a percentage of the largest, which is taken as at least one.

    The input is an aggregate of few rows, so the window over all of it is small; it is planned once.
    """
    top = F.greatest(F.max(n).over(Window.partitionBy(F.lit(0))), F.lit(1)).cast("double")
    return counts.withColumn("share", F.round(F.col(n) * 100.0 / top, 1))


def spine_totals(t: Tables) -> DataFrame:
    """Certificate tails by category, by operator name and in all, from one pass over the spine.

    Rows (section, name, n, ready): section ``all``, ``category`` or ``operator``; ``ready`` counts tails of known operators with a
    transponder code. Certificate tails are counted per operator, category and readiness before the three sums are formed.
    """
    reference = t.aircraft_ref.select(F.col("code").alias("mfr_mdl_code"), "category")
    registry = t.faa_registry.select("n_number", "mfr_mdl_code", "mode_s_hex").join(reference, "mfr_mdl_code", "left").select(
        "n_number", F.col("category"), nonblank(F.col("mode_s_hex")).alias("_coded"))
    holders = t.operators.select("certificate_designator", "operator_name", F.lit(True).alias("_held"))
    tails = (t.part135_aircraft.select("n_number", "certificate_designator").join(holders, "certificate_designator", "left")
             .join(registry, "n_number", "left"))
    ready = F.coalesce(F.col("_coded") & F.col("_held"), F.lit(False))
    groups = tails.groupBy(F.coalesce("_held", F.lit(False)).alias("_held"), "operator_name",
                           F.coalesce("category", F.lit("Unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(ready).alias("_ready"))
    sums = groups.groupingSets([[], [F.col("category")], [F.col("_held"), F.col("operator_name")]], "category", "_held", "operator_name").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_ready"), F.lit(0)).alias("ready"),
        F.grouping("category").alias("_not_category"), F.grouping("operator_name").alias("_not_operator"))
    section = F.when(F.col("_not_category") == 0, F.lit("category")).when(F.col("_not_operator") == 0, F.lit("operator")).otherwise(F.lit("all"))
    sums = sums.where((F.col("_not_operator") == 1) | F.col("_held"))
    return sums.select(section.alias("section"), F.coalesce("category", "operator_name").alias("name"), "n", "ready")


def ranked_list(short: DataFrame, order: list[Column]) -> DataFrame:
    """Position 1..n on a list that is already cut to a page."""
    return short.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
