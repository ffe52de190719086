"""Fleet, operator, district and platform products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.functions.clean import nonblank
from skyspine.functions.decode import joined_label, owner_type, parse_seats, status_label, status_tier, title_case
from skyspine.functions.text import contains
from skyspine.operators import spine
from skyspine.operators.filters import optional_filters
from skyspine.operators.keys import parents_with_children
from skyspine.operators.ordering import down, page, up
from skyspine.operators.traffic import charter_routes
from skyspine.tables import Tables


def fleet_filter(t: Tables, q: str | None = None, category: str | None = None, operator: str | None = None,
                 adsb_ready: bool = False) -> DataFrame:
    """The decoded spine under those filters that were given."""
    words = q or ""
    hit = (contains(F.col("n_number"), words) | contains(F.col("operator_name"), words)
           | contains(F.col("make_model_series"), words) | contains(F.col("manufacturer"), words))
    return optional_filters(
        spine.fleet_enriched(t), (q, hit), (category, F.col("category") == F.lit(category)),
        (operator, F.col("operator_name") == F.lit(operator)), (adsb_ready, nonblank(F.col("mode_s_hex"))))


def fleet_search(t: Tables, q: str | None = None, category: str | None = None, operator: str | None = None,
                 adsb_ready: bool = False, limit: int = 100, offset: int = 0, cap: int | None = None) -> DataFrame:
    """One page of the fleet, by operator and tail; ``cap`` is for a caller that holds requests to a size."""
    return page(fleet_filter(t, q, category, operator, adsb_ready),
                [up("operator_name"), up("n_number"), up("certificate_designator")], limit, cap, offset)


def aircraft_detail(t: Tables, n_number: str | None = None) -> DataFrame:
    """Profiles ready for display, of all tails or of one; one row per tail and certificate.

    Names are put in title case once per registration and model, not once per certificate.
    """
    def chosen(rows: DataFrame) -> DataFrame:
        return rows if n_number is None else rows.where(F.col("n_number") == F.lit(n_number.upper()))

    registry = chosen(t.faa_registry).withColumns({c: title_case(F.col(c)) for c in ("registrant_name", "city")})
    rows = spine.aircraft_profile(Tables.of(
        operators=t.operators, part135_aircraft=chosen(t.part135_aircraft), faa_registry=registry,
        aircraft_ref=t.aircraft_ref.withColumn("manufacturer", title_case(F.col("manufacturer"))),
        aircraft_photos=chosen(t.aircraft_photos)))
    return rows.select(
        "n_number", "registered", "certificate_designator", "operator_name", "fsdo", "manufacturer", "model", "category",
        "aircraft_type", "engine_type", "year_mfr", parse_seats(F.col("num_seats")).alias("seats"), "mode_s_hex",
        F.col("registrant_name").alias("registered_owner"), owner_type(F.col("registrant_type")).alias("owner_type"),
        status_label(F.col("status_code")).alias("status"), status_tier(F.col("status_code")).alias("status_tier"),
        joined_label(F.col("city"), F.col("state")).alias("owner_location"), "local_path")


def operator_list(t: Tables, q: str | None = None, limit: int = 100) -> DataFrame:
    """Operators by fleet size."""
    chosen = t.operators.where(contains(F.col("operator_name"), q)) if q else None
    return page(spine.operator_fleet_agg(t, chosen), [down("fleet_size"), up("certificate_designator")], limit)


def operator_detail(t: Tables, designator: str) -> DataFrame:
    """One operator's totals beside each of its tails, tails by category; no tails gives one row."""
    chosen = t.operators.where(F.col("certificate_designator") == F.lit(designator))
    totals = spine.operator_fleet_agg(t, chosen)
    fleet = spine.fleet_enriched(t).where(F.col("certificate_designator") == F.lit(designator)).drop(
        "operator_name", "fsdo")
    return parents_with_children(totals, fleet, ["certificate_designator"]).orderBy(up("category"), up("n_number"))


def fsdo_detail(t: Tables, fsdo: str) -> DataFrame:
    """A district's operators by fleet size, beside the district's totals."""
    operators = spine.operator_fleet_agg(t, t.operators.where(F.col("fsdo") == F.lit(fsdo)))
    totals = operators.groupBy("fsdo").agg(F.count(F.lit(1)).alias("district_ops"), F.sum("fleet_size").alias("district_aircraft"))
    return operators.join(totals, "fsdo").orderBy(down("fleet_size"), up("certificate_designator"))


def platform_counts(t: Tables) -> DataFrame:
    """Row counts of the main relations."""
    return spine.table_counts({
        "operators": t.operators, "aircraft": t.part135_aircraft, "registry": t.faa_registry,
        "reference": t.aircraft_ref, "emails": t.emails, "adsb_ready": spine.adsb_ready(spine.charter_fleet(t)),
        "charter_segments": charter_routes(t), "airports": t.airports})
