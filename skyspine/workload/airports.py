"""Airport queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspine.functions import clean as C
from skyspine.functions import decode as D
from skyspine.operators import airports as A
from skyspine.operators import filters, ordering
from skyspine.plans import airports as plans
from skyspine.workload.fleet import titled
from skyspine.workload.registry import query
from skyspine.workload.routes import BY_CODE

#: Open runways per airport, put to the airports.
CAP = """SELECT ident, name, type, iso_country, iso_region, municipality, iata_code, icao_code, local_code, latitude_deg, longitude_deg,
  elevation_ft, lengths[1] AS longest_runway_ft, coalesce(n, 0) AS runway_count
FROM v_airports LEFT JOIN (SELECT airport_ident AS ident, list_reverse_sort(list(length_ft), 'NULLS LAST') AS lengths, count(id) AS n
  FROM v_runways WHERE closed = false GROUP BY airport_ident) USING (ident)"""


@query("airport_capability", CAP)
def _(t, spark):
    return A.airport_capability(t)


@query("airport_search", f"""SELECT * FROM ({CAP}) WHERE (name ILIKE '%1%' OR municipality ILIKE '%1%'
  OR iata_code ILIKE '%1%' OR ident ILIKE '%1%') AND type NOT IN ('seaplane_base', 'heliport', 'balloonport', 'closed')
  AND longest_runway_ft >= 4000 ORDER BY longest_runway_ft DESC NULLS LAST, ident NULLS LAST LIMIT 900""")
def _(t, spark):
    return plans.airport_search(t, q="1", min_runway=4000, limit=900)


@query("optional_filters_airports", f"SELECT * FROM ({CAP}) WHERE iso_country = 'NATION_5' AND type = 'heliport'")
def _(t, spark):
    return plans.airport_filter(t, country="nation_5", type="heliport")


@query("exclude_types", """SELECT ident, type FROM v_airports
WHERE type NOT IN ('seaplane_base', 'heliport', 'balloonport', 'closed')""")
def _(t, spark):
    return filters.exclude_types(t.airports).select("ident", "type")


@query("min_threshold", f"SELECT ident, longest_runway_ft FROM ({CAP}) WHERE longest_runway_ft >= 12000")
def _(t, spark):
    rows = filters.min_threshold(A.airport_capability(t), "runway_count", 0)
    return filters.min_threshold(rows, "longest_runway_ft", 12000).select("ident", "longest_runway_ft")


@query("jet_capable", f"SELECT count(*) AS jet_capable FROM ({CAP}) WHERE longest_runway_ft >= 4000")
def _(t, spark):
    return A.jet_capable(t)


@query("either_code", "SELECT ident, name, type FROM v_airports WHERE iata_code = 'I12' OR local_code = 'I12'")
def _(t, spark):
    return filters.either_code(t.airports, "I12").select("ident", "name", "type")


@query("best_airport", f"""SELECT c.code, b.ident, b.name FROM (SELECT DISTINCT concat('I', CAST(o_orderkey % 80 AS STRING))
  AS code FROM orders) c LEFT JOIN ({BY_CODE}) b ON b.code = c.code""")
def _(t, spark):
    codes = t.orders.select(F.concat(F.lit("I"), (F.col("o_orderkey") % 80).cast("string")).alias("code")).distinct()
    return A.best_airport(codes, t)


@query("airport_contacts", """SELECT a.ident, a.name, NULLIF(a.local_code, '') AS local_code, d.owner_name, d.owner_phone,
  d.manager_name, d.manager_phone
FROM v_airports a LEFT JOIN v_detail d ON d.location_id = NULLIF(a.local_code, '')""")
def _(t, spark):
    return A.airport_contacts(t)


PROFILE = f"""SELECT a.*, coalesce(c.runway_count, 0) AS runway_count, c.longest_runway_ft, d.owner_name, d.owner_phone,
  d.manager_name, d.manager_phone, r.id AS runway_id, r.le_ident, r.he_ident, r.length_ft, r.width_ft, r.surface,
  r.lighted, r.closed
FROM v_airports a LEFT JOIN (SELECT ident, longest_runway_ft, runway_count FROM ({CAP})) c USING (ident)
  LEFT JOIN v_detail d ON d.location_id = NULLIF(a.local_code, '')
  LEFT JOIN v_runways r ON r.airport_ident = a.ident"""


@query("airport_profile", PROFILE)
def _(t, spark):
    return A.airport_profile(t)


SIZE = r"""array_to_string(list_transform(regexp_extract_all(replace(regexp_replace(coalesce(type, ''), '_airport', ''),
  '_', ' '), '\w+|\W'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')"""
OTHER = """array_to_string(list_filter([ident, NULLIF(local_code, ''), NULLIF(gps_code, '')],
  lambda x: x IS NOT NULL AND x <> coalesce(iata_code, '') AND x <> coalesce(icao_code, '')), ' ')"""


@query("airport_detail", f"""WITH p AS ({PROFILE}) SELECT ident, name, {SIZE} AS size,
  CASE WHEN coalesce(longest_runway_ft, 0) = 0 THEN '—' ELSE format('{{:,}}', longest_runway_ft) || ' ft' END AS longest_runway,
  runway_count, {titled('municipality')} AS city, iso_region, iso_country,
  CASE WHEN latitude_deg IS NULL OR longitude_deg IS NULL THEN '—'
    ELSE printf('%.4f, %.4f', latitude_deg, longitude_deg) END AS coordinates,
  format('{{:,}}', elevation_ft) || ' ft' AS elevation, CASE WHEN scheduled_service THEN 'Yes' ELSE 'No' END AS scheduled,
  {OTHER} AS other_codes, {titled('owner_name')} AS owner, owner_phone, {titled('manager_name')} AS manager,
  manager_phone, runway_id, CASE WHEN runway_id IS NOT NULL THEN coalesce(le_ident, '') || '/' || coalesce(he_ident, '') END
  AS runway, length_ft, width_ft, surface, lighted, closed FROM p""")
def _(t, spark):
    return plans.airport_detail(t)


@query("jet_base_totals", """SELECT count(*) AS airports, CAST(coalesce(sum(based_jet), 0) AS BIGINT) AS jets
FROM v_detail WHERE based_jet > 0""")
def _(t, spark):
    return A.jet_base_totals(t.faa_airport_detail)


@query("positive_only", "SELECT location_id, based_jet FROM v_detail WHERE based_jet > 0")
def _(t, spark):
    return filters.positive_only(t.faa_airport_detail, "based_jet").select("location_id", "based_jet")


@query("row_total", """SELECT location_id, based_single + based_multi + based_jet + based_heli + based_glider +
  based_military + based_ultralight AS based_total FROM v_detail""")
def _(t, spark):
    total = C.row_total([F.col(c) for c in ("based_single", "based_multi", "based_jet", "based_heli", "based_glider",
                                            "based_military", "based_ultralight")])
    return t.faa_airport_detail.select("location_id", total.alias("based_total"))


@query("top_k_nulls_last", """SELECT id, airport_ident, length_ft FROM v_runways
ORDER BY length_ft DESC NULLS LAST, id NULLS LAST LIMIT 500""")
def _(t, spark):
    return ordering.top_k_nulls_last(t.runways.select("id", "airport_ident", "length_ft"), "length_ft", 500, "id")


@query("clean_type", f"SELECT ident, {SIZE} AS size FROM v_airports")
def _(t, spark):
    return t.airports.select("ident", D.clean_type(F.col("type")).alias("size"))


@query("title_case", f"""SELECT certificate_designator, {titled('operator_name')} AS operator_name,
  {titled("concat('o''hare ', fsdo, ' us-holdings iii inc')")} AS label FROM v_operators""")
def _(t, spark):
    label = F.concat(F.lit("o'hare "), "fsdo", F.lit(" us-holdings iii inc"))
    return t.operators.select("certificate_designator", D.title_case(F.col("operator_name")).alias("operator_name"),
                              D.title_case(label).alias("label"))


@query("title_case_text", f"SELECT doc_id, {titled('text')} AS titled FROM documents")
def _(t, spark):
    return t.documents.select("doc_id", D.title_case(F.col("text")).alias("titled"))


@query("distinct_codes", f"SELECT ident, {OTHER} AS other_codes FROM v_airports")
def _(t, spark):
    codes = D.distinct_codes([F.col("ident"), F.col("local_code"), F.col("gps_code")],
                             [F.col("iata_code"), F.col("icao_code")])
    return t.airports.select("ident", F.array_join(codes, " ").alias("other_codes"))


@query("pair_label", """SELECT id, coalesce(le_ident, '') || '/' || coalesce(he_ident, '') AS ends,
  concat_ws(', ', NULLIF(surface, ''), le_ident) AS described FROM v_runways""")
def _(t, spark):
    return t.runways.select("id", D.pair_label(F.col("le_ident"), F.col("he_ident")).alias("ends"),
                            D.joined_label(F.col("surface"), F.col("le_ident")).alias("described"))


@query("coord_text", """SELECT ident, CASE WHEN latitude_deg IS NULL OR longitude_deg IS NULL THEN '—'
  ELSE printf('%.4f, %.4f', latitude_deg, longitude_deg) END AS coordinates FROM v_airports""")
def _(t, spark):
    return t.airports.select("ident", D.coord_text(F.col("latitude_deg"), F.col("longitude_deg")).alias("coordinates"))


@query("format_count", """SELECT id, coalesce(format('{:,}', length_ft), '—') AS length FROM v_runways""")
def _(t, spark):
    return t.runways.select("id", D.format_count(F.col("length_ft")).alias("length"))
