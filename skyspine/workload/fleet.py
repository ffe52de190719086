"""Spine joins, fleet roll-ups and the fleet products."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspine.operators import filters, ordering, spine
from skyspine.operators.ordering import down, up
from skyspine.plans import fleet as plans
from skyspine.workload.registry import query

#: A registered tail with the facts of its model; every twin below starts from it.
KNOWN_SQL = """(SELECT v_registry.* EXCLUDE (registrant_name), registrant_name AS registered_owner, m.* EXCLUDE (mfr_mdl_code)
  FROM v_registry LEFT JOIN (SELECT code AS mfr_mdl_code, * EXCLUDE (code) FROM v_ref) m USING (mfr_mdl_code))"""

#: Tails of known operators with what is known of them, unknown tails included.
SPINE_SQL = f"""(WITH held AS (SELECT * FROM v_link SEMI JOIN v_operators USING (certificate_designator))
  SELECT n_number, make_model_series, certificate_designator, operator_name, fsdo,
    k.* EXCLUDE (n_number, serial_number, mfr_mdl_code, city, state, mode_s_code_octal, num_engines)
  FROM held NATURAL JOIN (SELECT certificate_designator, operator_name, fsdo FROM v_operators) LEFT JOIN {KNOWN_SQL} k USING (n_number))"""

#: Counts per certificate, then put to the operators.
AGG_SQL = f"""(WITH counts AS (SELECT certificate_designator, count(n_number) AS fleet_size, histogram(category) AS kinds
    FROM v_link LEFT JOIN (SELECT n_number, category FROM {KNOWN_SQL}) USING (n_number) GROUP BY certificate_designator)
  SELECT certificate_designator, operator_name, fsdo, coalesce(fleet_size, 0) AS fleet_size,
    coalesce(kinds['Jet'], 0)::BIGINT AS jets, coalesce(kinds['Turboprop'], 0)::BIGINT AS turboprops,
    coalesce(kinds['Helicopter'], 0)::BIGINT AS helicopters
  FROM v_operators LEFT JOIN counts USING (certificate_designator))"""


@query("fleet_search", f"""FROM {SPINE_SQL} WHERE category = 'Jet' AND mode_s_hex > ''
  AND len(list_filter([n_number, operator_name, make_model_series, manufacturer], lambda x: contains(lower(x), '#1'))) > 0
ORDER BY operator_name NULLS LAST, n_number NULLS LAST, certificate_designator NULLS LAST LIMIT 800""")
def _(t, spark):
    return plans.fleet_search(t, q="#1", category="Jet", adsb_ready=True, limit=800)


@query("fleet_search_page", f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (ORDER BY operator_name NULLS LAST, n_number NULLS LAST,
  certificate_designator NULLS LAST) AS place FROM {SPINE_SQL}) WHERE place BETWEEN 201 AND 300""")
def _(t, spark):
    return plans.fleet_search(t, limit=100, offset=200)


@query("charter_fleet", f"""SELECT n_number, operator_name, certificate_designator, fsdo,
  CASE WHEN make_model_series <> '' THEN make_model_series END AS make_model_series, mode_s_hex, registered_owner, registrant_type,
  year_mfr, status_code FROM {SPINE_SQL}""")
def _(t, spark):
    return spine.charter_fleet(t)


@query("fleet_enriched", f"FROM {SPINE_SQL}")
def _(t, spark):
    return spine.fleet_enriched(t)


@query("operators_left_fleet", f"""SELECT certificate_designator, operator_name, fsdo, n_number, category FROM {SPINE_SQL}
UNION ALL SELECT certificate_designator, operator_name, fsdo, NULL, NULL FROM v_operators ANTI JOIN v_link USING (certificate_designator)""")
def _(t, spark):
    return spine.operators_left_fleet(t)


BACKLOG_SQL = f"""SELECT n_number, (SELECT k.category = 'Jet' FROM {KNOWN_SQL} k WHERE k.n_number = u.n_number) AS is_jet
FROM (SELECT n_number FROM v_link EXCEPT SELECT n_number FROM v_photos) u"""


@query("photo_backlog", BACKLOG_SQL)
def _(t, spark):
    return spine.photo_backlog(t)


@query("photo_backlog_page", BACKLOG_SQL + " ORDER BY is_jet DESC NULLS LAST, n_number NULLS LAST LIMIT 250")
def _(t, spark):
    return spine.photo_backlog(t, limit=250)


PROFILE_SQL = """SELECT coalesce(r.n_number, h.n_number) AS n_number, h.certificate_designator, h.operator_name, h.fsdo,
  h.certificate_serial, h.make_model_series, coalesce(r.registered, false) AS registered, r.serial_number,
  r.mfr_mdl_code, r.year_mfr, r.registrant_type, r.registrant_name, r.city, r.state, r.status_code,
  r.mode_s_code_octal, r.mode_s_hex, ar.manufacturer, ar.model, ar.aircraft_type, ar.engine_type, ar.category,
  ar.num_engines, ar.num_seats, ph.local_path, ph.page_link, ph.photographer
FROM (SELECT p.n_number, p.certificate_designator, p.serial_number AS certificate_serial, p.make_model_series,
    o.operator_name, o.fsdo FROM v_link p JOIN v_operators o USING (certificate_designator)) h
  FULL OUTER JOIN (SELECT *, true AS registered FROM v_registry) r ON r.n_number = h.n_number
  LEFT JOIN v_ref ar ON ar.code = r.mfr_mdl_code
  LEFT JOIN (SELECT * FROM v_photos WHERE has_photo) ph ON ph.n_number = coalesce(r.n_number, h.n_number)"""


@query("aircraft_profile", PROFILE_SQL)
def _(t, spark):
    return spine.aircraft_profile(t)


WORDS = r"list_transform(regexp_extract_all(lower({c}), '\w+|\W'), lambda w: CASE WHEN w IN ('llc','inc','llp','lllp'," \
        r"'lp','pc','pa','usa','us','ii','iii','iv') THEN upper(w) WHEN regexp_matches(w, '^[a-z]') THEN " \
        r"upper(substr(w,1,1)) || substr(w,2) ELSE w END)"


def titled(column: str) -> str:
    return f"array_to_string({WORDS.format(c=column)}, '')"


OWNER_TYPE_SQL = """CASE registrant_type WHEN '1' THEN 'Individual' WHEN '2' THEN 'Partnership' WHEN '3' THEN 'Corporation'
  WHEN '4' THEN 'Co-owned' WHEN '5' THEN 'Government' WHEN '7' THEN 'LLC' WHEN '8' THEN 'Non-citizen corp'
  WHEN '9' THEN 'Non-citizen co-owned' ELSE CASE WHEN registrant_type <> '' THEN 'Type ' || registrant_type
  ELSE '—' END END"""
STATUS_SQL = """CASE WHEN coalesce(status_code, '') = '' THEN '—' WHEN status_code = 'V' THEN 'Valid'
  WHEN status_code = 'T' THEN 'Valid (trustee)' WHEN status_code = 'R' THEN 'Registration pending'
  WHEN status_code = 'M' THEN 'Valid / pending' WHEN status_code = 'N' THEN 'Non-citizen review'
  WHEN status_code IN ('A', 'S') THEN 'Triennial mailed' WHEN status_code = 'E' THEN 'Revoked'
  WHEN status_code = 'W' THEN 'Deregistered' WHEN status_code = 'D' THEN 'Expired dealer'
  WHEN status_code = 'X' THEN 'Enforcement letter' WHEN status_code = 'Z' THEN 'Reserved'
  WHEN regexp_matches(status_code, '^[0-9]+$') THEN 'In process' ELSE status_code END"""
TIER_SQL = """CASE WHEN status_code IN ('V', 'T') THEN 'good' WHEN status_code IN ('R', 'M', 'N', 'A', 'S') THEN 'warn'
  WHEN status_code IN ('E', 'W', 'D', 'X') THEN 'bad' WHEN status_code = 'Z' THEN 'neutral'
  WHEN regexp_matches(coalesce(status_code, ''), '^[0-9]+$') THEN 'warn' ELSE 'neutral' END"""


@query("aircraft_detail", f"""WITH prof AS ({PROFILE_SQL})
SELECT n_number, registered, certificate_designator, operator_name, fsdo, {titled('manufacturer')} AS manufacturer,
  model, category, aircraft_type, engine_type, year_mfr,
  NULLIF(TRY_CAST(regexp_extract(num_seats, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS seats, mode_s_hex,
  {titled('registrant_name')} AS registered_owner, {OWNER_TYPE_SQL} AS owner_type,
  {STATUS_SQL} AS status, {TIER_SQL} AS status_tier,
  concat_ws(', ', NULLIF({titled('city')}, ''), NULLIF(state, '')) AS owner_location, local_path
FROM prof""")
def _(t, spark):
    return plans.aircraft_detail(t)


@query("aircraft_detail_one", f"""WITH prof AS ({PROFILE_SQL})
SELECT n_number, certificate_designator, operator_name, {titled('registrant_name')} AS registered_owner
FROM prof WHERE n_number = 'N77'""")
def _(t, spark):
    return plans.aircraft_detail(t, "n77").select("n_number", "certificate_designator", "operator_name",
                                                  "registered_owner")


#: Tails per model code, then per category.
COUNT_SQL = """SELECT coalesce(category, 'Unknown') AS category, sum(tails)::BIGINT AS n
FROM (SELECT mfr_mdl_code AS code, count(*) AS tails FROM v_link LEFT JOIN v_registry USING (n_number) GROUP BY mfr_mdl_code)
  LEFT JOIN v_ref USING (code) GROUP BY ALL"""


@query("count_by_category", COUNT_SQL)
def _(t, spark):
    return spine.count_by_category(t)


TOP_SQL = """SELECT operator_name, sum(tails)::BIGINT AS n FROM v_operators
  JOIN (SELECT certificate_designator, count(*) AS tails FROM v_link GROUP BY ALL) USING (certificate_designator)
GROUP BY operator_name ORDER BY n DESC, operator_name NULLS LAST LIMIT 10"""


@query("top_operators", TOP_SQL)
def _(t, spark):
    return spine.top_operators(t)


@query("operator_fleet_agg", f"FROM {AGG_SQL}")
def _(t, spark):
    return spine.operator_fleet_agg(t)


@query("fsdo_totals", f"""SELECT fsdo, count(*) AS ops, sum(fleet_size)::BIGINT AS aircraft FROM {AGG_SQL} GROUP BY fsdo""")
def _(t, spark):
    return spine.fsdo_totals(t)


@query("operator_list", f"""FROM {AGG_SQL} WHERE contains(operator_name, '00')
ORDER BY fleet_size DESC, certificate_designator NULLS LAST LIMIT 100""")
def _(t, spark):
    return plans.operator_list(t, q="00", limit=100)


@query("operator_detail", f"""SELECT * FROM (FROM {AGG_SQL} WHERE certificate_designator = '7')
  LEFT JOIN (SELECT * EXCLUDE (operator_name, fsdo) FROM {SPINE_SQL}) USING (certificate_designator)""")
def _(t, spark):
    return plans.operator_detail(t, "7")


@query("fsdo_detail", f"""SELECT *, count(*) OVER () AS district_ops, sum(fleet_size) OVER ()::BIGINT AS district_aircraft
FROM {AGG_SQL} WHERE fsdo = 'NATION_3'""")
def _(t, spark):
    return plans.fsdo_detail(t, "NATION_3")


@query("distinct_rows", f"""SELECT n_number, any_value(category = 'Jet') AS is_jet
FROM v_link LEFT JOIN {KNOWN_SQL} k USING (n_number) GROUP BY n_number""")
def _(t, spark):
    tails = spine.distinct_rows(t.part135_aircraft, "n_number").join(spine.tail_category(t), "n_number", "left")
    return tails.select("n_number", (F.col("category") == "Jet").alias("is_jet"))


@query("share_of_max", f"""SELECT category, n, round(n * 100.0::DOUBLE / greatest(max(n) OVER (), 1), 1) AS share
FROM ({COUNT_SQL})""")
def _(t, spark):
    return spine.share_of_max(spine.count_by_category(t))


@query("ranked_list", f"SELECT row_number() OVER (ORDER BY n DESC, operator_name) AS position, * FROM ({TOP_SQL})")
def _(t, spark):
    return spine.ranked_list(spine.top_operators(t), [down("n"), up("operator_name")])


@query("search_any", f"""FROM {SPINE_SQL}
WHERE contains(concat_ws(chr(10), n_number, operator_name, make_model_series, manufacturer), '99')""")
def _(t, spark):
    return filters.search_any(spine.fleet_enriched(t), "99", "n_number", "operator_name", "make_model_series",
                              "manufacturer")


@query("search_one", "SELECT certificate_designator, operator_name FROM v_operators WHERE operator_name ILIKE '%ER#_0%1%'")
def _(t, spark):
    return filters.search_one(t.operators, "ER#_0%1", "operator_name").select("certificate_designator",
                                                                            "operator_name")


@query("optional_filters", f"FROM {SPINE_SQL} WHERE operator_name = 'Supplier#000000005'")
def _(t, spark):
    return plans.fleet_filter(t, operator="Supplier#000000005")


@query("optional_filters_adsb", f"FROM {SPINE_SQL} WHERE category = 'Piston' AND mode_s_hex > ''")
def _(t, spark):
    return plans.fleet_filter(t, category="Piston", adsb_ready=True)


@query("nonblank", f"SELECT n_number, certificate_designator, mode_s_hex FROM {SPINE_SQL} WHERE mode_s_hex > ''")
def _(t, spark):
    return spine.adsb_ready(spine.charter_fleet(t)).select("n_number", "certificate_designator", "mode_s_hex")


@query("point_lookup", "SELECT * FROM v_registry WHERE n_number = 'N116'")
def _(t, spark):
    return filters.point_lookup(t.faa_registry, n_number="N116")


@query("flag_filter", "SELECT n_number, local_path, page_link, photographer FROM v_photos WHERE has_photo")
def _(t, spark):
    return filters.flag_filter(t.aircraft_photos, "has_photo").select("n_number", "local_path", "page_link",
                                                                     "photographer")


@query("page", """SELECT n_number, registrant_name FROM v_registry
ORDER BY registrant_name NULLS LAST, n_number NULLS LAST LIMIT 900 OFFSET 100""")
def _(t, spark):
    return ordering.page(t.faa_registry.select("n_number", "registrant_name"),
                         [up("registrant_name"), up("n_number")], 900, offset=100)


@query("page_deep", """SELECT n_number, registrant_name FROM v_registry
ORDER BY registrant_name DESC NULLS LAST, n_number NULLS LAST LIMIT 70 OFFSET 410""")
def _(t, spark):
    """A page found by counting ranges, as ``page`` does from a far offset on."""
    return ordering.deep_page(t.faa_registry.select("n_number", "registrant_name"),
                              [ordering.down_nulls_last("registrant_name"), up("n_number")], 70, 410)


@query("page_after", """SELECT n_number, registrant_name FROM v_registry WHERE registrant_name > 'OWNER 2' OR registrant_name IS NULL
ORDER BY registrant_name NULLS LAST, n_number NULLS LAST LIMIT 300""")
def _(t, spark):
    keys = [ordering.Key("registrant_name"), ordering.Key("n_number")]
    return ordering.page_after(t.faa_registry.select("n_number", "registrant_name"), keys, 300, ("OWNER 2", "ZZZZ"))


@query("order_by_flag", f"""SELECT n_number, any_value(category = 'Jet') AS is_jet FROM v_link LEFT JOIN {KNOWN_SQL} k USING (n_number)
GROUP BY n_number ORDER BY is_jet DESC NULLS LAST, n_number NULLS LAST LIMIT 300""")
def _(t, spark):
    tails = t.part135_aircraft.select("n_number").distinct().join(spine.tail_category(t), "n_number", "left")
    rows = tails.select("n_number", (F.col("category") == "Jet").alias("is_jet"))
    return ordering.order_by_flag(rows, F.col("is_jet"), "n_number").limit(300)


@query("sort_by_any", """SELECT code, num_seats FROM v_ref
ORDER BY coalesce(TRY_CAST(num_seats AS DOUBLE), 0) DESC, code NULLS LAST LIMIT 200""")
def _(t, spark):
    return ordering.sort_by_any(t.aircraft_ref.select("code", "num_seats"), "num_seats", "num", True, "code").limit(200)


@query("table_counts", """SELECT 'operators' AS relation, count(*) AS rows FROM v_operators
UNION ALL SELECT 'aircraft', count(*) FROM v_link UNION ALL SELECT 'registry', count(*) FROM v_registry
UNION ALL SELECT 'reference', count(*) FROM v_ref UNION ALL SELECT 'emails', count(*) FROM v_emails
UNION ALL SELECT 'adsb_ready', count(*) FROM v_link p JOIN v_operators o USING (certificate_designator)
  JOIN v_registry r ON r.n_number = p.n_number WHERE r.mode_s_hex <> ''
UNION ALL SELECT 'charter_segments', count(*) FROM v_t100 WHERE class IN ('L', 'P')
UNION ALL SELECT 'airports', count(*) FROM v_airports""")
def _(t, spark):
    return plans.platform_counts(t)
