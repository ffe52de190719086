"""The domain tables, derived from the generic test tables.

Each text is one SELECT that both Spark and the SQL check run. Every stand-in covers the whole of its
source table: rows that must find no partner get a key of another form instead of being filtered out.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspine.functions.text import epoch_ms_ts
from skyspine.tables import Tables

RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "pages", "embeddings", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["v_operators"] = """
SELECT CAST(s_suppkey AS STRING) AS certificate_designator,
  CASE WHEN s_suppkey % 10 = 9 THEN concat('Supplier#', lpad(CAST(s_suppkey - 1 AS STRING), 9, '0'))
       ELSE s_name END AS operator_name,
  '135' AS part, n_name AS fsdo
FROM {supplier} LEFT JOIN {nation} ON s_nationkey = n_nationkey"""

VIEWS["v_link"] = """
SELECT DISTINCT concat('N', CAST(l_orderkey AS STRING)) AS n_number,
  CAST(l_suppkey AS STRING) AS certificate_designator, concat('S-', CAST(l_orderkey AS STRING)) AS serial_number,
  CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE concat('MODEL-', CAST(l_orderkey % 40 AS STRING)) END
    AS make_model_series
FROM {lineitem}"""

VIEWS["v_registry"] = """
SELECT concat(CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE 'N' END, CAST(o_orderkey AS STRING)) AS n_number,
  concat('S-', CAST(o_orderkey AS STRING)) AS serial_number, CAST(o_custkey AS STRING) AS mfr_mdl_code,
  CAST(year(o_orderdate) AS STRING) AS year_mfr, split_part(o_orderpriority, '-', 1) AS registrant_type,
  concat('OWNER ', CAST(o_custkey AS STRING), ' HOLDINGS LLC') AS registrant_name,
  concat('PORT-OF ', split_part(o_orderpriority, '-', 2)) AS city, o_orderstatus AS state,
  CASE o_orderkey % 7 WHEN 0 THEN 'V' WHEN 1 THEN 'T' WHEN 2 THEN '12' WHEN 3 THEN 'Z' WHEN 4 THEN ''
       ELSE o_orderstatus END AS status_code,
  CAST(50000000 + o_orderkey AS STRING) AS mode_s_code_octal,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE upper(lpad(hex(o_orderkey), 6, '0')) END AS mode_s_hex
FROM {orders}"""

VIEWS["v_ref"] = """
SELECT concat(CASE WHEN p_size > 40 THEN 'X' ELSE '' END, CAST(p_partkey AS STRING)) AS code,
  p_brand AS manufacturer, p_name AS model, p_type AS aircraft_type, concat('ENGINE ', p_brand) AS engine_type,
  CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Jet' WHEN p_type = 'LARGE' THEN 'Turboprop'
       WHEN p_type = 'SMALL' THEN 'Helicopter' ELSE 'Piston' END AS category,
  CAST(1 + p_size % 2 AS STRING) AS num_engines, lpad(CAST(p_size - 1 AS STRING), 3, '0') AS num_seats
FROM {part}"""

VIEWS["v_photos"] = """
SELECT concat(CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'N' ELSE 'X' END,
    CAST(o_orderkey AS STRING)) AS n_number,
  o_orderpriority <> '4-NOT SPECIFIED' AS has_photo, CAST(o_orderkey AS STRING) AS photo_id,
  concat('https://img.example.org/', CAST(o_orderkey AS STRING)) AS thumbnail_url,
  concat('https://photo.example.org/', CAST(o_orderkey AS STRING)) AS page_link,
  concat('Photographer ', CAST(o_custkey AS STRING)) AS photographer,
  concat('/photos/N', CAST(o_orderkey AS STRING), '.jpg') AS local_path, o_orderdate AS fetched_at
FROM {orders}"""

VIEWS["v_airports"] = """
SELECT concat('A', lpad(CAST(c_custkey AS STRING), 6, '0')) AS ident,
  CASE c_custkey % 6 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport' WHEN 2 THEN 'small_airport'
       WHEN 3 THEN 'heliport' WHEN 4 THEN 'seaplane_base' END AS type,
  c_name AS name,
  CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 1800 AS DOUBLE) / 10 - 90 END AS latitude_deg,
  CAST((c_custkey * 91) % 3600 AS DOUBLE) / 10 - 180 AS longitude_deg,
  CASE WHEN c_custkey % 8 <> 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS elevation_ft,
  'NA' AS continent, n_name AS iso_country, concat(n_name, '-', CAST(c_custkey % 9 AS STRING)) AS iso_region,
  c_mktsegment AS municipality, c_custkey % 4 = 0 AS scheduled_service,
  CASE WHEN c_custkey % 7 <> 0 THEN concat('K', CAST(c_custkey AS STRING)) ELSE '' END AS icao_code,
  CASE WHEN c_custkey % 3 = 0 THEN concat('I', CAST(c_custkey % 60 AS STRING)) END AS iata_code,
  CASE WHEN c_custkey % 5 <> 0 THEN concat('K', CAST(c_custkey - c_custkey % 2 AS STRING)) END AS gps_code,
  CASE WHEN c_custkey % 2 = 0 THEN concat('I', CAST(c_custkey % 50 AS STRING)) WHEN c_custkey % 5 = 0 THEN '' END
    AS local_code,
  concat('https://airport.example.org/', CAST(c_custkey AS STRING)) AS home_link,
  CAST(NULL AS STRING) AS wikipedia_link
FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey"""

VIEWS["v_runways"] = """
SELECT o_orderkey AS id, concat('A', lpad(CAST(o_custkey AS STRING), 6, '0')) AS airport_ident,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 14000 END AS length_ft,
  CASE WHEN o_orderkey % 19 <> 0 THEN 50 + o_orderkey % 100 END AS width_ft,
  split_part(o_orderpriority, '-', 2) AS surface, o_orderkey % 3 = 0 AS lighted,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS closed,
  CASE WHEN o_orderkey % 11 <> 0 THEN lpad(CAST(o_orderkey % 18 + 1 AS STRING), 2, '0') END AS le_ident,
  CASE WHEN o_orderkey % 13 <> 0 THEN lpad(CAST(o_orderkey % 18 + 19 AS STRING), 2, '0') END AS he_ident
FROM {orders}"""

VIEWS["v_detail"] = """
SELECT concat('I', CAST(c_custkey AS STRING)) AS location_id, concat('SITE', CAST(c_custkey AS STRING)) AS site_number,
  c_name AS facility_name, c_mktsegment AS city, n_name AS state,
  concat('CITY OF ', c_mktsegment) AS owner_name, concat('555-', lpad(CAST(c_custkey AS STRING), 7, '0')) AS owner_phone,
  concat('MANAGER ', CAST(c_custkey AS STRING)) AS manager_name, CAST(NULL AS STRING) AS manager_phone,
  c_custkey % 30 AS based_single, c_custkey % 11 AS based_multi,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 8 ELSE 0 END AS based_jet,
  c_custkey % 4 AS based_heli, c_custkey % 3 AS based_glider, c_custkey % 2 AS based_military,
  c_custkey % 6 AS based_ultralight
FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey"""

VIEWS["v_t100"] = """
SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(month(l_shipdate) AS BIGINT) AS month,
  CAST(l_suppkey AS STRING) AS unique_carrier, concat('AL', CAST(l_suppkey AS STRING)) AS airline_id,
  s_name AS carrier_name, concat('O', CAST(c_nationkey AS STRING)) AS origin,
  concat(cn.n_name, CASE WHEN c_nationkey = 3 AND o_orderkey % 2 = 0 THEN ', X' ELSE ', Y' END) AS origin_city,
  concat('S', CAST(cn.n_regionkey AS STRING)) AS origin_state,
  concat('D', CAST(s_nationkey AS STRING)) AS dest, concat(sn.n_name, ', Y') AS dest_city,
  concat('S', CAST(sn.n_regionkey AS STRING)) AS dest_state,
  CAST(p_size % 7 AS STRING) AS aircraft_group, CAST(p_size AS STRING) AS aircraft_type,
  l_linestatus AS aircraft_config,
  CAST(CASE WHEN l_quantity < 5 THEN 0 ELSE l_quantity END AS DECIMAL(18,2)) AS departures,
  CAST(l_quantity * 8 AS DECIMAL(18,2)) AS seats, CAST(l_quantity * 5 AS DECIMAL(18,2)) AS passengers,
  CAST(l_quantity * 3 AS DECIMAL(18,2)) AS freight, CAST(l_quantity * 2 AS DECIMAL(18,2)) AS mail,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS distance,
  CASE l_returnflag WHEN 'A' THEN 'L' WHEN 'R' THEN 'P' ELSE 'F' END AS class
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
  JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey
  JOIN {nation} cn ON c_nationkey = cn.n_nationkey JOIN {nation} sn ON s_nationkey = sn.n_nationkey"""

VIEWS["v_type_ref"] = """
SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN lpad(CAST(p_size AS STRING), 3, '0')
    ELSE concat('X', CAST(p_size AS STRING)) END AS code,
  concat('Type ', CAST(p_size AS STRING)) AS description
FROM {part}"""

VIEWS["v_emails"] = """
SELECT CAST(doc_id AS STRING) AS id, CAST(doc_id % 50 AS STRING) AS thread_id,
  CASE WHEN source <> 'src0' THEN concat(source, '@example.com') END AS mailbox,
  concat(lang, '@example.org') AS from_addr,
  CASE WHEN doc_id % 4 <> 0 THEN concat('Sender ', lang) ELSE '' END AS from_name,
  'team@example.org' AS to_addrs, split_part(text, chr(10), 1) AS subject,
  concat(source, ' ', lang, ' ', CAST(n_chars AS STRING)) AS snippet, text AS body,
  CASE WHEN doc_id % 10 <> 0 THEN CAST(1704067200000 + doc_id * 60000 AS STRING) END AS internal_ms,
  source, lang
FROM {documents}"""

VIEWS["v_logs"] = """
SELECT event_id AS id, ts, concat('svc', CAST(user_id % 7 AS STRING)) AS service, user_id AS run_id,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN 'DEBUG'
       ELSE 'INFO' END AS level, props AS message
FROM {events}"""

VIEWS["v_run_events"] = """
SELECT event_id - event_id % 2 AS run_id,
  concat('svc', CAST((event_id - event_id % 2) % 7 AS STRING)) AS service, ts,
  CASE WHEN event_id % 2 = 0 THEN 'running' WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  CASE WHEN event_id % 4 = 0 THEN 'manual' ELSE 'schedule' END AS trigger,
  CASE WHEN event_id % 2 = 1 AND event_type = 'error' THEN props END AS error,
  CASE WHEN event_id % 2 = 1 AND event_type <> 'error' THEN props END AS result
FROM {events}"""

VIEWS["v_jobs"] = """
SELECT concat('svc', CAST(n_nationkey AS STRING)) AS name, concat('Job ', n_name) AS display_name,
  concat('Loads ', n_name) AS description,
  CASE WHEN n_regionkey <> 0 THEN 'ingestion' END AS category,
  (n_nationkey + 1) * 900 AS interval_seconds, n_nationkey % 4 <> 0 AS enabled
FROM {nation}"""

VIEWS["v_notes"] = """
SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' ELSE 'info' END AS level,
  concat('svc', CAST(user_id % 7 AS STRING)) AS source, concat('Event ', event_type) AS title, props AS body,
  event_type IN ('view', 'click') AS read
FROM {events}"""

VIEWS["v_base"] = """
SELECT o_orderkey AS id, o_orderpriority AS label, CAST(o_totalprice AS DECIMAL(18,2)) AS measure FROM {orders}"""

VIEWS["v_delta"] = """
SELECT o_orderkey * 2 AS id, 'new' AS label, CAST(o_totalprice + 1 AS DECIMAL(18,2)) AS measure FROM {orders}"""

VIEWS["v_fixed"] = """
SELECT concat(CASE WHEN o_orderkey % 4 = 0 THEN 'RWY' ELSE 'APT' END, rpad(CAST(o_orderkey AS STRING), 11, ' '),
  rpad(o_orderpriority, 20, ' '), lpad(CAST(o_orderkey % 1000 AS STRING), 3, ' '),
  CASE WHEN o_orderkey % 7 = 0 THEN '  x' ELSE '012' END) AS value
FROM {orders}"""

VIEWS["v_hazards"] = """
SELECT s_suppkey AS hazard_id, CASE WHEN s_suppkey % 2 = 0 THEN 'airsigmet' ELSE 'isigmet' END AS feed,
  CASE s_suppkey % 3 WHEN 0 THEN 'CONVECTIVE' WHEN 1 THEN 'TURB' ELSE 'ICE' END AS hazard,
  CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey % 6 AS STRING) END AS severity,
  1704067200 + s_suppkey * 3600 AS valid_time_to,
  CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 100 * 100 END AS altitude_low,
  s_suppkey % 100 * 100 + 10000 AS altitude_hi,
  CASE WHEN s_suppkey % 2 = 0 THEN concat('WST ', s_name) ELSE '' END AS raw_air_sigmet,
  concat('SIG ', s_name) AS raw_sigmet
FROM {supplier}"""

_SHAPE = [(0, -1.0, -1.0), (1, -1.0, 1.0), (2, 0.5, 1.5), (3, 1.0, 0.0), (4, 0.0, -0.5)]

VIEWS["v_vertices"] = " UNION ALL ".join(
    f"""
SELECT s_suppkey AS hazard_id, CAST({seq} AS BIGINT) AS seq,
  CASE WHEN s_nationkey = 7 AND {seq} > 1 THEN NULL WHEN s_nationkey = 8 AND {seq} = 3 THEN NULL
       ELSE CAST(s_suppkey * 53 % 120 - 60 AS DOUBLE) + CAST({dy} AS DOUBLE) * (4 + s_nationkey % 20) END AS lat,
  CAST(s_suppkey * 97 % 280 - 140 AS DOUBLE) + CAST({dx} AS DOUBLE) * (4 + s_nationkey % 20) AS lon
FROM {{supplier}}"""
    for seq, dy, dx in _SHAPE
)

VIEWS["v_metar"] = """
SELECT event_id AS report_id, concat('K', CAST(user_id AS STRING)) AS station,
  1704067200 + event_id * 259 AS obs_time, concat('Station ', CAST(user_id AS STRING)) AS name,
  CASE event_type WHEN 'error' THEN 'LIFR' WHEN 'view' THEN 'VFR' WHEN 'click' THEN 'IFR' ELSE NULL END AS flt_cat,
  CASE WHEN event_id % 11 <> 0 THEN event_id * 10 % 360 END AS wdir,
  CASE WHEN event_id % 13 <> 0 THEN event_id % 40 END AS wspd,
  CASE WHEN event_id % 5 = 0 THEN event_id % 60 END AS wgst,
  CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 10 AS STRING) END AS visib,
  CASE WHEN event_id % 9 <> 0 THEN value - 20 END AS temp, value - 25 AS dewp, 980 + value AS altim,
  CASE event_id % 4 WHEN 0 THEN 'FEW' WHEN 1 THEN 'BKN' WHEN 2 THEN 'OVC' END AS cover1,
  CASE WHEN event_id % 7 <> 0 THEN event_id % 90 * 100 END AS base1,
  CASE event_id % 3 WHEN 0 THEN 'BKN' WHEN 1 THEN 'SCT' END AS cover2,
  event_id % 120 * 100 AS base2, props AS raw_ob
FROM {events}"""

VIEWS["v_taf"] = """
SELECT event_id AS taf_id, concat('K', CAST(user_id AS STRING)) AS station, 1704067200 + event_id * 259 AS issue_time,
  1704067200 + event_id * 300 AS from1, 1704067200 + event_id * 300 + 21600 AS to1,
  1704067200 + event_id * 300 + 21600 AS from2, 1704067200 + event_id * 300 + 43200 AS to2,
  CASE event_id % 3 WHEN 0 THEN 'TEMPO' WHEN 1 THEN '' END AS change1,
  CASE WHEN event_id % 2 = 0 THEN 30 END AS prob1,
  CASE WHEN event_id % 4 <> 0 THEN event_id * 20 % 360 END AS wdir1, event_id % 30 AS wspd1,
  CASE WHEN event_id % 6 = 0 THEN 25 + event_id % 20 END AS wgst1, 'BECMG' AS change2, props AS raw_taf
FROM {events}"""

VIEWS["v_pireps"] = """
SELECT event_id AS report_id, CAST((event_id * 13) % 1800 AS DOUBLE) / 10 - 90 AS lat,
  CAST((event_id * 29) % 3600 AS DOUBLE) / 10 - 180 AS lon, 1704067200 + (event_id * 7919) % 86400 AS obs_time,
  concat('AC', CAST(user_id % 20 AS STRING)) AS ac_type, CAST(event_id % 450 AS STRING) AS flt_lvl, props AS raw_ob
FROM {events}"""


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Joins of a stand-in in another order than its text gives them: orders meet their customers before line items, which so move once for both.
JOINED = {"v_t100": ("FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey",
                     "FROM {lineitem} JOIN ({orders} JOIN {customer} ON o_custkey = c_custkey) ON l_orderkey = o_orderkey")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stand-in as a lazy DataFrame."""
    text = VIEWS[name].replace(*JOINED[name]) if name in JOINED else VIEWS[name]
    used = {t: raw_table(spark, sf_dir, t) for t in RAW if "{" + t + "}" in text}
    return spark.sql(text, **used)


def check_sql(select: str) -> str:
    """Prefix a SELECT with the stand-ins it names, for the SQL check."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", select)]
    if not named:
        return select
    tables = {t: t for t in RAW}
    heads = ",\n".join(f"{v} AS ({VIEWS[v].format(**tables)})" for v in named)
    body = select.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


# Domain table -> the stand-in that plays it.
DOMAIN = {
    "operators": "v_operators", "part135_aircraft": "v_link", "faa_registry": "v_registry",
    "aircraft_ref": "v_ref", "aircraft_photos": "v_photos", "airports": "v_airports", "runways": "v_runways",
    "faa_airport_detail": "v_detail", "t100_segment": "v_t100", "aircraft_type_ref": "v_type_ref",
    "service_logs": "v_logs", "notifications": "v_notes", "services": "v_jobs", "run_events": "v_run_events",
}


def _clouds(*layers: tuple[str, str]) -> str:
    items = ", ".join(f"named_struct('cover', {c}, 'base', {b})" for c, b in layers)
    return f"filter(array({items}), x -> x.cover IS NOT NULL)"


# Stand-ins of landed documents: the flat view with its nested columns put together.
def _metar(flat: DataFrame) -> DataFrame:
    return flat.selectExpr("report_id", "station", "obs_time", "name", "flt_cat", "wdir", "wspd", "wgst", "visib", "temp",
                           "dewp", "altim", _clouds(("cover1", "base1"), ("cover2", "base2")) + " AS clouds", "raw_ob")


def _taf(flat: DataFrame) -> DataFrame:
    first = ("named_struct('timeFrom', from1, 'timeTo', to1, 'fcstChange', change1, 'probability', prob1, 'wdir', wdir1, "
             "'wspd', wspd1, 'wgst', wgst1, 'visib', concat(CAST(wspd1 % 9 AS STRING), '+'), 'wxString', "
             "CASE WHEN wspd1 % 3 = 0 THEN '-RA' END, 'clouds', " + _clouds(("'BKN'", "wspd1 * 100")) + ")")
    second = ("named_struct('timeFrom', from2, 'timeTo', to2, 'fcstChange', change2, 'probability', CAST(NULL AS INT), "
              "'wdir', CAST(NULL AS BIGINT), 'wspd', CAST(NULL AS BIGINT), 'wgst', CAST(NULL AS BIGINT), 'visib', "
              "CAST(NULL AS STRING), 'wxString', CAST(NULL AS STRING), 'clouds', "
              + _clouds(("CAST(NULL AS STRING)", "wspd1")) + ")")
    return flat.selectExpr("taf_id", "station", "issue_time", "raw_taf", f"array({first}, {second}) AS fcsts")


def polygons(vertices: DataFrame) -> DataFrame:
    """Vertices as the ``coords`` array of a landed hazard: five per polygon, see ``_SHAPE``."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lat", "lon")))
    return vertices.groupBy("hazard_id").agg(
        F.transform(ordered, lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"))).alias("coords"))


def _hazards(flat: DataFrame, vertices: DataFrame) -> DataFrame:
    return flat.join(polygons(vertices), "hazard_id")


def _emails(flat: DataFrame) -> DataFrame:
    return flat.withColumn("internal_ts", epoch_ms_ts(F.col("internal_ms")).cast("timestamp_ntz"))


def domain_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All domain tables over one test data folder."""
    loaders = {name: (lambda v=v: view(spark, sf_dir, v)) for name, v in DOMAIN.items()}
    loaders.update({v: (lambda v=v: view(spark, sf_dir, v)) for v in VIEWS})
    loaders.update({
        "emails": lambda: _emails(view(spark, sf_dir, "v_emails")),
        "metar": lambda: _metar(view(spark, sf_dir, "v_metar")),
        "taf": lambda: _taf(view(spark, sf_dir, "v_taf")),
        "hazards": lambda: _hazards(view(spark, sf_dir, "v_hazards"), view(spark, sf_dir, "v_vertices")),
        "pireps": lambda: view(spark, sf_dir, "v_pireps").withColumnsRenamed({"lat": "report_lat", "lon": "report_lon"}),
    })
    loaders.update({t: (lambda t=t: raw_table(spark, sf_dir, t)) for t in RAW})
    return Tables(loaders)
