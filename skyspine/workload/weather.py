"""Weather and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions import geo
from skyspine.functions import weather as W
from skyspine.operators import hazards as H
from skyspine.operators import ordering
from skyspine.plans import airports as plans
from skyspine.session import scratch
from skyspine.sources import ingest
from skyspine.sources.json_feeds import read_photo_json, read_weather_json, weather_rows
from skyspine.standins import polygons
from skyspine.tables import Tables
from skyspine.workload.registry import query

CLOUDS = "list_filter([{'cover': cover1, 'base': base1}, {'cover': cover2, 'base': base2}], lambda x: x.cover IS NOT NULL)"
CEILING = f"""list_min(list_transform(list_filter({CLOUDS}, lambda c: c.cover IN ('BKN', 'OVC', 'OVX') AND c.base IS NOT NULL),
  lambda c: c.base))"""
CLOUD_TEXT = f"""coalesce(NULLIF(array_to_string(list_transform({CLOUDS}, lambda c: c.cover ||
  coalesce(' ' || format('{{:,}}', c.base), '')), ', '), ''), 'Clear')"""
WIND = """CASE WHEN wdir IS NULL THEN '—' ELSE (CASE WHEN wdir = 0 AND coalesce(wspd, 0) <> 0 THEN 'VRB'
  ELSE CAST(wdir AS STRING) || '°' END) || ' @ ' || format('{:,}', coalesce(wspd, 0)) || ' kt' ||
  CASE WHEN coalesce(wgst, 0) <> 0 THEN ' G' || CAST(wgst AS STRING) ELSE '' END END"""


def zulu(column: str) -> str:
    return f"strftime(make_timestamp(CAST({column} AS BIGINT) * 1000000), '%d %H:%MZ')"


@query("ceiling", f"SELECT report_id, {CEILING} AS ceiling FROM v_metar")
def _(t, spark):
    return t.metar.select("report_id", W.ceiling(F.col("clouds")).alias("ceiling"))


@query("cloud_text", f"SELECT report_id, {CLOUD_TEXT} AS clouds FROM v_metar")
def _(t, spark):
    return t.metar.select("report_id", W.cloud_text(F.col("clouds")).alias("clouds"))


@query("altimeter_inhg", "SELECT report_id, round(altim / 33.8639::DOUBLE, 2) AS inhg FROM v_metar")
def _(t, spark):
    return t.metar.select("report_id", W.altimeter_inhg(F.col("altim")).alias("inhg"))


@query("wind_text", f"SELECT report_id, {WIND} AS wind FROM v_metar")
def _(t, spark):
    return t.metar.select("report_id", W.wind_text(F.col("wdir"), F.col("wspd"), F.col("wgst")).alias("wind"))


@query("zulu", f"SELECT report_id, {zulu('obs_time')} AS observed FROM v_metar")
def _(t, spark):
    return t.metar.select("report_id", W.zulu(F.col("obs_time")).alias("observed"))


CONDITIONS = f"""SELECT station, report_id, coalesce(flt_cat, '—') AS flight_category, {WIND} AS wind,
  coalesce(visib || ' SM', '—') AS visibility, coalesce(format('{{:,}}', {CEILING}) || ' ft', 'Unlimited') AS ceiling,
  {CLOUD_TEXT} AS clouds, coalesce(CAST(CAST(floor(temp + 0.5) AS BIGINT) AS STRING) || '°C', '—') AS temperature,
  coalesce(CAST(CAST(floor(dewp + 0.5) AS BIGINT) AS STRING) || '°C', '—') AS dewpoint,
  round(altim / 33.8639::DOUBLE, 2) AS altimeter_inhg, {zulu('obs_time')} AS observed, raw_ob"""


@query("current_conditions", f"{CONDITIONS} FROM v_metar")
def _(t, spark):
    return plans.current_conditions(t.metar)


PERIODS = f"""SELECT station, taf_id, CAST(0 AS BIGINT) AS pos, {zulu('from1')} AS time_from, {zulu('to1')} AS time_to,
  coalesce(NULLIF(change1, '') || coalesce(' ' || CAST(prob1 AS STRING) || '%', ''), 'FROM') AS change,
  CASE WHEN wdir1 IS NULL THEN '—' ELSE CAST(wdir1 AS STRING) || '° @ ' || CAST(wspd1 AS STRING) || 'kt' ||
    coalesce('G' || CAST(wgst1 AS STRING), '') END AS wind, CAST(wspd1 % 9 AS STRING) || '+ SM' AS visibility,
  CASE WHEN wspd1 % 3 = 0 THEN '-RA' END AS weather, 'BKN ' || format('{{:,}}', wspd1 * 100) AS clouds FROM {{source}}
UNION ALL SELECT station, taf_id, CAST(1 AS BIGINT), {zulu('from2')}, {zulu('to2')}, change2, '—', '—', NULL, 'Clear' FROM {{source}}"""


@query("taf_periods", PERIODS.replace("{source}", "v_taf"))
def _(t, spark):
    return plans.forecast_periods(t.taf)


STATIONS = "SELECT ident, trim(coalesce(NULLIF(icao_code, ''), ident)) AS station, latitude_deg AS lat, longitude_deg AS lon FROM v_airports"


@query("station_report", f"""SELECT s.ident, s.station, m.report_id AS metar_id, m.obs_time, m.flt_cat, f.taf_id, f.issue_time
FROM ({STATIONS}) s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY station ORDER BY obs_time DESC, report_id DESC) AS rn
  FROM v_metar) m ON m.station = s.station AND m.rn = 1
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY station ORDER BY issue_time DESC, taf_id DESC) AS rn
  FROM v_taf) f ON f.station = s.station AND f.rn = 1""")
def _(t, spark):
    return plans.station_report(t).select("ident", "station", "metar_id", "obs_time", "flt_cat", "taf_id", "issue_time")


EDGES = """SELECT hazard_id, lat AS yi, lon AS xi, count(*) OVER (PARTITION BY hazard_id) AS n,
  coalesce(lag(lat) OVER (PARTITION BY hazard_id ORDER BY seq), last_value(lat) OVER (PARTITION BY hazard_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS yj,
  coalesce(lag(lon) OVER (PARTITION BY hazard_id ORDER BY seq), last_value(lon) OVER (PARTITION BY hazard_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS xj
FROM v_vertices WHERE lat IS NOT NULL AND lon IS NOT NULL"""
CROSSED = """n >= 3 AND (yi > p.lat) <> (yj > p.lat) AND p.lon < (xj - xi) * (p.lat - yi) / (yj - yi + 1e-12) + xi"""
OVER = f"""SELECT p.ident, e.hazard_id FROM ({STATIONS}) p JOIN ({EDGES}) e ON {CROSSED}
GROUP BY p.ident, e.hazard_id HAVING count(*) % 2 = 1"""

CENTRE = """SELECT hazard_id, avg(lat) + CAST(hazard_id % 13 - 6 AS DOUBLE) AS lat, min(lon) + CAST(hazard_id % 17 AS DOUBLE) AS lon
FROM {v_vertices} WHERE seq <= 1 AND lat IS NOT NULL GROUP BY hazard_id"""


@query("point_in_polygon", f"""SELECT p.hazard_id, coalesce(c.n % 2 = 1, false) AS inside
FROM ({CENTRE.replace('{v_vertices}', 'v_vertices')}) p LEFT JOIN (SELECT p.hazard_id, count(*) AS n
  FROM ({CENTRE.replace('{v_vertices}', 'v_vertices')}) p JOIN ({EDGES}) e ON e.hazard_id = p.hazard_id AND {CROSSED}
  GROUP BY p.hazard_id) c ON c.hazard_id = p.hazard_id""")
def _(t, spark):
    points = spark.sql(CENTRE, v_vertices=t.v_vertices)
    rows = polygons(t.v_vertices).join(points, "hazard_id")
    return rows.select("hazard_id", geo.point_in_polygon(F.col("lat"), F.col("lon"), F.col("coords")).alias("inside"))


@query("point_in_polygon_join", OVER)
def _(t, spark):
    areas = polygons(t.v_vertices)
    return H.point_in_polygon_join(plans.stations(t), areas).select("ident", "hazard_id")


SHOWN = """SELECT o.ident, o.hazard_id, CASE WHEN h.feed = 'airsigmet' THEN 'SIGMET/AIRMET' ELSE 'Intl SIGMET' END AS source,
  h.hazard, h.severity, h.valid_time_to, h.altitude_low, h.altitude_hi,
  coalesce(NULLIF(h.raw_air_sigmet, ''), h.raw_sigmet) AS raw"""


@query("hazards_over_points", f"{SHOWN} FROM ({OVER}) o JOIN v_hazards h USING (hazard_id)")
def _(t, spark):
    return H.hazards_over_points(plans.stations(t), t.hazards).drop("station", "lat", "lon")


@query("union_feeds", """SELECT hazard_id, feed, CASE WHEN feed = 'airsigmet' THEN raw_air_sigmet END AS raw_air_sigmet, raw_sigmet
FROM v_hazards""")
def _(t, spark):
    rows = t.v_hazards
    domestic = rows.where("feed = 'airsigmet'").select("hazard_id", "raw_air_sigmet", "raw_sigmet")
    abroad = rows.where("feed = 'isigmet'").select("hazard_id", "raw_sigmet")
    return H.union_feeds(airsigmet=domestic, isigmet=abroad)


NEAR = f"""SELECT ident, report_id, position FROM (SELECT s.ident, r.report_id, row_number() OVER (PARTITION BY s.ident
  ORDER BY r.obs_time DESC NULLS LAST, r.report_id) AS position
FROM ({STATIONS}) s JOIN v_pireps r ON s.lat IS NOT NULL AND 2 * 3440.065::DOUBLE * asin(least(sqrt(
  pow(sin(radians(r.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - s.lon) / 2), 2)),
  1.0::DOUBLE)) <= {{radius}}) q WHERE position <= 8"""


@query("nearby_reports", NEAR.format(radius=150))
def _(t, spark):
    return H.nearby_reports(plans.stations(t), t.pireps).select("ident", "report_id", "position")


@query("nearby_reports_wide", NEAR.format(radius=700))
def _(t, spark):
    return H.nearby_reports(plans.stations(t), t.pireps, radius_nm=700.0).select("ident", "report_id", "position")


COLUMNS = ["flight_category", "wind", "visibility", "ceiling", "clouds", "temperature", "dewpoint", "altimeter_inhg", "observed", "raw", "issued",
           "time_from", "time_to", "change", "weather", "title", "source", "severity", "until", "levels", "ac_type"]


def panel(part: str, place: str, rows: str, **values: str) -> str:
    """One part of the panel; what it lacks is NULL."""
    kind = {"altimeter_inhg": "DOUBLE"}
    cells = [f"{values[c]} AS {c}" if c in values else f"CAST(NULL AS {kind.get(c, 'VARCHAR')}) AS {c}" for c in COLUMNS]
    return f"SELECT s.ident, s.station, '{part}' AS part, CAST({place} AS BIGINT) AS place, {', '.join(cells)} FROM {rows}"


def weather_sql(only: str = "", metar: str = "v_metar", taf: str = "v_taf", hazards: str = "v_hazards", pireps: str = "v_pireps") -> str:
    same = {c: c for c in COLUMNS}
    return f"""WITH s AS ({STATIONS} {only}),
 m AS ({CONDITIONS} FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY obs_time DESC, report_id DESC) AS rn
   FROM {metar}) q WHERE rn = 1),
 newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY issue_time DESC, taf_id DESC) AS rn
   FROM {taf}) q WHERE rn = 1),
 f AS (SELECT p.*, {zulu('issue_time')} AS issued, raw_taf AS raw FROM ({PERIODS.replace('{source}', 'newest')}) p
   JOIN newest USING (taf_id)), h AS ({SHOWN} FROM ({OVER}) o JOIN (FROM {hazards}) h USING (hazard_id)),
 n AS ({NEAR.format(radius=150).replace('v_pireps', pireps)})
""" + " UNION ALL ".join([
        panel("conditions", "0", "m JOIN s USING (station)", **{c: same[c] for c in COLUMNS[:9]}, raw="raw_ob"),
        panel("forecast", "pos", "f JOIN s USING (station)", **{c: same[c] for c in ("issued", "time_from", "time_to", "change", "wind", "visibility", "weather", "clouds", "raw")}),
        panel("hazard", "h.hazard_id", "h JOIN s ON s.ident = h.ident", title="coalesce(hazard, source)", source="source", severity="severity",
              until=zulu("valid_time_to"), levels="""CASE WHEN altitude_low IS NOT NULL THEN 'FL' || CAST(altitude_low AS STRING) || '–' ||
  CAST(altitude_hi AS STRING) END""", raw="substr(raw, 1, 400)"),
        panel("report", "n.position", "n JOIN s ON s.ident = n.ident JOIN v_pireps r ON r.report_id = n.report_id", ac_type="r.ac_type",
              levels="'FL' || r.flt_lvl", observed=zulu("r.obs_time"), raw="r.raw_ob")])


@query("airport_weather", weather_sql())
def _(t, spark):
    return plans.airport_weather(t)


@query("airport_weather_one", weather_sql("WHERE ident = 'A000003'"))
def _(t, spark):
    return plans.airport_weather(t, "A000003")


AS_OF = 1704067200 + 43200


def window(view: str, column: str, hours: int) -> str:
    return f"(SELECT * FROM {view} WHERE {column} BETWEEN {AS_OF - hours * 3600 + 1} AND {AS_OF})"


@query("airport_weather_current", weather_sql("", window("v_metar", "obs_time", 2), window("v_taf", "issue_time", 30),
                                              f"(SELECT * FROM v_hazards WHERE valid_time_to > {AS_OF})", window("v_pireps", "obs_time", 2)))
def _(t, spark):
    return plans.airport_weather(t, as_of=AS_OF)


@query("weather_from_landing", f"SELECT * EXCLUDE (report_id) FROM ({CONDITIONS} FROM v_metar) c")
def _(t, spark):
    """Observations as the feed names them, landed, read back, and shown."""
    path = scratch(spark, "metar")
    clouds = F.transform("clouds", lambda c: F.struct(c["cover"].alias("cover"), c["base"].alias("base")))
    t.metar.select(F.col("station").alias("icaoId"), "name", F.col("obs_time").alias("obsTime"), F.col("flt_cat").alias("fltCat"), "altim", "wdir", "wspd",
                   "wgst", "visib", "temp", "dewp", clouds.alias("clouds"), F.col("raw_ob").alias("rawOb")).write.json(path)
    return plans.current_conditions(weather_rows(read_weather_json(spark, path, "metar"), "metar")).drop("report_id")


def land_feeds(t, spark, names) -> dict[str, str]:
    """Feeds as their publisher names the columns, one record per line."""
    covers = lambda c: F.transform(c, lambda x: F.struct(x["cover"].alias("cover"), x["base"].alias("base")))
    feeds = {
        "metar": t.metar.select(F.col("station").alias("icaoId"), "name", F.col("obs_time").alias("obsTime"), F.col("flt_cat").alias("fltCat"), "altim",
                                "wdir", "wspd", "wgst", "visib", "temp", "dewp", covers("clouds").alias("clouds"), F.col("raw_ob").alias("rawOb")),
        "taf": t.taf.select(F.col("station").alias("icaoId"), F.from_unixtime("issue_time", "yyyy-MM-dd HH:mm:ss").alias("issueTime"),
                            F.col("raw_taf").alias("rawTAF"), "fcsts"),
        "pirep": t.pireps.select(F.col("report_lat").alias("lat"), F.col("report_lon").alias("lon"), F.col("obs_time").alias("obsTime"),
                                 F.col("ac_type").alias("acType"), F.col("flt_lvl").alias("fltLvl"), F.col("raw_ob").alias("rawOb"))}
    for feed in ("airsigmet", "isigmet"):
        feeds[feed] = t.hazards.where(F.col("feed") == feed).select(
            "coords", "hazard", "severity", F.col("valid_time_to").alias("validTimeTo"), F.col("altitude_low").alias("altitudeLow1"),
            F.col("altitude_hi").alias("altitudeHi1"), F.col("raw_air_sigmet").alias("rawAirSigmet"), F.col("raw_sigmet").alias("rawSigmet"))
    paths = {feed: scratch(spark, feed) for feed in names}
    for feed, path in paths.items():
        feeds[feed].write.json(path)
    return paths


def stored_weather(t, spark, *names: str) -> Tables:
    """Feeds landed and ingested; the first one twice, so that what is there already must not count again."""
    root, paths = scratch(spark, "weather"), land_feeds(t, spark, names)
    for feed in [*names, names[0]]:
        ingest.INGESTS[feed](spark, paths[feed], root)
    return Tables.from_stored(spark, {ingest.WEATHER_FEEDS[feed][0]: ingest.weather_table(spark, root, feed) for feed in names})


@query("ingest_pireps", "SELECT DISTINCT lat AS report_lat, lon AS report_lon, obs_time, ac_type, flt_lvl, raw_ob FROM v_pireps")
def _(t, spark):
    return stored_weather(t, spark, "pirep").pireps.drop("report_id")


@query("ingest_hazards", """SELECT DISTINCT feed, hazard, severity, CAST(valid_time_to AS BIGINT) AS valid_time_to, CAST(altitude_low AS INTEGER) AS altitude_low, CAST(altitude_hi AS INTEGER) AS altitude_hi,
  raw_air_sigmet, raw_sigmet FROM v_hazards""")
def _(t, spark):
    return stored_weather(t, spark, "airsigmet", "isigmet").hazards.select("feed", "hazard", "severity", "valid_time_to", "altitude_low", "altitude_hi",
                                                   "raw_air_sigmet", "raw_sigmet").distinct()


@query("airport_weather_ingested", f"SELECT DISTINCT * EXCLUDE (place) FROM ({weather_sql()}) w WHERE part <> 'report'")
def _(t, spark):
    """The panel from ingested feeds. Reports of one minute are told apart by an id of their own there, so they are left out here."""
    held = stored_weather(t, spark, "metar", "taf", "airsigmet", "isigmet")
    tables = Tables.of(airports=t.airports, metar=held.metar, taf=held.taf, hazards=held.hazards, pireps=t.pireps.limit(0))
    return plans.airport_weather(tables, once=True).where("part <> 'report'")


@query("read_weather_json", f"""SELECT station AS "icaoId", obs_time AS "obsTime", flt_cat AS "fltCat", CAST(wdir AS STRING) AS wdir,
  CAST(wspd AS INTEGER) AS wspd, {CLOUD_TEXT} AS clouds, raw_ob AS "rawOb" FROM v_metar""")
def _(t, spark):
    path = scratch(spark, "metar")
    clouds = F.transform("clouds", lambda c: F.struct(c["cover"].alias("cover"), c["base"].alias("base")))
    t.metar.select(F.col("station").alias("icaoId"), F.col("obs_time").alias("obsTime"), F.col("flt_cat").alias("fltCat"),
                   "wdir", "wspd", clouds.alias("clouds"), F.col("raw_ob").alias("rawOb")).write.json(path)
    feed = read_weather_json(spark, path, "metar")
    return feed.select("icaoId", "obsTime", "fltCat", "wdir", "wspd", W.cloud_text(F.col("clouds")).alias("clouds"), "rawOb")


@query("read_photo_json", """SELECT o_orderkey, o_orderstatus <> 'P' AS has_photo,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS STRING) END AS photo_id,
  CASE o_orderstatus WHEN 'F' THEN 'https://large/' || CAST(o_orderkey AS STRING)
    WHEN 'O' THEN 'https://small/' || CAST(o_orderkey AS STRING) END AS thumbnail_url,
  CASE WHEN o_orderstatus <> 'P' THEN 'https://page/1' END AS page_link,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS photographer FROM orders""")
def _(t, spark):
    key = F.col("o_orderkey").cast("string")
    large = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("https://large/"), key)).otherwise(F.lit(""))
    photo = F.struct(F.col("o_custkey").cast("string").alias("id"), F.lit("https://page/1").alias("link"),
                     F.col("o_orderpriority").alias("photographer"),
                     F.struct(F.concat(F.lit("https://small/"), key).alias("src")).alias("thumbnail"),
                     F.struct(large.alias("src")).alias("thumbnail_large"))
    photos = F.when(F.col("o_orderstatus") == "P", F.slice(F.array(photo), 1, 0)).otherwise(F.array(photo, photo))
    return read_photo_json(t.orders.select("o_orderkey", F.to_json(F.struct(photos.alias("photos"))).alias("value")))


@query("first_n_items", f"""SELECT report_id, ({CLOUDS})[1].cover AS first_cover, len(list_slice({CLOUDS}, 1, 8)) AS n FROM v_metar""")
def _(t, spark):
    return t.metar.select("report_id", ordering.first_item(F.col("clouds"))["cover"].alias("first_cover"),
                          F.size(ordering.first_n_items(F.col("clouds"), V.PILOT_REPORTS_SHOWN)).cast("bigint").alias("n"))
