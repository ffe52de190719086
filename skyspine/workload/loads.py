"""Scans, ingests, stored tables and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyspine import schemas as S
from skyspine.functions import fixed_values as V
from skyspine.operators import upsert as U
from skyspine.operators.keys import KeyViolation
from skyspine.sources import archive, ingest
from skyspine.sources import store
from skyspine.sources import text as X
from skyspine.session import scratch
from skyspine.plans import fleet
from skyspine.streaming.upsert_stream import stream_upsert
from skyspine.tables import Tables
from skyspine.workload.cleaning import WS
from skyspine.workload.fleet import SPINE_SQL
from skyspine.workload.landing import csv_line, land_lines, zip_batches
from skyspine.workload.registry import query

REGISTRY_HEAD = "N-NUMBER, SERIAL NUMBER , MFR MDL CODE, YEAR MFR , TYPE REGISTRANT, NAME, CITY, STATE, STATUS CODE, " \
                "MODE S CODE, MODE S CODE HEX "
REGISTRY_COLUMNS = ["n_number", "serial_number", "mfr_mdl_code", "year_mfr", "registrant_type", "registrant_name", "city",
                    "state", "status_code", "mode_s_code_octal", "mode_s_hex"]


def _padded(c: str):
    return F.concat(F.col(c), F.lit("  "))


def land_registry(t, spark) -> str:
    """Registration file: padded cells, marks without the N, lower-case codes."""
    mark = F.regexp_replace("n_number", "^N", "")
    cells = [mark, *[_padded(c) for c in REGISTRY_COLUMNS[1:-1]], F.lower("mode_s_hex")]
    return land_lines(t.faa_registry, csv_line(*cells), scratch(spark, "registry"), REGISTRY_HEAD)


@query("read_text_table", """SELECT regexp_replace(n_number, '^N', '') AS "N-NUMBER", registrant_name || '  ' AS "NAME",
  CASE WHEN status_code = '' THEN '' ELSE status_code || '  ' END AS "STATUS CODE", lower(mode_s_hex) AS "MODE S CODE HEX" FROM v_registry""")
def _(t, spark):
    table = X.read_text_table(spark, land_registry(t, spark))
    return table.select("N-NUMBER", "NAME", "STATUS CODE", "MODE S CODE HEX")


@query("read_text_table_bad_rows", """SELECT n_number AS "A", registrant_name AS "B",
  CASE WHEN year_mfr LIKE '%7' THEN 'more' WHEN year_mfr LIKE '%8' THEN 'far' END AS _extra FROM v_registry""")
def _(t, spark):
    """Rows with a cell too many are shown, short rows are filled with blanks."""
    year = F.col("year_mfr")
    more = (F.when(year.endswith("7"), F.lit(",more")).when(year.endswith("8"), F.lit(",,,far"))
            .when(year.endswith("9"), F.lit(",,")).otherwise(F.lit("")))
    lines = F.concat(csv_line(F.col("n_number"), F.col("registrant_name")), more)
    return X.read_text_table(spark, land_lines(t.faa_registry, lines, scratch(spark, "bad"), "A,B"), strict=False)


@query("read_text_table_quoted_breaks", """SELECT n_number AS "A", registrant_name || chr(10) || ' "x", y' AS "B", '' AS "C" FROM v_registry""")
def _(t, spark):
    text = F.concat("registrant_name", F.lit('\n "x", y'))
    return X.read_text_table(spark, land_lines(t.faa_registry, csv_line(F.col("n_number"), text), scratch(spark, "breaks"), "A,B,C"))


@query("resolve_columns", """SELECT regexp_replace(n_number, '^N', '') AS n_number, serial_number || '  ' AS serial_number,
  mfr_mdl_code || '  ' AS mfr_mdl_code, year_mfr || '  ' AS year_mfr, registrant_type || '  ' AS registrant_type,
  registrant_name || '  ' AS registrant_name, city || '  ' AS city, state || '  ' AS state,
  CASE WHEN status_code = '' THEN '' ELSE status_code || '  ' END AS status_code, mode_s_code_octal || '  ' AS mode_s_code_octal, lower(mode_s_hex) AS mode_s_hex
FROM v_registry""")
def _(t, spark):
    return X.resolve_columns(X.read_text_table(spark, land_registry(t, spark)), V.REGISTRY_HEADER)


REGISTRY_ROWS = """SELECT CASE WHEN substr(n_number, 1, 1) = 'X' THEN 'N' || n_number ELSE n_number END AS n_number,
  serial_number, mfr_mdl_code, year_mfr, registrant_type, registrant_name, city, state,
  NULLIF(status_code, '') AS status_code, mode_s_code_octal, NULLIF(mode_s_hex, '') AS mode_s_hex FROM v_registry"""


@query("ingest_registry", REGISTRY_ROWS)
def _(t, spark):
    root = scratch(spark, "tables")
    ingest.ingest_registry(spark, land_registry(t, spark), root)
    return ingest.stored(root, "faa_registry").read(spark)


@query("ingest_registry_zip", REGISTRY_ROWS)
def _(t, spark):
    """The registration file as the publisher packs it."""
    mark = F.regexp_replace("n_number", "^N", "")
    cells = [mark, *[_padded(c) for c in REGISTRY_COLUMNS[1:-1]], F.lower("mode_s_hex")]
    folder = scratch(spark, "zips")
    packed = zip_batches(t.faa_registry.coalesce(1), csv_line(*cells), "MASTER.txt", REGISTRY_HEAD + ",")
    packed.select("path", F.base64("content").alias("content")).write.json(folder)
    archives = spark.read.schema("path STRING, content STRING").json(folder).withColumn("content", F.unbase64("content"))
    members = archive.member_lines(archives, "MASTER.txt", "UTF-8")
    return ingest.clean_registry(ingest.packed_table(members)).select(*REGISTRY_COLUMNS)


CERTIFICATES = """SELECT p.n_number, p.certificate_designator, p.serial_number, p.make_model_series, o.operator_name, o.fsdo
FROM v_link p JOIN v_operators o USING (certificate_designator)"""


def land_certificates(t, spark) -> str:
    rows = t.part135_aircraft.join(t.operators, "certificate_designator")
    cells = [F.concat("operator_name", F.lit(", INC")), F.col("certificate_designator"), F.col("fsdo"),
             F.regexp_replace("n_number", "^N", ""), F.col("serial_number"), _padded("make_model_series")]
    return land_lines(rows, csv_line(*cells), scratch(spark, "certificates"), "CHARTER CERTIFICATE LIST",
                      "Certificate Holder Name, Certificate Designator, District Office, Registration Number, "
                      "Serial Number, Aircraft Make/Model/Series")


@query("read_banner_table", f"""SELECT operator_name || ', INC' AS "Certificate Holder Name", certificate_designator AS
  "Certificate Designator", fsdo AS "District Office", regexp_replace(n_number, '^N', '') AS "Registration Number",
  serial_number AS "Serial Number", CASE WHEN make_model_series = '' THEN '' ELSE make_model_series || '  ' END
  AS "Aircraft Make/Model/Series" FROM ({CERTIFICATES}) q""")
def _(t, spark):
    return X.read_banner_table(spark, land_certificates(t, spark))


@query("ingest_certificates", f"""SELECT DISTINCT n_number, certificate_designator, serial_number, make_model_series
FROM ({CERTIFICATES}) q""")
def _(t, spark):
    root = scratch(spark, "tables")
    ingest.ingest_certificates(spark, land_certificates(t, spark), root)
    return ingest.stored(root, "part135_aircraft").read(spark)


@query("ingest_operators", """SELECT certificate_designator, operator_name || ', INC' AS operator_name, '135' AS part, fsdo
FROM v_operators WHERE certificate_designator IN (SELECT certificate_designator FROM v_link)""")
def _(t, spark):
    operators, _ = ingest.clean_certificates(X.read_banner_table(spark, land_certificates(t, spark), position=True))
    return operators


INGESTED = SPINE_SQL.replace("FROM v_registry", f"FROM ({REGISTRY_ROWS}) v_registry")


@query("fleet_search_ingested", f"""SELECT * REPLACE (operator_name || ', INC' AS operator_name) FROM {INGESTED} spine
WHERE category = 'Jet' AND mode_s_hex > '' ORDER BY spine.operator_name || ', INC' NULLS LAST, n_number NULLS LAST, certificate_designator NULLS LAST LIMIT 800""")
def _(t, spark):
    """From landed files through stored tables to the product."""
    root = scratch(spark, "tables")
    ingest.ingest_registry(spark, land_registry(t, spark), root)
    ingest.ingest_certificates(spark, land_certificates(t, spark), root)
    store.replace_table(t.aircraft_ref.select(*S.column_names("aircraft_ref")), ingest.stored(root, "aircraft_ref"))
    held = Tables.from_stored(spark, {n: ingest.stored(root, n) for n in ("faa_registry", "operators", "part135_aircraft", "aircraft_ref")})
    return fleet.fleet_search(held, category="Jet", adsb_ready=True, limit=800)


LAYOUT = {"record": (1, 3), "key": (4, 11), "priority": (15, 20), "count": (35, 3), "flag": (38, 3)}


def land_fixed(t, spark) -> str:
    return land_lines(t.v_fixed, F.col("value"), scratch(spark, "fixed"))


@query("read_fixed_width", """SELECT substr(value, 1, 3) AS record, trim(substr(value, 4, 11)) AS key,
  trim(substr(value, 15, 20)) AS priority, trim(substr(value, 35, 3)) AS count, trim(substr(value, 38, 3)) AS flag
FROM v_fixed WHERE substr(value, 1, 3) = 'APT'""")
def _(t, spark):
    return X.read_fixed_width(spark, land_fixed(t, spark), LAYOUT, "APT")


@query("filter_record_type", "SELECT value FROM v_fixed WHERE substr(value, 1, 3) = 'RWY'")
def _(t, spark):
    return X.filter_record_type(X.read_lines(spark, land_fixed(t, spark)), "RWY")


DETAIL_TEXT = ["location_id", "site_number", "facility_name", "city", "state", "owner_name", "owner_phone", "manager_name",
               "manager_phone"]


def detail_line(t):
    """The base record as a fixed-width line: fields put at their starts, blanks between."""
    line, at = F.lit(V.AIRPORT_RECORD_TAG), 4
    for name, (start, length) in sorted(V.AIRPORT_RECORD.items(), key=lambda x: x[1]):
        cell = F.coalesce(F.col(name).cast("string"), F.lit(""))
        cell = F.lpad(cell, length, " ") if name in V.BASED_COUNTS else F.rpad(cell, length, " ")
        line, at = F.concat(line, F.lit(" " * (start - at)), cell), start + length
    return line


@query("ingest_airport_detail", """SELECT substr(location_id, 1, 4) AS location_id, site_number, facility_name, city, state,
  owner_name, owner_phone, manager_name, manager_phone, CAST(based_single AS INTEGER) AS based_single,
  CAST(based_multi AS INTEGER) AS based_multi, CAST(based_jet AS INTEGER) AS based_jet,
  CAST(based_heli AS INTEGER) AS based_heli, CAST(based_glider AS INTEGER) AS based_glider,
  CAST(based_military AS INTEGER) AS based_military, CAST(based_ultralight AS INTEGER) AS based_ultralight,
  CAST(based_single + based_multi + based_jet + based_heli + based_glider + based_military + based_ultralight AS INTEGER)
    AS based_total FROM v_detail""")
def _(t, spark):
    path = land_lines(t.faa_airport_detail, detail_line(t), scratch(spark, "detail"))
    return ingest.clean_airport_detail(X.read_lines(spark, path))


@query("read_code_lookup", """SELECT lpad(CAST(p_partkey AS STRING), 6, '0') AS code, p_name AS description FROM part
WHERE p_size % 5 <> 0""")
def _(t, spark):
    code = F.when(F.col("p_size") % 5 == 0, F.lit("  ")).otherwise(F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    line = F.concat(F.lit(" "), code, F.lit(" , "), F.col("p_name"), F.lit(" "))
    return X.read_code_lookup(spark, land_lines(t.part, line, scratch(spark, "codes"), "Code,Description"))


KEYED_TRAFFIC = """SELECT year, month, unique_carrier, min(airline_id) AS airline_id, min(carrier_name) AS carrier_name, origin,
  min(origin_city) AS origin_city, min(origin_state) AS origin_state, dest, min(dest_city) AS dest_city,
  min(dest_state) AS dest_state, min(aircraft_group) AS aircraft_group, aircraft_type, aircraft_config,
  sum(departures) AS departures, sum(seats) AS seats, sum(passengers) AS passengers, sum(freight) AS freight,
  sum(mail) AS mail, max(distance) AS distance, class
FROM {v_t100} GROUP BY year, month, unique_carrier, origin, dest, aircraft_type, aircraft_config, class"""
KEYED_SQL = KEYED_TRAFFIC.replace("{v_t100}", "v_t100")
SHOWN = "year, month, unique_carrier, airline_id, carrier_name, origin, origin_city, origin_state, dest, dest_city, " \
        "dest_state, aircraft_group, aircraft_type, aircraft_config, class"
MEASURES = ["departures", "seats", "passengers", "freight", "mail", "distance"]
BAD_YEAR = 1995


def land_traffic(spark, rows, tag: str) -> dict[str, str]:
    """Traffic files, packed, one folder per year with the publisher's headers; one year holds a bad cell."""
    path = scratch(spark, tag)
    heads = {v: k for k, v in V.TRAFFIC_COLUMNS.items()}
    bad = (F.col("year") == BAD_YEAR) & (F.col("unique_carrier") == "7")
    texts = rows.withColumn("distance", F.when(bad, F.lit("unknown")).otherwise(F.col("distance").cast("string")))
    (texts.select(F.col("year").alias("period"), F.lit("x").alias("UNUSED"),
                  *[F.col(c).cast("string").alias(heads[c]) for c in rows.columns])
     .write.partitionBy("period").option("header", True).option("compression", "gzip").csv(path))
    # Named by the folders that were written, so that the rows are formed once.
    landed = {n.split("/period=")[1].split("/")[0] for n in spark.read.format("text").load(path).inputFiles()}
    periods = sorted("None" if p == "__HIVE_DEFAULT_PARTITION__" else p for p in landed)
    return {p: f"{path}/period={p}" for p in periods}


def keyed_traffic(t, spark):
    return spark.sql(KEYED_TRAFFIC, v_t100=t.v_t100)


def as_loaded(df):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in ("year", "month") else F.col(c)
                       for c in SHOWN.split(", ")], *[F.col(m).cast("double").alias(m) for m in MEASURES])


@query("project_rename", "SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS class, CAST(l_orderkey AS BIGINT) AS n FROM lineitem")
def _(t, spark):
    raw = t.lineitem.withColumn("l_shipdate", F.to_date("l_shipdate")).withColumnRenamed("l_returnflag", " l_returnflag ")
    return X.project_rename(raw, {"l_orderkey": "n", "l_shipdate": "day", "l_returnflag": "class"}, ["day", "class", "n"])


@query("load_periods", f"SELECT {SHOWN}, {', '.join(m + '::DOUBLE AS ' + m for m in MEASURES)} FROM ({KEYED_SQL}) q WHERE year <> {BAD_YEAR}")
def _(t, spark):
    rows, _ = ingest.load_periods(spark, land_traffic(spark, keyed_traffic(t, spark), "traffic"))
    return as_loaded(rows)


@query("load_periods_report", f"""SELECT CAST(year AS STRING) AS period, count(*) AS rows,
  CASE WHEN year = {BAD_YEAR} THEN count(*) FILTER (WHERE unique_carrier = '7') ELSE 0 END AS bad_rows,
  CASE WHEN year = {BAD_YEAR} THEN 'skipped' ELSE 'loaded' END AS status,
  CASE WHEN year = {BAD_YEAR} THEN 'bad cells' END AS reason FROM ({KEYED_SQL}) q GROUP BY year""")
def _(t, spark):
    _, report = ingest.load_periods(spark, land_traffic(spark, keyed_traffic(t, spark), "traffic"))
    return report


@query("ingest_traffic", f"""SELECT {SHOWN}, (departures + CASE WHEN year = 1996 THEN 1 ELSE 0 END)::DOUBLE AS departures,
  {', '.join(m + '::DOUBLE AS ' + m for m in MEASURES[1:])} FROM ({KEYED_SQL}) q WHERE year <> {BAD_YEAR}""")
def _(t, spark):
    root = scratch(spark, "tables")
    rows = keyed_traffic(t, spark)
    ingest.ingest_traffic(spark, land_traffic(spark, rows, "traffic"), root)
    again = rows.where("year = 1996").withColumn("departures", F.col("departures") + 1).withColumn(
        "origin_city", F.lit("elsewhere"))
    ingest.ingest_traffic(spark, land_traffic(spark, again, "traffic"), root)
    return as_loaded(ingest.stored(root, "t100_segment", ("year", "month")).read(spark))


def zip_traffic(spark, rows, tag: str) -> str:
    """The rows as zip archives, their columns in an order of their own."""
    folder = scratch(spark, tag)
    heads = {v: k for k, v in V.TRAFFIC_COLUMNS.items()}
    columns = rows.columns[::-1]
    line = csv_line(F.lit("x"), *[F.col(c).cast("string") for c in columns])
    packed = zip_batches(rows, line, "T_SEGMENT.csv", ",".join(["UNUSED", *[heads[c] for c in columns]]))
    packed.select(F.base64("content").alias("content")).write.json(folder)
    return folder


@query("ingest_traffic_zip", f"SELECT {SHOWN}, {', '.join(m + '::DOUBLE AS ' + m for m in MEASURES)} FROM ({KEYED_SQL}) q WHERE year = {BAD_YEAR}")
def _(t, spark):
    """Columns are found by the header of the zipped member, whatever their order."""
    rows = keyed_traffic(t, spark).where(F.col("year") == BAD_YEAR)
    packed = spark.read.schema("content STRING").json(zip_traffic(spark, rows, "zips")).select(F.lit("a.zip").alias("path"), F.unbase64("content").alias("content"))
    members = archive.member_lines(packed, ".csv")
    raw = archive.member_table(members, list(V.TRAFFIC_COLUMNS))
    return as_loaded(ingest.shape_traffic(raw))


@query("ingest_traffic_report", f"""SELECT CAST(year AS VARCHAR) AS period, count(*) AS rows, CAST(0 AS BIGINT) AS bad_rows, 'loaded' AS status, CAST(NULL AS VARCHAR) AS reason
FROM ({KEYED_SQL}) q WHERE year = 1996 GROUP BY year UNION ALL SELECT CAST(year AS VARCHAR), count(*), count(*) FILTER (WHERE unique_carrier = '7'), 'skipped', 'bad cells'
FROM ({KEYED_SQL}) q WHERE year = {BAD_YEAR} GROUP BY year
UNION ALL SELECT 'empty', 0, 0, 'empty', NULL UNION ALL SELECT 'missing', 0, 0, 'skipped', 'no such file'""")
def _(t, spark):
    """A good, a bad, an empty and a missing period."""
    rows = keyed_traffic(t, spark).where(F.col("year").isin(1996, BAD_YEAR))
    files = land_traffic(spark, rows, "traffic")
    heads = ",".join(V.TRAFFIC_COLUMNS)
    none = scratch(spark, "none")
    spark.createDataFrame([(heads,)], "value STRING").coalesce(1).write.text(none)
    return ingest.ingest_traffic(spark, files | {"empty": none, "missing": f"{none}/nowhere"}, scratch(spark, "tables"))


@query("read_zip_members", """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders""")
def _(t, spark):
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    archives = zip_batches(t.orders, line, "data/SEGMENT.CSV", "KEY,CUST,PRIORITY")
    table = archive.member_table(archive.member_lines(archives, ".csv"), ["KEY", "CUST", "PRIORITY"])
    return table.select(F.col("KEY").cast("bigint").alias("o_orderkey"), F.col("CUST").cast("bigint").alias("o_custkey"),
                        F.col("PRIORITY").alias("o_orderpriority"))


AIRPORT_COLUMNS = S.column_names("airports")
RUNWAY_COLUMNS = S.column_names("runways")


def land_table(df, columns, path: str) -> str:
    flags = {name for name, kind in df.dtypes if kind == "boolean"}
    cells = [F.when(F.col(c), "yes").when(~F.col(c), "no") if c in flags else F.col(c).cast("string") for c in columns]
    return land_lines(df, csv_line(*cells), path, ",".join(columns))


def land_airports(t, spark) -> str:
    landing = scratch(spark, "airports")
    land_table(t.airports, AIRPORT_COLUMNS, f"{landing}/airports")
    land_table(t.runways, RUNWAY_COLUMNS, f"{landing}/runways")
    return landing


@query("ingest_airports_report", """SELECT 'airports' AS "table", count(*) AS rows, count(*) FILTER (WHERE ident IN (SELECT airport_ident FROM v_runways
  WHERE NOT closed AND length_ft >= 4000)) AS jet_capable_4000ft FROM v_airports UNION ALL SELECT 'runways', count(*), NULL FROM v_runways""")
def _(t, spark):
    return ingest.ingest_airports(spark, land_airports(t, spark), scratch(spark, "tables"))


def ingest_airports(t, spark) -> str:
    root = scratch(spark, "tables")
    ingest.ingest_airports(spark, land_airports(t, spark), root)
    return root


@query("ingest_airports", """SELECT ident, type, name, latitude_deg, longitude_deg, CAST(elevation_ft AS INTEGER) AS elevation_ft,
  continent, iso_country, iso_region, municipality, scheduled_service, NULLIF(icao_code, '') AS icao_code, iata_code, gps_code,
  NULLIF(local_code, '') AS local_code, home_link, wikipedia_link FROM v_airports""")
def _(t, spark):
    return ingest.stored(ingest_airports(t, spark), "airports").read(spark)


@query("ingest_runways", """SELECT id, airport_ident, CAST(length_ft AS INTEGER) AS length_ft, CAST(width_ft AS INTEGER) AS width_ft,
  surface, lighted, closed, le_ident, he_ident FROM v_runways""")
def _(t, spark):
    return ingest.stored(ingest_airports(t, spark), "runways").read(spark)


REFERENCE = "SELECT p_partkey, p_brand, p_name, CAST(p_size % 13 AS STRING) AS kind, CAST(p_partkey % 14 AS STRING) AS engine, p_size"


@query("ingest_reference", f"""SELECT CAST(p_partkey AS STRING) AS code, p_brand AS manufacturer, p_name AS model,
  CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.AIRCRAFT_TYPE.items())} ELSE kind END AS aircraft_type,
  CASE engine {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ENGINE_TYPE.items())} ELSE engine END AS engine_type,
  CASE WHEN kind IN ('6', '9') THEN 'Helicopter' WHEN engine IN ('4', '5') THEN 'Jet' WHEN engine IN ('2', '3')
    THEN 'Turboprop' WHEN engine IN ('1', '7', '8') THEN 'Piston' WHEN engine = '10' THEN 'Electric' ELSE 'Other' END AS category,
  '02' AS num_engines, lpad(CAST(p_size AS STRING), 3, '0') AS num_seats FROM ({REFERENCE} FROM part) q""")
def _(t, spark):
    rows = spark.sql(REFERENCE + " FROM {part}", part=t.part)
    cells = [F.col("p_partkey").cast("string"), _padded("p_brand"), _padded("p_name"), F.col("kind"), F.col("engine"),
             F.lit("02"), F.lpad(F.col("p_size").cast("string"), 3, "0")]
    path = land_lines(rows, csv_line(*cells), scratch(spark, "reference"),
                      "CODE,MFR,MODEL,TYPE-ACFT,TYPE-ENG,NO-ENG,NO-SEATS")
    root = scratch(spark, "tables")
    ingest.ingest_reference(spark, path, root)
    return ingest.stored(root, "aircraft_ref").read(spark)


@query("ingest_reference_duplicates", "SELECT code, description FROM v_type_ref")
def _(t, spark):
    """A landing with a code twice, or without one, fails as a whole; the table keeps its rows."""
    root = scratch(spark, "tables")
    head, kept = "Code,Description", t.aircraft_type_ref
    ingest.ingest_aircraft_types(spark, land_lines(kept, csv_line(F.col("code"), F.col("description")), scratch(spark, "types"), head), root)
    twice = kept.unionByName(kept.limit(1)).withColumn("description", F.lit("other"))
    failed = 0
    try:
        ingest.ingest_aircraft_types(spark, land_lines(twice, csv_line(F.col("code"), F.col("description")), scratch(spark, "types"), head), root)
    except KeyViolation:
        failed = 1
    return ingest.stored(root, "aircraft_type_ref").read(spark).where(F.lit(failed) == 1)


@query("ingest_aircraft_types", "SELECT code, description FROM v_type_ref")
def _(t, spark):
    path = land_lines(t.aircraft_type_ref, csv_line(F.col("code"), F.col("description")), scratch(spark, "types"),
                      "Code,Description")
    root = scratch(spark, "tables")
    ingest.ingest_aircraft_types(spark, path, root)
    return ingest.stored(root, "aircraft_type_ref").read(spark)


BASE_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()),
                            T.StructField("measure", T.DecimalType(18, 2))])


def base_table(spark) -> store.StoredTable:
    return store.StoredTable(scratch(spark, "base"), BASE_SCHEMA, ("id",), buckets=8)


def doubled(df):
    return df.withColumn("measure", F.col("measure").cast("double"))


@query("replace_table", "SELECT id, label, measure::DOUBLE AS measure FROM v_delta")
def _(t, spark):
    table = base_table(spark)
    table.replace(t.v_base)
    return doubled(store.replace_table(t.v_delta, table))


UPSERTED = """SELECT coalesce(b.id, d.id) AS id, coalesce(b.label, d.label) AS label,
  coalesce(d.measure, b.measure)::DOUBLE AS measure FROM v_base b FULL OUTER JOIN v_delta d ON b.id = d.id"""


@query("upsert_partial", UPSERTED)
def _(t, spark):
    return doubled(U.upsert_partial(t.v_base, t.v_delta, ["id"], ["measure"]))


@query("upsert_stored", UPSERTED)
def _(t, spark):
    table = base_table(spark)
    table.replace(t.v_base)
    table.upsert(t.v_delta, ["measure"], order=["id"])
    return doubled(table.read(spark))


REPEATED = """SELECT id, label, measure::DOUBLE AS measure FROM (SELECT coalesce(b.id, d.id) AS id, coalesce(b.label, d.label) AS label,
  coalesce(d.measure + 2, b.measure) AS measure FROM v_base b FULL OUTER JOIN v_delta d ON b.id = d.id)"""


def thrice(t):
    """Every key of the batch three times, the newest with two more in its measure."""
    return t.v_delta.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(0)))).withColumn("measure", F.col("measure") + F.col("version"))


@query("upsert_repeated_keys", REPEATED)
def _(t, spark):
    table = base_table(spark)
    table.replace(t.v_base)
    table.upsert(thrice(t), ["measure"], order=[F.col("version").desc()])
    return doubled(table.read(spark))


def land_twice(rows, path: str) -> str:
    """Every row twice, both in one file."""
    rows.unionByName(rows).repartition("id").write.parquet(path)
    return path


@query("stream_upsert_renewed", UPSERTED)
def _(t, spark):
    """A second checkpoint numbers its batches from 0 again, with new data under them; repeated rows come in one file."""
    table = base_table(spark)
    table.replace(t.v_base)
    for part, odd in (("first", "id % 2 = 0"), ("second", "id % 2 <> 0")):
        landing = land_twice(t.v_delta.where(odd), scratch(spark, part))
        stream_upsert(spark, landing, BASE_SCHEMA, table, ["measure"], scratch(spark, "stream"), "delta", file_format="parquet").awaitTermination()
    return doubled(table.read(spark))


@query("stored_read_pruned", "SELECT id, label, measure::DOUBLE AS measure FROM v_base WHERE id % 10 = 3")
def _(t, spark):
    """The filter on the partition column reaches the list of files."""
    parted = T.StructType([*BASE_SCHEMA.fields, T.StructField("last_digit", T.IntegerType())])
    table = store.StoredTable(scratch(spark, "parted"), parted, ("id",), ("last_digit",))
    table.replace(t.v_base.withColumn("last_digit", (F.col("id") % 10).cast("int")))
    return doubled(table.read(spark).where("last_digit = 3").drop("last_digit"))


@query("stream_upsert", UPSERTED)
def _(t, spark):
    table = base_table(spark)
    table.replace(t.v_base)
    landing = scratch(spark, "landing")
    t.v_delta.repartitionByRange(6, "id").write.parquet(landing)
    checkpoint = scratch(spark, "stream")
    for _ in range(2):  # the second start finds nothing new
        stream_upsert(spark, landing, BASE_SCHEMA, table, ["measure"], checkpoint, "delta", file_format="parquet",
                      files_per_batch=2).awaitTermination()
    return doubled(table.read(spark))


MAIL_COLUMNS = ["id", "thread_id", "mailbox", "subject", "snippet", "labels"]


@query("upsert_mail", """SELECT coalesce(b.id, d.id) AS id, coalesce(b.thread_id, d.thread_id) AS thread_id,
  CASE WHEN d.id IS NOT NULL THEN d.mailbox ELSE b.mailbox END AS mailbox,
  CASE WHEN b.id IS NOT NULL THEN b.subject ELSE d.subject END AS subject, coalesce(d.snippet, b.snippet) AS snippet,
  CASE WHEN d.id IS NOT NULL THEN 'READ' ELSE 'INBOX' END AS labels
FROM v_emails b FULL OUTER JOIN (SELECT CAST(CAST(id AS BIGINT) * 2 AS STRING) AS id, thread_id, lang || '@new.example' AS
  mailbox, 'changed' AS subject, 'new ' || snippet AS snippet FROM v_emails) d ON b.id = d.id""")
def _(t, spark):
    base = t.v_emails.withColumn("labels", F.array(F.lit("INBOX"))).select(*MAIL_COLUMNS)
    news = t.v_emails.select(
        (F.col("id").cast("bigint") * 2).cast("string").alias("id"), "thread_id",
        F.concat("lang", F.lit("@new.example")).alias("mailbox"), F.lit("changed").alias("subject"),
        F.concat(F.lit("new "), "snippet").alias("snippet"), F.array(F.lit("READ")).alias("labels"))
    merged = U.upsert_partial(base, news, ["id"], S.UPDATE_COLUMNS["emails_domain_wide"])
    return merged.withColumn("labels", F.array_join("labels", ","))


@query("upsert_photos", """SELECT coalesce(b.n_number, d.n_number) AS n_number,
  CASE WHEN d.n_number IS NOT NULL THEN d.has_photo ELSE b.has_photo END AS has_photo,
  CASE WHEN d.n_number IS NOT NULL THEN NULL ELSE b.photo_id END AS photo_id,
  CASE WHEN d.n_number IS NOT NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE b.fetched_at END AS fetched_at
FROM v_photos b FULL OUTER JOIN (SELECT n_number, status_code <> 'V' AS has_photo FROM v_registry
  WHERE registrant_type <> '1') d ON b.n_number = d.n_number""")
def _(t, spark):
    base = t.aircraft_photos.select("n_number", "has_photo", "photo_id", "fetched_at")
    answers = t.faa_registry.select(
        "n_number", (F.col("status_code") != "V").alias("has_photo"), F.lit(None).cast("string").alias("photo_id"),
        (F.col("registrant_type") != "1").alias("fetched_ok"))
    fresh = U.photo_results(answers, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return U.upsert_all(base, fresh, ["n_number"])


@query("sync_dimension", """SELECT 'svc' || CAST(k AS STRING) AS name, coalesce(s.display_name, j.display_name) AS display_name,
  CASE WHEN s.name IS NOT NULL THEN s.category ELSE j.category END AS category,
  coalesce(j.interval_seconds, s.interval_seconds) AS interval_seconds, coalesce(j.enabled, s.enabled) AS enabled
FROM (SELECT n_nationkey AS k FROM nation UNION SELECT n_nationkey * 2 FROM nation) keys
  LEFT JOIN v_jobs j ON j.name = 'svc' || CAST(k AS STRING)
  LEFT JOIN (SELECT 'svc' || CAST(n_nationkey * 2 AS STRING) AS name, 'New ' || n_name AS display_name, 'integration' AS category,
    n_nationkey AS interval_seconds, true AS enabled FROM nation) s ON s.name = 'svc' || CAST(k AS STRING)""")
def _(t, spark):
    columns = ["name", "display_name", "category", "interval_seconds", "enabled"]
    specs = t.nation.select(
        F.concat(F.lit("svc"), (F.col("n_nationkey") * 2).cast("string")).alias("name"),
        F.concat(F.lit("New "), "n_name").alias("display_name"), F.lit("integration").alias("category"),
        F.col("n_nationkey").alias("interval_seconds"), F.lit(True).alias("enabled"))
    return U.upsert_partial(t.services.select(*columns), specs, ["name"], ["display_name", "category"])


@query("load_report", """SELECT 'faa_airport_detail' AS table, count(*) AS rows, count(*) FILTER (WHERE based_jet > 0) AS
  airports_with_jets, CAST(coalesce(sum(based_jet), 0) AS BIGINT) AS total_based_jets FROM v_detail""".replace("AS table,", 'AS "table",'))
def _(t, spark):
    jets = F.col("based_jet")
    return store.load_report("faa_airport_detail", t.faa_airport_detail, airports_with_jets=F.count_if(jets > 0),
                             total_based_jets=F.coalesce(F.sum(jets), F.lit(0)).cast("bigint"))


@query("register_views", """SELECT c.operator_name, count(*) AS tails, count(*) FILTER (WHERE c.mode_s_hex <> '') AS ready
FROM (SELECT o.operator_name, r.mode_s_hex FROM v_link p JOIN v_operators o USING (certificate_designator)
  LEFT JOIN v_registry r USING (n_number)) c GROUP BY c.operator_name""")
def _(t, spark):
    store.register_views(t, ["charter_fleet", "airport_capability", "charter_routes"])
    return spark.sql("SELECT operator_name, count(*) AS tails, count(*) FILTER (WHERE mode_s_hex <> '') AS ready "
                     "FROM charter_fleet GROUP BY operator_name")


@query("ingest_photos", """SELECT n_number, CASE WHEN has_photo THEN photo_id END AS photo_id, has_photo,
  CASE WHEN has_photo THEN '/photos/' || n_number || '.jpg' END AS local_path,
  CASE WHEN has_photo THEN photographer END AS photographer FROM v_photos WHERE n_number IN (SELECT n_number FROM v_registry
  WHERE status_code <> 'V')""")
def _(t, spark):
    landing, root = scratch(spark, "photos"), scratch(spark, "tables")
    photo = F.struct(F.col("photo_id").alias("id"), F.col("page_link").alias("link"), "photographer",
                     F.struct(F.col("thumbnail_url").alias("src")).alias("thumbnail"))
    photos = F.when(F.col("has_photo"), F.array(photo)).otherwise(F.slice(F.array(photo), 1, 0))
    fetched = t.faa_registry.select("n_number", F.when(F.col("status_code") != "V", 200).otherwise(429).alias("status"))
    (t.aircraft_photos.join(fetched, "n_number")
     .select("n_number", "status", F.to_json(F.struct(photos.alias("photos"))).alias("body")).write.json(landing))
    ingest.ingest_photos(spark, landing, root)
    return ingest.stored(root, "aircraft_photos").read(spark).select("n_number", "photo_id", "has_photo", "local_path",
                                                                     "photographer")


@query("ingest_mailboxes", f"""SELECT id, mailbox, from_addr, from_name, subject, 'new ' || snippet AS snippet,
  trim(body, {WS}) AS body FROM v_emails WHERE mailbox IS NOT NULL""")
def _(t, spark):
    landing, root = scratch(spark, "mail"), scratch(spark, "tables")
    held = t.v_emails.where("mailbox IS NOT NULL")

    def message(rows):
        sender = F.when(F.col("from_name") == "", F.col("from_addr")).otherwise(
            F.concat("from_name", F.lit(" <"), "from_addr", F.lit(">")))
        named = F.array(F.struct(F.lit("From").alias("name"), sender.alias("value")),
                        F.struct(F.lit("Subject").alias("name"), F.col("subject").alias("value")))
        body = F.struct(F.replace(F.base64(F.encode("body", "UTF-8")), F.lit("\r\n"), F.lit("")).alias("data"))
        payload = F.struct(F.lit("text/plain").alias("mimeType"), named.alias("headers"), body.alias("body"))
        return rows.select(F.to_json(F.struct("id", F.col("thread_id").alias("threadId"), "snippet",
                                              payload.alias("payload"))).alias("value"), "mailbox")

    message(held).write.partitionBy("mailbox").option("compression", "gzip").text(landing)
    ingest.ingest_mailboxes(spark, landing, root)
    again = scratch(spark, "mail")
    changed = held.withColumn("snippet", F.concat(F.lit("new "), "snippet")).withColumn("subject", F.lit("other"))
    message(changed).write.partitionBy("mailbox").option("compression", "gzip").text(again)
    ingest.ingest_mailboxes(spark, again, root)
    return ingest.stored(root, "emails").read(spark).select("id", "mailbox", "from_addr", "from_name", "subject", "snippet",
                                                            "body")
