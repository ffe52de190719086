"""Cleaning and decoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspine import schemas as S
from skyspine.functions import clean as C
from skyspine.functions import decode as D
from skyspine.functions import fixed_values as V
from skyspine.operators import keys as K
from skyspine.workload.fleet import OWNER_TYPE_SQL, STATUS_SQL, TIER_SQL
from skyspine.workload.registry import query

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160)"

MESSY_TAIL = """concat(chr(9), CASE o_orderkey % 4 WHEN 0 THEN lower(CAST(o_orderkey AS STRING) || 'hl')
  WHEN 1 THEN 'N' || CAST(o_orderkey AS STRING) WHEN 2 THEN 'nN' || CAST(o_orderkey AS STRING) ELSE '' END, ' ')"""


@query("norm_tail", f"""SELECT o_orderkey, CASE WHEN trim(m, {WS}) = '' THEN '' ELSE 'N' || ltrim(upper(trim(m, {WS})), 'N') END
  AS n_number FROM (SELECT o_orderkey, {MESSY_TAIL} AS m FROM orders) q""")
def _(t, spark):
    return t.orders.select("o_orderkey", C.norm_tail(F.expr(MESSY_TAIL.replace("chr(9)", "'\\t'"))).alias("n_number"))


@query("strip_all", f"""SELECT doc_id, trim(text, {WS}) AS text, trim(concat(chr(9), source, chr(10)), {WS}) AS source,
  trim(lang, {WS}) AS lang FROM documents""")
def _(t, spark):
    rows = t.documents.select("doc_id", "text", F.concat(F.lit("\t"), "source", F.lit("\n")).alias("source"), "lang")
    return C.strip_all(rows)


@query("blank_to_null", "SELECT n_number, certificate_designator, NULLIF(make_model_series, '') AS model FROM v_link")
def _(t, spark):
    return t.part135_aircraft.select("n_number", "certificate_designator",
                                     C.blank_to_null(F.col("make_model_series")).alias("model"))


YES_NO_TEXT = "CASE o_orderkey % 7 WHEN 0 THEN ' Yes' WHEN 1 THEN '1' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'no' " \
              "WHEN 4 THEN '0 ' WHEN 5 THEN o_orderstatus ELSE '' END"


@query("yes_no", f"""SELECT o_orderkey, CASE WHEN lower(trim(f)) IN ('yes', '1', 'true') THEN true
  WHEN lower(trim(f)) IN ('no', '0', 'false') THEN false END AS flag FROM (SELECT o_orderkey, {YES_NO_TEXT} AS f FROM orders) q""")
def _(t, spark):
    return t.orders.select("o_orderkey", C.yes_no(F.expr(YES_NO_TEXT)).alias("flag"))


INT_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') WHEN 1 THEN '' " \
           "WHEN 2 THEN '1a' WHEN 3 THEN '-1' ELSE CAST(o_custkey AS STRING) END"


@query("int_or_zero", f"""SELECT o_orderkey, CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(x AS INTEGER) ELSE 0 END AS n
FROM (SELECT o_orderkey, {INT_TEXT} AS x FROM orders) q""")
def _(t, spark):
    return t.orders.select("o_orderkey", C.int_or_zero(F.expr(INT_TEXT)).alias("n"))


@query("drop_blank_key", f"""SELECT id, le_ident, he_ident FROM v_runways WHERE trim(le_ident, {WS}) <> ''""")
def _(t, spark):
    return C.drop_blank_key(t.runways, "le_ident").select("id", "le_ident", "he_ident")


@query("upper_code", "SELECT s_suppkey, upper(s_name) AS code FROM supplier")
def _(t, spark):
    return t.supplier.select("s_suppkey", C.upper_code(F.col("s_name")).alias("code"))


@query("truncate_text", "SELECT doc_id, substr(text, 1, 8000) AS message, substr(text, 1, 2000) AS error FROM documents")
def _(t, spark):
    return t.documents.select("doc_id", C.truncate_text(F.col("text"), V.LOG_MESSAGE_CHARS).alias("message"),
                              C.truncate_text(F.col("text"), V.JOB_ERROR_CHARS).alias("error"))


@query("first_nonblank", """SELECT ident, coalesce(NULLIF(icao_code, ''), ident) AS station,
  coalesce(NULLIF(local_code, ''), NULLIF(iata_code, ''), gps_code) AS code FROM v_airports""")
def _(t, spark):
    return t.airports.select("ident", C.first_nonblank(F.col("icao_code"), F.col("ident")).alias("station"),
                             C.first_nonblank(F.col("local_code"), F.col("iata_code"), F.col("gps_code")).alias("code"))


@query("keep_first", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (SELECT *,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) q WHERE rn = 1""")
def _(t, spark):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return K.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


TRAFFIC_KEYS = S.KEYS["t100_segment"]


@query("keep_first_eight_keys", f"""SELECT {', '.join(TRAFFIC_KEYS)}, departures::DOUBLE AS departures,
  distance::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(TRAFFIC_KEYS)}
  ORDER BY distance, passengers) AS rn FROM v_t100) q WHERE rn = 1""")
def _(t, spark):
    first = K.keep_first(t.t100_segment, TRAFFIC_KEYS, ["distance", "passengers"])
    return first.select(*TRAFFIC_KEYS, F.col("departures").cast("double").alias("departures"),
                        F.col("distance").cast("double").alias("distance"))


@query("insert_if_absent", """SELECT CAST(s_suppkey AS BIGINT) AS key, s_name AS label FROM supplier UNION ALL
SELECT l_suppkey * 2, label FROM (SELECT l_suppkey, concat('line ', CAST(min(l_orderkey) AS STRING)) AS label FROM lineitem
  GROUP BY l_suppkey) q WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)""")
def _(t, spark):
    target = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("label"))
    batch = t.lineitem.select((F.col("l_suppkey") * 2).alias("key"), "l_orderkey",
                              F.concat(F.lit("line "), F.col("l_orderkey").cast("string")).alias("label"))
    return K.insert_if_absent(target, batch, ["key"], ["l_orderkey"])


CELL_TEXTS = "SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END " \
             "AS length_ft, CASE WHEN o_orderkey % 3 = 0 THEN 'true' WHEN o_orderkey % 3 = 1 THEN 'false' ELSE '' END AS closed, " \
             "o_orderstatus AS surface"
CELL_DDL = "id BIGINT, length_ft INT, closed BOOLEAN, surface STRING"


@query("typed_load", f"""SELECT CAST(id AS BIGINT) AS id, CAST(NULLIF(length_ft, '') AS INTEGER) AS length_ft,
  CAST(NULLIF(closed, '') AS BOOLEAN) AS closed, surface FROM ({CELL_TEXTS} FROM orders) q""")
def _(t, spark):
    texts = spark.sql(CELL_TEXTS + " FROM {orders}", orders=t.orders)
    return K.typed_load(texts, S.T.StructType.fromDDL(CELL_DDL))


@query("typed_load_quarantine", """SELECT o_orderkey AS id, TRY_CAST(x AS INTEGER) AS length_ft,
  CASE WHEN TRY_CAST(x AS INTEGER) IS NULL THEN 'length_ft' ELSE '' END AS bad FROM (SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE CAST(o_custkey AS STRING) END AS x FROM orders) q""")
def _(t, spark):
    texts = t.orders.select(F.col("o_orderkey").cast("string").alias("id"),
                            F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
                            .otherwise(F.col("o_custkey").cast("string")).alias("length_ft"))
    loaded = K.typed_load(texts, S.T.StructType.fromDDL("id BIGINT, length_ft INT"), strict=False)
    good = K.accepted(loaded).withColumn("bad", F.lit(""))
    return good.unionByName(K.rejects(loaded).select("id", "length_ft", F.array_join("_bad_cells", ",").alias("bad")))


@query("check_keys", """WITH d AS (SELECT CAST(l_orderkey AS STRING) || '|' || CAST(l_linenumber AS STRING) AS key_text,
    count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1),
  o AS (SELECT CAST(o_custkey AS STRING) AS key_text, count(*) AS n FROM orders WHERE o_custkey NOT IN
    (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey),
  m AS (SELECT ident AS key_text, count(*) AS n FROM v_airports WHERE iata_code IS NULL GROUP BY ident)
SELECT 'duplicate' AS violation, * FROM d UNION ALL SELECT 'no parent o_custkey', * FROM o
UNION ALL SELECT 'null iata_code', * FROM m""")
def _(t, spark):
    lines = K.check_keys(t.lineitem, ["l_orderkey", "l_linenumber"])
    orders = K.check_keys(t.orders, ["o_orderkey"], t.lineitem, {"o_custkey": "l_orderkey"})
    airports = K.check_keys(t.airports, ["ident"], not_null=["iata_code"])
    return lines.unionByName(orders).unionByName(airports)


@query("check_keys_bars", """SELECT 'duplicate' AS violation, a || '|' || b AS key_text, count(*) AS n
FROM (SELECT l_returnflag || '|' || l_linestatus AS a, CAST(l_linenumber AS STRING) || '|' || CAST(l_suppkey % 7 AS STRING) AS b FROM lineitem) k GROUP BY a, b HAVING count(*) > 1
UNION ALL SELECT 'duplicate', a || '|' || b, count(*) FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '1|2' END AS a,
  CASE WHEN n_nationkey % 2 = 0 THEN '2|3' ELSE '3' END AS b FROM nation) z GROUP BY a, b HAVING count(*) > 1""")
def _(t, spark):
    """Bars inside keys make no two keys one."""
    bar = F.lit("|")
    lines = t.lineitem.select(F.concat("l_returnflag", bar, "l_linestatus").alias("a"),
                              F.concat(F.col("l_linenumber").cast("string"), bar, (F.col("l_suppkey") % 7).cast("string")).alias("b"))
    even = F.col("n_nationkey") % 2 == 0
    nations = t.nation.select(F.when(even, "1").otherwise("1|2").alias("a"), F.when(even, "2|3").otherwise("3").alias("b"))
    return K.check_keys(lines, ["a", "b"]).unionByName(K.check_keys(nations, ["a", "b"]))


def _case(table: dict, code: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {code} END"


CODES = "SELECT p_partkey, CAST(p_size % 13 AS STRING) AS kind, CAST(p_partkey % 14 AS STRING) AS engine"


@query("decode_passthrough", f"""SELECT p_partkey, {_case(V.AIRCRAFT_TYPE, 'kind')} AS aircraft_type,
  {_case(V.ENGINE_TYPE, 'engine')} AS engine_type FROM ({CODES} FROM part) q""")
def _(t, spark):
    rows = spark.sql(CODES + " FROM {part}", part=t.part)
    return rows.select("p_partkey", D.decode_passthrough(V.AIRCRAFT_TYPE, F.col("kind")).alias("aircraft_type"),
                       D.decode_passthrough(V.ENGINE_TYPE, F.col("engine")).alias("engine_type"))


@query("classify_category", f"""SELECT p_partkey, CASE WHEN kind IN ('6', '9') THEN 'Helicopter'
  WHEN engine IN ('4', '5') THEN 'Jet' WHEN engine IN ('2', '3') THEN 'Turboprop' WHEN engine IN ('1', '7', '8')
  THEN 'Piston' WHEN engine = '10' THEN 'Electric' ELSE 'Other' END AS category FROM ({CODES} FROM part) q""")
def _(t, spark):
    rows = spark.sql(CODES + " FROM {part}", part=t.part)
    return rows.select("p_partkey", D.classify_category(F.col("kind"), F.col("engine")).alias("category"))


@query("decode_default", f"SELECT n_number, {OWNER_TYPE_SQL} AS owner_type FROM v_registry")
def _(t, spark):
    return t.faa_registry.select("n_number", D.owner_type(F.col("registrant_type")).alias("owner_type"))


@query("decode_tiered", f"SELECT n_number, {STATUS_SQL} AS status, {TIER_SQL} AS tier FROM v_registry")
def _(t, spark):
    return t.faa_registry.select("n_number", D.status_label(F.col("status_code")).alias("status"),
                                 D.status_tier(F.col("status_code")).alias("tier"))


@query("parse_seats", """SELECT code, NULLIF(TRY_CAST(regexp_extract(num_seats, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS seats,
  NULLIF(TRY_CAST(regexp_extract(model || num_seats, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS none FROM v_ref""")
def _(t, spark):
    return t.aircraft_ref.select("code", D.parse_seats(F.col("num_seats")).alias("seats"),
                                 D.parse_seats(F.concat("model", "num_seats")).alias("none"))


@query("format_interval", """SELECT o_orderkey, CASE WHEN s % 604800 = 0 THEN CAST(s // 604800 AS STRING) || 'w'
  WHEN s % 86400 = 0 THEN CAST(s // 86400 AS STRING) || 'd' WHEN s % 3600 = 0 THEN CAST(s // 3600 AS STRING) || 'h'
  WHEN s % 60 = 0 THEN CAST(s // 60 AS STRING) || 'm' ELSE CAST(s AS STRING) || 's' END AS every
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderkey ELSE o_orderkey * 1800 END AS s FROM orders) q""")
def _(t, spark):
    s = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).otherwise(F.col("o_orderkey") * 1800)
    return t.orders.select("o_orderkey", D.format_interval(s).alias("every"))


AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


@query("age_text", f"""SELECT event_id, CASE WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || 's ago'
  WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
  ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS age
FROM (SELECT event_id, (epoch_us({AS_OF}) - epoch_us(ts)) / 1000000.0::DOUBLE AS s FROM events) q""")
def _(t, spark):
    return t.events.select("event_id", D.age_text(F.col("ts"), F.lit("2024-01-31 00:00:00")).alias("age"))


@query("whole_number", "SELECT event_id, CAST(floor(value - 25 + 0.5) AS BIGINT) AS n, CAST(floor((event_id - 50) / 2.0 + 0.5) AS BIGINT) AS half FROM events")
def _(t, spark):
    return t.events.select("event_id", D.whole_number(F.col("value") - 25).alias("n"),
                           D.whole_number((F.col("event_id") - 50) / 2).alias("half"))


@query("latest_cycle", """SELECT o_orderkey, CASE WHEN later <= pick THEN later WHEN day <= pick THEN day ELSE later END AS cycle
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  strftime(o_orderdate + to_days(CAST(o_orderkey % 60 + 1 AS INTEGER)), '%Y-%m-%d') AS later,
  strftime(o_orderdate + to_days(CAST(o_orderkey % 50 - 5 AS INTEGER)), '%Y-%m-%d') AS pick FROM orders) q""")
def _(t, spark):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    later = F.date_format(F.date_add(F.col("o_orderdate"), (F.col("o_orderkey") % 60 + 1).cast("int")), "yyyy-MM-dd")
    as_of = F.date_add(F.col("o_orderdate"), (F.col("o_orderkey") % 50 - 5).cast("int"))
    page = F.concat(F.lit('<a href="/x/NASR_Subscription/'), day, F.lit('">a</a> <a href="NASR_Subscription/'), later,
                    F.lit('"> NASR_Subscription/'), day, F.lit(" NASR_Subscription/bad"))
    return t.orders.select("o_orderkey", D.latest_cycle(page, as_of).alias("cycle"))


@query("result_json", """SELECT l_suppkey, '{"rows":' || CAST(count(*) AS STRING) || ',"table":"lineitem"}' AS result
FROM lineitem GROUP BY l_suppkey""")
def _(t, spark):
    sums = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return sums.select("l_suppkey", D.result_json(rows=F.col("n"), table=F.lit("lineitem")).alias("result"))
