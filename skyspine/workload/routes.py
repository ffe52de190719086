"""Charter traffic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyspine.functions import decode as D
from skyspine.operators import filters, traffic
from skyspine.plans import routes as plans
from skyspine.workload.registry import query

MEASURES = ["departures", "passengers", "seats", "distance"]


def as_double(df, *names):
    return df.select(*[F.col(c).cast("double").alias(c) if c in (names or MEASURES) else F.col(c) for c in df.columns])


#: Segments of the classes that have a name here.
ROUTES = """(SELECT v_t100.*, CASE class WHEN 'L' THEN 'Non-sched pax/cargo' WHEN 'P' THEN 'Non-sched all-cargo' END AS class_desc
  FROM v_t100 WHERE class IN ('L', 'P'))"""


@query("charter_routes", f"""SELECT year, month, unique_carrier, carrier_name, origin, origin_city, origin_state, dest, dest_city, dest_state,
  aircraft_type, aircraft_config, departures::DOUBLE AS departures, seats::DOUBLE AS seats, passengers::DOUBLE AS passengers,
  distance::DOUBLE AS distance, class_desc FROM {ROUTES}""")
def _(t, spark):
    return as_double(traffic.charter_routes(t))


@query("class_desc", """SELECT unique_carrier, class, CASE class WHEN 'L' THEN 'Non-sched pax/cargo'
  WHEN 'P' THEN 'Non-sched all-cargo' END AS class_desc FROM v_t100""")
def _(t, spark):
    return t.t100_segment.select("unique_carrier", "class", D.class_desc(F.col("class")).alias("class_desc"))


#: Summed per period first; a route's periods are then the rows left, its measures sums of sums.
TOTALS = """SELECT unique_carrier, carrier_name, origin, regexp_extract(origin_city, '^[^,]*') AS origin_city, origin_state, dest,
  regexp_extract(dest_city, '^[^,]*') AS dest_city, dest_state, departures, passengers, distance, months
FROM (SELECT unique_carrier, carrier_name, origin, origin_city, origin_state, dest, dest_city, dest_state, sum(d)::DOUBLE AS departures,
    sum(p)::DOUBLE AS passengers, round(max(far))::DOUBLE AS distance, count(*) AS months
  FROM (SELECT unique_carrier, carrier_name, origin, origin_city, origin_state, dest, dest_city, dest_state, year, month,
      sum(departures) AS d, sum(passengers) AS p, max(distance) AS far
    FROM {source} r {where} GROUP BY ALL) periods
  GROUP BY ALL) totals
WHERE departures > 0"""


@query("route_totals", TOTALS.format(source=ROUTES, where=""))
def _(t, spark):
    return as_double(traffic.route_totals(traffic.charter_routes(t)))


@query("charter_route_list", TOTALS.format(source=ROUTES, where="WHERE carrier_name ILIKE '%00%' AND origin = 'O3'") + """
ORDER BY departures DESC, unique_carrier NULLS LAST, origin NULLS LAST, dest NULLS LAST, carrier_name NULLS LAST,
  totals.origin_city NULLS LAST, totals.dest_city NULLS LAST LIMIT 300""")
def _(t, spark):
    return as_double(plans.charter_route_list(t, q="00", origin="o3"))


@query("optional_filters_routes", TOTALS.format(source=ROUTES, where="WHERE dest = 'D4'"))
def _(t, spark):
    rows = filters.optional_filters(traffic.charter_routes(t), (None, F.lit(False)), ("D4", F.col("dest") == "D4"))
    return as_double(traffic.route_totals(rows))


SUMMARY = """SELECT unique_carrier, origin, dest, newest[3] AS carrier_name, split_part(newest[4], ',', 1) AS origin_city,
  newest[5] AS origin_state, split_part(newest[6], ',', 1) AS dest_city, newest[7] AS dest_state, departures, passengers, seats,
  distance, months FROM (SELECT unique_carrier, origin, dest,
    max(row(year, month, carrier_name, origin_city, origin_state, dest_city, dest_state)) AS newest,
    sum(departures)::DOUBLE AS departures, sum(passengers)::DOUBLE AS passengers, sum(seats)::DOUBLE AS seats,
    round(max(distance))::DOUBLE AS distance, count(DISTINCT (year, month)) AS months
  FROM {source} GROUP BY unique_carrier, origin, dest) sums"""


@query("route_summary", SUMMARY.format(source=ROUTES))
def _(t, spark):
    return as_double(traffic.route_summary(traffic.charter_routes(t)))


BY_CODE = """SELECT code, ident, name FROM (SELECT code, ident, name, row_number() OVER (PARTITION BY code
    ORDER BY coalesce(type = 'large_airport', false) DESC, ident NULLS LAST) AS rn
  FROM (SELECT iata_code AS code, ident, name, type FROM v_airports WHERE iata_code <> ''
    UNION ALL SELECT local_code, ident, name, type FROM v_airports WHERE local_code <> '') u) n WHERE rn = 1"""


@query("charter_route_detail", f"""WITH s AS ({SUMMARY.format(source=ROUTES)}), b AS ({BY_CODE})
SELECT s.*, round(passengers / NULLIF(departures, 0), 1) AS pax_per_departure, o.ident AS origin_ident,
  o.name AS origin_airport, d.ident AS dest_ident, d.name AS dest_airport
FROM s LEFT JOIN b o ON o.code = s.origin LEFT JOIN b d ON d.code = s.dest""")
def _(t, spark):
    return as_double(plans.charter_route_detail(t))


@query("charter_route_months", f"""SELECT unique_carrier, origin, dest, year, month,
  sum(departures)::DOUBLE AS departures, sum(seats)::DOUBLE AS seats, sum(passengers)::DOUBLE AS passengers,
  (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month] || ' ' || year AS period
FROM {ROUTES} WHERE unique_carrier = '7' GROUP BY unique_carrier, origin, dest, year, month""")
def _(t, spark):
    return as_double(plans.charter_route_months(t, carrier="7"))


@query("route_monthly", f"""SELECT unique_carrier, origin, dest, year, month, sum(departures)::DOUBLE AS departures,
  sum(seats)::DOUBLE AS seats, sum(passengers)::DOUBLE AS passengers
FROM {ROUTES} GROUP BY unique_carrier, origin, dest, year, month""")
def _(t, spark):
    return as_double(traffic.route_monthly(traffic.charter_routes(t)))


#: Summed per code first, then named by a look-up.
MIX = """SELECT totals.*, {name} AS aircraft_name
FROM (SELECT unique_carrier, origin, dest, aircraft_type, sum(departures)::DOUBLE AS departures, sum(passengers)::DOUBLE AS passengers
  FROM {source} GROUP BY ALL) totals"""
NAMED = "(SELECT any_value(description) FROM v_type_ref WHERE code = lpad(totals.aircraft_type, 3, '0'))"


@query("route_aircraft_mix", MIX.format(source=ROUTES, name=NAMED))
def _(t, spark):
    return as_double(traffic.route_aircraft_mix(traffic.charter_routes(t), t.aircraft_type_ref))


@query("charter_route_aircraft", MIX.format(source=ROUTES, name=f"coalesce({NAMED}, '—')"))
def _(t, spark):
    return as_double(plans.charter_route_aircraft(t))


def report_part(section: str, rows: str, **values: str) -> str:
    """One section of the report; what it lacks is NULL."""
    kinds = {"year": "INTEGER", "month": "INTEGER", "seats": "DOUBLE", "distance": "DOUBLE", "months": "BIGINT", "pax_per_departure": "DOUBLE"}
    names = ["carrier_name", "origin_city", "origin_state", "dest_city", "dest_state", "year", "month", "aircraft_type", "seats", "distance",
             "months", "pax_per_departure", "period", "aircraft_name", "origin_ident", "origin_airport", "dest_ident", "dest_airport"]
    cells = [f"{values[n]} AS {n}" if n in values else f"CAST(NULL AS {kinds.get(n, 'VARCHAR')}) AS {n}" for n in names]
    return f"SELECT '{section}' AS section, unique_carrier, origin, dest, departures, passengers, {', '.join(cells)} FROM ({rows}) {section}_rows"


REPORT_SUMMARY = f"""WITH s AS ({SUMMARY.format(source=ROUTES)}), b AS ({BY_CODE})
SELECT s.*, round(passengers / NULLIF(departures, 0), 1) AS pax_per_departure, o.ident AS origin_ident, o.name AS origin_airport,
  d.ident AS dest_ident, d.name AS dest_airport
FROM s LEFT JOIN b o ON o.code = s.origin LEFT JOIN b d ON d.code = s.dest"""
REPORT_MONTHS = f"""SELECT unique_carrier, origin, dest, year, month, sum(departures)::DOUBLE AS departures, sum(seats)::DOUBLE AS seats,
  sum(passengers)::DOUBLE AS passengers, (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month] || ' ' || year AS period
FROM {ROUTES} GROUP BY unique_carrier, origin, dest, year, month"""


@query("charter_route_report", " UNION ALL ".join([
    report_part("summary", REPORT_SUMMARY, **{n: n for n in (
        "carrier_name", "origin_city", "origin_state", "dest_city", "dest_state", "seats", "distance", "months", "pax_per_departure",
        "origin_ident", "origin_airport", "dest_ident", "dest_airport")}),
    report_part("month", REPORT_MONTHS, year="year", month="month", seats="seats", period="period"),
    report_part("aircraft", MIX.format(source=ROUTES, name=f"coalesce({NAMED}, '—')"), aircraft_type="aircraft_type", aircraft_name="aircraft_name")]))
def _(t, spark):
    return as_double(plans.charter_route_report(t))


@query("decode_join", """SELECT year, month, unique_carrier, aircraft_type, atr.description AS aircraft_name
FROM v_t100 LEFT JOIN v_type_ref atr ON atr.code = lpad(aircraft_type, 3, '0')""")
def _(t, spark):
    rows = t.t100_segment.select("year", "month", "unique_carrier", "aircraft_type")
    return traffic.decode_join(rows, t.aircraft_type_ref)


@query("city_of", """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS head, split_part(o_orderpriority, ',', 1) AS city
FROM orders""")
def _(t, spark):
    return t.orders.select("o_orderkey", D.city_of(F.col("o_orderpriority"), "-").alias("head"),
                           D.city_of(F.col("o_orderpriority")).alias("city"))


@query("pad_code", """SELECT o_orderkey, lpad(CAST(o_custkey AS STRING), 3, '0') AS padded FROM orders""")
def _(t, spark):
    return t.orders.select("o_orderkey", D.pad_code(F.col("o_custkey").cast("string")).alias("padded"))


@query("period_label", """SELECT o_orderkey, (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])
  [month(o_orderdate)] || ' ' || year(o_orderdate) AS period FROM orders""")
def _(t, spark):
    return t.orders.select("o_orderkey", D.period_label(F.year("o_orderdate"), F.month("o_orderdate")).alias("period"))


@query("ratio", f"""SELECT unique_carrier, round(sum(passengers)::DOUBLE / NULLIF(sum(departures)::DOUBLE, 0), 1) AS ratio
FROM {ROUTES} GROUP BY unique_carrier""")
def _(t, spark):
    sums = traffic.charter_routes(t).groupBy("unique_carrier").agg(F.sum("passengers").alias("p"),
                                                                   F.sum("departures").alias("d"))
    return sums.select("unique_carrier", D.ratio(F.col("p"), F.col("d")).alias("ratio"))


@query("round_measure", """SELECT l_orderkey, l_partkey, round(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS whole
FROM lineitem""")
def _(t, spark):
    return t.lineitem.select("l_orderkey", "l_partkey", D.round_measure(F.col("l_extendedprice")).cast("double").alias("whole"))


@query("recent_periods", """SELECT o_orderkey, CAST(i AS BIGINT) AS place,
  CAST(year(date_trunc('month', o_orderdate) - to_months(CAST(i + 4 AS INTEGER))) AS BIGINT) AS year,
  CAST(month(date_trunc('month', o_orderdate) - to_months(CAST(i + 4 AS INTEGER))) AS BIGINT) AS month
FROM (SELECT o_orderkey, o_orderdate, unnest([0, 1, 2]) AS i FROM orders) u""")
def _(t, spark):
    rows = t.orders.select("o_orderkey", F.posexplode(D.recent_periods(F.col("o_orderdate"), 3)).alias("place", "p"))
    return rows.select("o_orderkey", F.col("place").cast("bigint").alias("place"),
                       F.col("p.year").cast("bigint").alias("year"), F.col("p.month").cast("bigint").alias("month"))
