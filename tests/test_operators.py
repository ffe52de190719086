"""Relational rules on small fixtures: null logic, null order, ties, spellings."""

import re

from pyspark.sql import functions as F

from skyspine.operators import airports as A
from skyspine.operators import filters, joblog, ordering, spine, traffic
from skyspine.plans import airports as airport_plans
from skyspine.tables import Tables

AIRPORT_DDL = ("ident STRING, type STRING, name STRING, latitude_deg DOUBLE, longitude_deg DOUBLE, elevation_ft INT, "
               "iso_country STRING, iso_region STRING, municipality STRING, icao_code STRING, iata_code STRING, local_code STRING")
RUNWAY_DDL = "id BIGINT, airport_ident STRING, length_ft INT, closed BOOLEAN"


def airport(ident, kind="large_airport", iata=None, local=None):
    return ident, kind, "Name " + ident, 1.0, 2.0, 3, "US", "US-NJ", "Town", None, iata, local


def airports(spark, rows, runways=()):
    return Tables.of(airports=spark.createDataFrame(rows, AIRPORT_DDL), runways=spark.createDataFrame(list(runways), RUNWAY_DDL))


def test_capability_counts_open_runways_only(spark):
    t = airports(spark, [airport("A"), airport("B"), airport("C")],
                 [(1, "A", 5000, False), (2, "A", 9000, True), (3, "A", 8000, None), (4, "A", None, False), (5, "B", 4000, None)])
    got = {r.ident: (r.longest_runway_ft, r.runway_count) for r in A.airport_capability(t).collect()}
    assert got == {"A": (5000, 2), "B": (None, 0), "C": (None, 0)}


def test_type_filter_drops_missing_types(spark):
    t = airports(spark, [airport("A"), airport("B", None), airport("C", "heliport"), airport("D", "small_airport")])
    assert sorted(r.ident for r in filters.exclude_types(t.airports).collect()) == ["A", "D"]
    found = airport_plans.airport_search(t, type="heliport")
    assert [r.ident for r in found.collect()] == ["C"]


def test_zero_threshold_is_no_filter(spark):
    t = airports(spark, [airport("A"), airport("B")], [(1, "A", 5000, False)])
    assert airport_plans.airport_search(t, min_runway=0).count() == 2
    assert [r.ident for r in airport_plans.airport_search(t, min_runway=1).collect()] == ["A"]


def test_best_airport(spark):
    t = airports(spark, [airport("B", "small_airport", "TEB", "X"), airport("C", "large_airport", None, "TEB"),
                         airport("A", "large_airport", "TEB", "TEB"), airport("D", None, "", None), airport("E", None, "ZZZ", "")])
    codes = spark.createDataFrame([("TEB",), ("X",), ("NONE",), ("",), ("ZZZ",)], "code STRING")
    got = {r.code: r.ident for r in A.best_airport(codes, t).collect()}
    assert got == {"TEB": "A", "X": "B", "NONE": None, "": None, "ZZZ": "E"}


def test_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id INT, v INT")
    def ids(*order):
        return [r.id for r in df.orderBy(*order).collect()]
    assert ids(ordering.up("v")) == [2, 3, 1]
    assert ids(ordering.down("v")) == [1, 3, 2]
    assert ids(ordering.down_nulls_last("v")) == [3, 2, 1]


def test_sort_by_any(spark):
    df = spark.createDataFrame([(1, "10", "b"), (2, "9", None), (3, "x", "a"), (4, "-1", "É"), (5, "2", "e")], "id INT, n STRING, s STRING")
    assert [r.id for r in ordering.sort_by_any(df, "n", "num", False, "id").collect()] == [4, 3, 5, 2, 1]
    assert [r.id for r in ordering.sort_by_any(df, "s", "str", False, "id").collect()] == [2, 3, 1, 5, 4]
    assert [r.id for r in ordering.sort_by_any(df, "n", "num", True, "id").collect()] == [1, 2, 5, 3, 4]


def test_page_caps(spark):
    df = spark.range(20)
    assert [r.id for r in ordering.page(df, [ordering.up("id")], 9, cap=3, offset=5).collect()] == [5, 6, 7]


TRAFFIC_DDL = ("year INT, month INT, unique_carrier STRING, carrier_name STRING, origin STRING, origin_city STRING, "
               "origin_state STRING, dest STRING, dest_city STRING, dest_state STRING, aircraft_type STRING, aircraft_config STRING, "
               "departures DECIMAL(18,2), seats DECIMAL(18,2), passengers DECIMAL(18,2), distance DECIMAL(18,2), class STRING")


def segment(year=2025, month=1, name="Air", city="Nice, FR", departures=1, distance="10.50", kind="L", aircraft="6"):
    from decimal import Decimal
    d = Decimal
    return (year, month, "C", name, "AAA", city, "S", "BBB", "Bonn, DE", "T", aircraft, "1", d(departures), d(8), d(5), d(distance), kind)


def routes(spark, *rows):
    return traffic.charter_routes(Tables.of(t100_segment=spark.createDataFrame(list(rows), TRAFFIC_DDL)))


def test_route_totals_group_on_the_raw_city(spark):
    df = routes(spark, segment(city="Nice, FR"), segment(city="Nice, XX", month=2), segment(city="Nice, FR", month=3, kind="F"),
                segment(city="Nice, FR", year=2024))
    rows = traffic.route_totals(df).collect()
    assert [r.origin_city for r in rows] == ["Nice", "Nice"]
    assert sorted((float(r.departures), r.months) for r in rows) == [(1.0, 1), (2.0, 2)]
    assert {float(r.distance) for r in rows} == {11.0}


def test_routes_without_departures_are_left_out(spark):
    assert traffic.route_totals(routes(spark, segment(departures=0))).count() == 0


def test_route_summary_takes_the_newest_labels(spark):
    df = routes(spark, segment(name="Old", year=2024, month=12), segment(name="New", month=1), segment(name="Older", year=2023))
    row = traffic.route_summary(df).first()
    assert (row.carrier_name, row.months, row.origin_city) == ("New", 3, "Nice")


def test_aircraft_mix_pads_the_code(spark):
    names = spark.createDataFrame([("006", "Six")], "code STRING, description STRING")
    rows = traffic.route_aircraft_mix(routes(spark, segment(aircraft="6"), segment(aircraft="77")), names).collect()
    assert sorted((r.aircraft_type, r.aircraft_name) for r in rows) == [("6", "Six"), ("77", None)]


RUN_DDL = "run_id BIGINT, service STRING, ts TIMESTAMP, status STRING, trigger STRING, error STRING, result STRING"


def test_run_ledger_and_status(spark):
    import datetime as dt
    at = lambda m, s=0: dt.datetime(2026, 1, 1, 0, m, s)
    events = spark.createDataFrame([
        (1, "a", at(0), "running", "manual", None, None), (1, "a", at(1, 30), "success", None, None, "{}"),
        (2, "a", at(5), "running", "schedule", None, None), (3, "b", at(2), "running", "schedule", None, None),
        (3, "b", at(3), "error", None, "x" * 9000, None)], RUN_DDL)
    ledger = {r.id: r for r in joblog.run_ledger(events).collect()}
    assert (ledger[1].status, ledger[1].duration_ms, ledger[1].trigger) == ("success", 90000, "manual")
    assert (ledger[2].status, ledger[2].finished_at, ledger[2].duration_ms) == ("running", None, None)
    assert ledger[3].status == "error" and len(ledger[3].error) == 8000
    jobs = spark.createDataFrame([("a", 60, True), ("b", 60, True), ("c", 60, True), ("d", 60, False)],
                                 "name STRING, interval_seconds INT, enabled BOOLEAN")
    got = {r.name: (r.shown_status, r.next_run_at) for r in joblog.job_status(jobs, joblog.run_ledger(events)).collect()}
    assert got == {"a": ("running", None), "b": ("error", at(4)), "c": ("idle", None), "d": ("paused", None)}


def test_share_of_max(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 9)], "k STRING, n BIGINT")
    assert {r.k: r.share for r in spine.share_of_max(df).collect()} == {"a": 33.3, "b": 0.0, "c": 100.0}
    empty = spine.share_of_max(df.where("n = 0"))
    assert [r.share for r in empty.collect()] == [0.0]


def test_profile_needs_a_registration_or_a_certificate(spark):
    links = spark.createDataFrame([("N1", "A", "s", "m"), ("N1", "B", "s", "m"), ("N2", "A", "s", "m")],
                                  "n_number STRING, certificate_designator STRING, serial_number STRING, make_model_series STRING")
    operators = spark.createDataFrame([("A", "Alpha", "135", "F"), ("B", "Beta", "135", "F")],
                                      "certificate_designator STRING, operator_name STRING, part STRING, fsdo STRING")
    registry = spark.createDataFrame([("N1", "C"), ("N3", None)], "n_number STRING, mfr_mdl_code STRING")
    reference = spark.createDataFrame([("C", "Lear", "35", "t", "e", "Jet", "2", "8")],
                                      "code STRING, manufacturer STRING, model STRING, aircraft_type STRING, engine_type STRING, "
                                      "category STRING, num_engines STRING, num_seats STRING")
    photos = spark.createDataFrame([("N1", True, "/p", "l", "x"), ("N2", False, None, None, None), ("N9", True, "/p", "l", "x")],
                                   "n_number STRING, has_photo BOOLEAN, local_path STRING, page_link STRING, photographer STRING")
    t = Tables.of(part135_aircraft=links, operators=operators, faa_registry=registry, aircraft_ref=reference, aircraft_photos=photos)
    rows = sorted((r.n_number, r.operator_name or "", r.registered, r.category, r.local_path) for r in spine.aircraft_profile(t).collect())
    assert rows == [("N1", "Alpha", True, "Jet", "/p"), ("N1", "Beta", True, "Jet", "/p"), ("N2", "Alpha", False, None, None),
                    ("N3", "", True, None, None)]
    backlog = [(r.n_number, r.is_jet) for r in spine.photo_backlog(t, 5).collect()]
    assert backlog == []


def test_log_search(spark):
    logs = spark.createDataFrame([(1, "2026-01-01", "a", "INFO", "Hello"), (2, "2026-01-02", "a", "ERROR", "hell"), (3, "2026-01-03", "b", "ERROR", "x")],
                                 "id BIGINT, ts STRING, service STRING, level STRING, message STRING")
    assert [r.id for r in joblog.search_logs(logs, q="HELL").collect()] == [2, 1]
    assert [r.id for r in joblog.search_logs(logs, level="error", service="b").collect()] == [3]
    assert [r.id for r in joblog.search_logs(logs, limit=1).collect()] == [3]


def test_unread(spark):
    df = spark.createDataFrame([(1, False), (2, None), (3, True)], "id INT, read BOOLEAN")
    assert joblog.unread_count(df).first().unread == 1


def test_filters(spark):
    df = spark.createDataFrame([("a", "b", True), (None, "a", False), ("c", None, None)], "x STRING, y STRING, f BOOLEAN")
    assert filters.search_any(df, "A", "x", "y").count() == 2
    assert filters.flag_filter(df, "f").count() == 1 and filters.flag_filter(df, "f", False).count() == 1
    assert filters.either_code(df, "a", "x", "y").count() == 2
    assert filters.optional_filters(df, (None, F.col("x") == "zzz"), ("", F.lit(False)), (0, F.lit(False))).count() == 3


def test_deep_pages_are_those_of_the_sorted_whole(spark):
    """Ties in the first column, nulls, and pages over range borders, at the end and beyond it."""
    rows = [(i, None if i % 97 == 0 else (i * 7919) % 50) for i in range(5000)]
    df = spark.createDataFrame(rows, "id INT, v INT").repartition(6)
    order = [ordering.down_nulls_last("v"), ordering.up("id")]
    whole = [r.id for r in df.orderBy(*order).collect()]
    for offset, limit in ((0, 3), (1234, 50), (2490, 1500), (4990, 50), (5000, 5), (6000, 5)):
        assert [r.id for r in ordering.deep_page(df, order, limit, offset).collect()] == whole[offset:offset + limit], offset


def test_far_offsets_sort_only_the_ranges_of_the_page(spark, monkeypatch):
    monkeypatch.setattr(ordering, "DEEP", 1_000_000)
    df = spark.range(1_200_000).select((F.col("id") * 7919 % 1_200_007).alias("id"))
    got = ordering.page(df, [ordering.up("id")], 10, offset=1_000_000)
    want = sorted(i * 7919 % 1_200_007 for i in range(1_200_000))[1_000_000:1_000_010]
    assert [r.id for r in got.collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and int(re.search(r"Offset (\d+)|offset=(\d+)", plan).group(1) or 0) < 400_000


def test_pages_after_a_key(spark):
    rows = [(i, None if i % 10 == 0 else i % 7) for i in range(200)]
    df = spark.createDataFrame(rows, "id INT, v INT")
    for descending in (False, True):
        for nulls_first in (False, True):
            keys = [ordering.Key("v", descending, nulls_first), ordering.Key("id")]
            whole = [tuple(r) for r in df.orderBy(*[k.order() for k in keys]).select("v", "id").collect()]
            got, after = [], None
            while True:
                part = [tuple(r) for r in ordering.page_after(df, keys, 33, after).select("v", "id").collect()]
                if not part:
                    break
                got, after = got + part, part[-1]
            assert got == whole


def test_stored_logs_open_the_newest_days(spark, folder):
    rows = [(i, f"2024-01-{1 + i // 100:02d} 0{i % 10}:00:00", "svc", 1, "error" if i % 100 == 7 else "info", f"m{i}") for i in range(3000)]
    logs = spark.createDataFrame(rows, "id LONG, ts STRING, service STRING, run_id LONG, level STRING, message STRING").withColumn("ts", F.col("ts").cast("timestamp"))
    joblog.append_log(logs, folder + "/logs")
    def days(df):
        """Folders that the scan of a collected frame opened."""
        df.collect()
        p = df._jdf.queryExecution().executedPlan()
        p = p.executedPlan() if "Adaptive" in p.getClass().getName() else p
        leaves = p.collectLeaves()
        return sum(leaves.apply(i).metrics().get("numPartitions").get().value() for i in range(leaves.size()))
    newest = joblog.search_stored_logs(spark, folder + "/logs", 50)
    assert days(newest) == 1
    assert [r.id for r in newest.collect()] == [r.id for r in joblog.search_logs(logs, 50).collect()]
    rare = joblog.search_stored_logs(spark, folder + "/logs", 5, level="error", q="m")
    assert days(rare) == 8 and [r.id for r in rare.collect()] == [2907, 2807, 2707, 2607, 2507]
    assert joblog.search_stored_logs(spark, folder + "/logs", 5, q="nothing").count() == 0
    joblog.append_log(logs.limit(3).withColumn("ts", F.lit(None).cast("timestamp")), folder + "/logs")
    untimed = joblog.search_stored_logs(spark, folder + "/logs", 2)
    assert [r.ts for r in untimed.collect()] == [None, None]


def test_route_report_moves_the_sections_once(spark):
    """Rows are exchanged when they are reduced and when the sections are formed, not once more for the distinct months."""
    from decimal import Decimal
    route = ("C", "Carrier", "AAA", "A, X", "S1", "BBB", "B, Y", "S2")
    rows = [(y, m, *route, kind, "1", 1, 2, 3, 4, "x") for y, m in ((2020, 1), (2020, 1), (2020, 2), (2021, 1), (2021, None), (None, None), (None, None))
            for kind in ("10", "11")]
    ddl = ("year BIGINT, month BIGINT, unique_carrier STRING, carrier_name STRING, origin STRING, origin_city STRING, origin_state STRING, dest STRING, "
           "dest_city STRING, dest_state STRING, aircraft_type STRING, aircraft_config STRING, departures INT, seats INT, passengers INT, "
           "distance DECIMAL(18,2), class_desc STRING")
    report = traffic.route_report(spark.createDataFrame([(*r[:15], Decimal(r[15]), r[16]) for r in rows], ddl))
    got = report.collect()
    assert sorted((r.section, r.months, r.departures) for r in got if r.section != "month") == [("aircraft", None, 7), ("aircraft", None, 7), ("summary", 5, 14)]
    assert sum(r.section == "month" for r in got) == 5
    assert report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
