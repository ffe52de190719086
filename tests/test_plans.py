"""Plans that must hold at scale, and results that must not depend on skew."""

import re

import pytest
from pyspark.sql import functions as F

from skyspine.operators import airports as A
from skyspine.operators import hazards as H
from skyspine.operators import keys as K
from skyspine.operators import joblog, spine, traffic
from skyspine.plans import airports, fleet, routes
from skyspine.standins import domain_tables
from skyspine.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return domain_tables(spark, SF)


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_needs_a_nested_loop(spark, no_broadcast):
    from skyspine import workload
    lazy = {k: q for k, q in workload.queries().items() if not re.match(
        r"ingest_|fleet_search_ingested|airport_weather_ingested|upsert_stored|stream_|replace_table|read_|load_periods|append_log|text_search_stored|filter_record|resolve|merge_pages", k)}
    assert len(lazy) > 140
    for key, q in lazy.items():
        p = plan(q(spark, SF))
        assert "CartesianProduct" not in p and "NestedLoop" not in p and "BatchEvalPython" not in p, key


def test_backlog_is_an_anti_join(t, no_broadcast):
    assert "LeftAnti" in plan(spine.photo_backlog(t))


def test_first_row_is_cut_before_the_exchange(spark):
    df = spark.read.parquet(SF + "/lineitem.parquet")
    p = plan(K.keep_first(df, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"]))
    assert re.search(r"Exchange hashpartitioning\(l_suppkey.*\n.*WindowGroupLimit .* Partial", p)


def test_nearby_limit_is_applied_before_the_exchange(t):
    stations = t.airports.select("ident", F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lon"))
    p = plan(H.nearby_reports(stations, t.pireps))
    assert re.search(r"Exchange hashpartitioning\(ident.*\n.*WindowGroupLimit .* Partial", p)


def test_pages_are_top_k(t):
    for df in (fleet.fleet_search(t, q="1"), routes.charter_route_list(t), fleet.operator_list(t)):
        assert "TakeOrderedAndProject" in plan(df)


def test_counts_come_before_joins(t, no_broadcast):
    """The runways are aggregated below the join, and once before the exchange."""
    p = plan(A.airport_capability(t))
    assert p.index("SortMergeJoin") < p.index("HashAggregate")
    assert p.count("partial_max(length_ft") == 1


def test_filters_and_columns_reach_the_scan(spark, folder, t):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    tables = {"t100_segment": folder + "/t100"}
    t.t100_segment.write.partitionBy("year", "month").parquet(tables["t100_segment"])
    stored = Tables.from_parquet(spark, tables)
    p = plan(traffic.route_monthly(traffic.charter_routes(stored).where("origin = 'O3' AND year = 1996")))
    assert re.search(r"PushedFilters: \[[^]]*In\(class, \[L,P\]\)", p) and "EqualTo(origin,O3)" in p
    assert re.search(r"PartitionFilters: \[[^]]*year", p)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "distance" not in schema and "carrier_name" not in schema


HOT_ROWS = 60000


@pytest.fixture(scope="module")
def hot(spark):
    """One operator holds a third of all tails, one airport a third of all runways."""
    i = F.col("id")
    links = spark.range(HOT_ROWS).select(
        F.concat(F.lit("N"), i.cast("string")).alias("n_number"),
        F.when(i % 3 == 0, F.lit("hot")).otherwise((i % 997).cast("string")).alias("certificate_designator"),
        F.concat(F.lit("S"), i.cast("string")).alias("serial_number"), F.lit("M").alias("make_model_series"))
    names = spark.range(997).select(F.col("id").cast("string").alias("certificate_designator")).union(
        spark.createDataFrame([("hot",)], "certificate_designator STRING"))
    operators = names.select("certificate_designator", F.concat(F.lit("Op "), "certificate_designator").alias("operator_name"),
                             F.lit("135").alias("part"), F.lit("F").alias("fsdo"))
    registry = spark.range(HOT_ROWS).select(
        F.concat(F.lit("N"), i.cast("string")).alias("n_number"), F.lit("C1").alias("mfr_mdl_code"),
        F.lit("A").alias("mode_s_hex"), F.lit("x").alias("registrant_name"), F.lit("7").alias("registrant_type"),
        F.lit("2000").alias("year_mfr"), F.lit("V").alias("status_code"))
    reference = spark.createDataFrame([("C1", "m", "35", "Jet", "a", "e", "8")],
                                      "code STRING, manufacturer STRING, model STRING, category STRING, aircraft_type STRING, "
                                      "engine_type STRING, num_seats STRING")
    return Tables.of(part135_aircraft=links, operators=operators, faa_registry=registry, aircraft_ref=reference)


def test_hot_operator_is_split(spark, hot, no_broadcast, folder):
    """With a hot key the join runs as a skew join, and the result is whole."""
    for name in ("part135_aircraft", "operators"):
        hot[name].write.parquet(f"{folder}/{name}")
    stored = Tables.from_parquet(spark, {n: f"{folder}/{n}" for n in ("part135_aircraft", "operators")})
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = K.parents_with_children(stored.operators, stored.part135_aircraft, ["certificate_designator"])
        assert rows.count() == HOT_ROWS
        joined = stored.part135_aircraft.join(stored.operators, "certificate_designator")
        joined.collect()
        assert "skew=true" in plan(joined)
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_hot_operator_totals(hot, no_broadcast):
    got = {r.certificate_designator: r.fleet_size for r in spine.operator_fleet_agg(hot).collect()}
    assert got["hot"] == HOT_ROWS // 3 and sum(got.values()) == HOT_ROWS
    assert spine.charter_fleet(hot).count() == HOT_ROWS
    assert [tuple(r) for r in spine.count_by_category(hot).collect()] == [("Jet", HOT_ROWS)]


def test_parents_with_children_is_the_left_join(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k STRING, v INT")
    children = spark.createDataFrame([("a", 10), ("a", 11), ("c", 12), (None, 13), ("z", 14)], "k STRING, w INT")
    got = sorted(tuple(r[c] for c in ("k", "v", "w")) for r in K.parents_with_children(parents, children, ["k"]).collect())
    want = sorted(tuple(r) for r in parents.join(children, "k", "left").select("k", "v", "w").collect())
    assert str(got) == str(want)


def test_one_station_does_not_form_the_newest_of_all(spark, no_broadcast, t):
    """Below each ranking of the newest report stands the semi join with the chosen station."""
    for branch in plan(airports.airport_weather(t, "A000003")).split("WindowGroupLimit [station")[1::2]:
        assert "LeftSemi" in branch
    assert plan(airports.airport_weather(t, "A000003")).count("LeftSemi") >= 2


def test_newest_and_summary_do_not_sort_raw_rows(spark, no_broadcast, t):
    assert "SortAggregate" not in plan(joblog.newest_per_key(t.metar, "station", "obs_time", "report_id"))
    assert "SortAggregate" not in plan(joblog.run_ledger(t.run_events))
    summary = plan(traffic.route_summary(traffic.charter_routes(t)))
    assert summary.rindex("HashAggregate") > summary.rindex("SortAggregate")  # the lowest aggregation is a hash


def scans(df):
    """Files and their stand-ins: the leaves of the optimized plan."""
    return len(re.findall(r"Relation \[", df._jdf.queryExecution().optimizedPlan().toString()))


def parquet_tables(spark, tmp, t, names):
    """The tables written as files, so that each leaf of a plan is one table."""
    for name in names:
        t[name].write.parquet(f"{tmp}/{name}")
    return Tables.from_parquet(spark, {name: f"{tmp}/{name}" for name in names})


@pytest.fixture(scope="module")
def files(spark, t):
    import tempfile
    return parquet_tables(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), t, [
        "operators", "part135_aircraft", "faa_registry", "aircraft_ref", "aircraft_photos", "t100_segment", "aircraft_type_ref", "airports", "emails"])


def test_profiles_read_each_table_once(files):
    p = spine.aircraft_profile(files)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Relation [") == 5


def test_profiles_hold_every_tail(spark):
    make = lambda rows, ddl: (lambda: spark.createDataFrame(rows, ddl))
    t = Tables({
        "aircraft_ref": make([("C1", "LEAR", "35", "a", "e", "Jet", "2", "8")], "code STRING, manufacturer STRING, model STRING, aircraft_type STRING, engine_type STRING, category STRING, num_engines STRING, num_seats STRING"),
        "faa_registry": make([("N1", "C1"), ("N2", "zz"), ("N3", "C1")], "n_number STRING, mfr_mdl_code STRING"),
        "part135_aircraft": make([("N1", "A", "s", "m"), ("N1", "B", "s", "m"), ("N9", "A", "s", "m"), ("N3", "gone", "s", "m"), (None, "A", "s", "m")],
                                 "n_number STRING, certificate_designator STRING, serial_number STRING, make_model_series STRING"),
        "operators": make([("A", "Alpha", "f"), ("B", "Beta", "f")], "certificate_designator STRING, operator_name STRING, fsdo STRING"),
        "aircraft_photos": make([("N1", True, "p", "l", "x"), ("N2", False, "p", "l", "x")], "n_number STRING, has_photo BOOLEAN, local_path STRING, page_link STRING, photographer STRING"),
    })
    got = sorted((str(r.n_number), str(r.certificate_designator), r.registered, str(r.category), str(r.local_path)) for r in spine.aircraft_profile(t).collect())
    assert got == [("N1", "A", True, "Jet", "p"), ("N1", "B", True, "Jet", "p"), ("N2", "None", True, "None", "None"), ("N3", "None", True, "Jet", "None"),
                   ("N9", "A", False, "None", "None"), ("None", "A", False, "None", "None")]


def test_profiles_move_once_for_the_last_join(files, no_broadcast):
    joins = re.findall(r"SortMergeJoin .*(FullOuter|LeftOuter|Inner)", plan(spine.aircraft_profile(files)))
    assert joins[0] == "FullOuter" and joins.count("FullOuter") == 2


def test_profiles_repeat_with_their_rows_and_photos(spark):
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    t = Tables.of(
        aircraft_ref=make([("C1", "LEAR JET", "35", "a", "e", "Jet", "2", "8")], "code STRING, manufacturer STRING, model STRING, aircraft_type STRING, engine_type STRING, category STRING, num_engines STRING, num_seats STRING"),
        faa_registry=make([(n, "C1", "BIG OWNER LLC", "PORT", "TX", "V", "3", "2001", "A1") for n in ("N1", "N1", "N4", None)], "n_number STRING, mfr_mdl_code STRING, registrant_name STRING, "
                          "city STRING, state STRING, status_code STRING, registrant_type STRING, year_mfr STRING, mode_s_hex STRING"),
        part135_aircraft=make([("N1", "A", "s", "m"), ("N9", "A", "s", "m"), (None, "A", "s", "m")], "n_number STRING, certificate_designator STRING, serial_number STRING, make_model_series STRING"),
        operators=make([("A", "Alpha", "f")], "certificate_designator STRING, operator_name STRING, fsdo STRING"),
        aircraft_photos=make([(n, True, p, "l", "x") for n, p in (("N1", "p"), ("N1", "q"), ("N9", "r"), ("N8", "s"), (None, "t"))], "n_number STRING, has_photo BOOLEAN, local_path STRING, page_link STRING, photographer STRING"))
    rows = sorted((str(r.n_number), str(r.certificate_designator), r.registered, str(r.local_path)) for r in spine.aircraft_profile(t).collect())
    assert rows == [("N1", "A", True, "p")] * 2 + [("N1", "A", True, "q")] * 2 + [
        ("N4", "None", True, "None"), ("N9", "A", False, "r"), ("None", "A", False, "None"), ("None", "None", True, "None")]
    shown = [(r.n_number, r.registered, r.manufacturer, r.registered_owner, r.owner_location, r.local_path) for r in fleet.aircraft_detail(t, "n9").collect()]
    assert shown == [("N9", False, None, None, "", "r")]
    assert {(r.manufacturer, r.registered_owner, r.owner_location) for r in fleet.aircraft_detail(t, "n1").collect()} == {("Lear Jet", "Big Owner LLC", "Port, TX")}


def test_the_route_report_is_one_scan(files):
    p = routes.charter_route_report(files)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[year#", p)) == 1


def test_spine_totals_are_one_pass(files):
    p = spine.spine_totals(files)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Relation [") == 4
    got = {(r["section"], r["name"]): (r["n"], r["ready"]) for r in spine.spine_totals(files).collect()}
    assert got["all", None] == (files.part135_aircraft.count(), spine.adsb_ready(spine.charter_fleet(files)).count())
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "category"} == {r.category: r.n for r in spine.count_by_category(files).collect()}
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "operator"} == {r.operator_name: r.n for r in spine.top_operators(files, 10 ** 6).collect()}


def test_shares_plan_their_input_once(files):
    p = spine.share_of_max(spine.count_by_category(files))._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("Relation [") == 3


def test_platform_ranks_are_cut_before_the_exchange(files, t):
    from skyspine.plans.platform import platform_stats
    named = Tables({**{n: (lambda n=n: t[n]) for n in t.names()}, **{n: (lambda n=n: files[n]) for n in files.names()}})
    df = platform_stats(named)
    assert "WindowGroupLimit" in plan(df)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    for first in ("n_number", "certificate_designator"):
        assert text.count(f"Relation [{first}#") <= 3


def test_sections_of_a_route_are_formed_in_place(files, no_broadcast):
    """Reduced rows move to their route once; they are listed by section behind that exchange, not before it."""
    p = plan(traffic.route_report(traffic.charter_routes(files)))
    moved = [re.sub(r"#\d+L?", "", m) for m in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", p)]
    assert len(moved) == 2 and moved[0] == "unique_carrier, origin, dest" and "Expand" not in p


def test_line_items_move_once_for_orders_and_customers(t, no_broadcast):
    below = re.findall(r"Exchange hashpartitioning\(o_custkey.*\n(.*)", plan(t.v_t100))
    assert below and not any("l_suppkey" in line for line in below)
