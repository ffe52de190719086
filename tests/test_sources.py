"""Scans of landed files and the ingests on them."""

import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skyspine import schemas as S
from skyspine.operators import keys as K
from skyspine.sources import archive, ingest
from skyspine.sources import text as X


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def test_text_table(spark, folder):
    path = write(folder, "a.csv", 'N-NUMBER ,  NAME , X\n1, "A, ""B"" Co"  ,NA\n2,  two ,\n3\n')
    df = X.read_text_table(spark, path)
    assert df.columns == ["N-NUMBER", "NAME", "X"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[1] == ("2", "two ", "") and rows[2] == ("3", "", "")
    assert rows[0][2] == "NA"
    assert sorted(r.X for r in X.read_text_table(spark, path, pandas_na=True).collect()) == ["", "", ""]


def test_first_row_wins_in_file_order_for_any_split(spark, folder):
    """The first row of a key is the first in (file, line) order however the files are split."""
    want = {}
    for part in range(3):
        lines = ["k,v"]
        for i in range(4000):
            key, value = (i * 7) % 50, f"{part}-{i}"
            want.setdefault(str(key), value)
            lines.append(f"{key},{value}")
        write(folder, f"in/f{part}.csv", "\n".join(lines) + "\n")
    for size in ("4096", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = X.read_text_table(spark, folder + "/in", position=True)
            got = {r.k: r.v for r in K.keep_first(df, ["k"], [X.POSITION]).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want


def test_resolve_columns():
    names = ["N-NUMBER", " MFR MDL CODE", "TYPE REGISTRANT", "MODE S CODE", "MODE S CODE HEX"]
    assert X.find_column(names, [("mfr", "mdl", "code")]) == " MFR MDL CODE"
    assert X.find_column(names, [("mode", "code")]) == "MODE S CODE"
    assert X.find_column(names, [("missing",), ("mode", "hex")]) == "MODE S CODE HEX"
    with pytest.raises(KeyError):
        X.find_column(names, [("nope",)])


def test_banner_table(spark, folder):
    path = write(folder, "b.csv", 'UPDATED: today\nCertificate Holder Name,Designator, District\n"A, Inc",1A,X\nB,2B,\n')
    df = X.read_banner_table(spark, path, position=True)
    assert df.columns == ["Certificate Holder Name", "Designator", "District", X.POSITION]
    assert sorted(tuple(r)[:3] for r in df.collect()) == [("A, Inc", "1A", "X"), ("B", "2B", "")]


def test_fixed_width_latin1(spark, folder):
    line = "APT" + "SITE1".ljust(11) + "École, \"quoted\"".ljust(20) + "012"
    path = write(folder, "apt.txt", line + "\r\n" + "RWY" + "x" * 34 + "\n", encoding="latin-1")
    layout = {"site": (4, 11), "name": (15, 20), "n": (35, 3), "beyond": (900, 5)}
    rows = X.read_fixed_width(spark, path, layout, tag="APT").collect()
    assert [tuple(r) for r in rows] == [("SITE1", "École, \"quoted\"", "012", "")]


def test_zip_members(spark, folder):
    os.makedirs(folder + "/z")
    for name, members in {"a": {"x.txt": "no", "T_1.CSV": "K,V\n1,a\n2,b\n1,c\n", "later.csv": "K,V\n9,z\n"}, "b": {"y.csv": "K,V\n3,é\n"},
                          "c": {"readme": "none"}}.items():
        with zipfile.ZipFile(f"{folder}/z/{name}.zip", "w") as z:
            for member, text in members.items():
                z.writestr(member, text.encode("latin-1"))
    write(folder, "z/broken.zip", "not an archive")
    members = archive.read_zip_members(spark, folder + "/z", ".csv")
    table = archive.member_table(members, ["K", "V"])
    first = K.keep_first(table, ["K"], ["_position"])
    assert sorted((r.K, r.V) for r in first.collect()) == [("1", "a"), ("2", "b"), ("3", "é")]
    bad = archive.bad_archives(members).collect()
    assert sorted(os.path.basename(r.archive) for r in bad) == ["broken.zip", "c.zip"]


def test_project_rename_takes_padded_headers(spark):
    df = spark.createDataFrame([("1", "2", "3")], "` A ` STRING, B STRING, C STRING")
    assert X.project_rename(df, {"A": "a", "C": "c"}, ["c", "a"]).first().asDict() == {"c": "3", "a": "1"}
    with pytest.raises(KeyError):
        X.project_rename(df, {"Z": "z"})


def test_code_lookup(spark, folder):
    path = write(folder, "codes.csv", 'Code,Description\n" 006 ", Six \n  ,blank\n007,"Se,ven"\n')
    rows = sorted(tuple(r) for r in X.read_code_lookup(spark, path).collect())
    assert rows == [("006", "Six"), ("007", "Se,ven")]


def test_strict_load_fails_and_quarantine_reports(spark):
    df = spark.createDataFrame([("1", "10", "true"), ("2", "x", ""), ("3", "", "perhaps")], "id STRING, n STRING, f STRING")
    schema = S.T.StructType.fromDDL("id BIGINT, n INT, f BOOLEAN")
    with pytest.raises(PySparkException):
        K.typed_load(df, schema).collect()
    loaded = K.typed_load(df, schema, strict=False)
    assert [tuple(r) for r in K.accepted(loaded).collect()] == [(1, 10, True)]
    assert sorted((r.id, r._bad_cells) for r in K.rejects(loaded).collect()) == [(2, ["n"]), (3, ["f"])]


def test_check_keys(spark):
    parent = spark.createDataFrame([("a",), ("b",)], "id STRING")
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z"), (None, "a"), (3, None)], "k INT, p STRING")
    got = sorted(tuple(r) for r in K.check_keys(child, ["k"], parent, {"p": "id"}).collect())
    assert got == [("duplicate", "1", 2), ("no parent p", "z", 1), ("null k", "NULL", 1)]


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("a", "old")], "k STRING, v STRING")
    batch = spark.createDataFrame([("a", "new", 1), ("b", "first", 2), ("b", "second", 3)], "k STRING, v STRING, pos INT")
    got = sorted(tuple(r) for r in K.insert_if_absent(target, batch, ["k"], ["pos"]).collect())
    assert got == [("a", "old"), ("b", "first")]


MASTER = ("N-NUMBER,SERIAL NUMBER,MFR MDL CODE,YEAR MFR,TYPE REGISTRANT,NAME,CITY,STATE,STATUS CODE,MODE S CODE,MODE S CODE HEX,\n"
          "116hl ,S1  ,C1,2001,7,A LLC  ,NICE,CA,V,50000001,a00001 ,\n"
          "N116HL,S2,C2,2002,7,B LLC,NICE,CA,V,50000002,a00002,\n"
          "5, ,,    ,1,C,,,12,,,\n")
REFERENCE = "CODE,MFR,MODEL,TYPE-ACFT,TYPE-ENG,AC-CAT,NO-ENG,NO-SEATS\nC1 ,LEAR ,35 ,5,5,1,02,008\n ,X,Y,1,1,1,1,1\nC2,BELL,206,6,3,1,01,005\n"
LIST = ("CHARTER LIST - UPDATED\nPart 135 Certificate Holder Name,Certificate Designator,Certificate Holding District Office,"
        "Registration Number,Serial Number,Aircraft Make/Model/Series\n"
        "Alpha Air,1A,WP01,116HL,S1,LR-35\nAlpha Air again,1A,WP02,N116HL,S9,LR-36\nBeta Air,2B,WP01,N116HL,S1,LR-35\n"
        "No Cert,  ,WP01,77,S,M\nGamma Air,3C,WP03,,S,M\n")


def test_ingest_the_spine(spark, folder):
    from skyspine.operators.spine import charter_fleet, fleet_enriched
    from skyspine.tables import Tables
    root = folder + "/tables"
    assert ingest.ingest_registry(spark, write(folder, "m/MASTER.txt", MASTER), root).first().rows == 2
    assert ingest.ingest_reference(spark, write(folder, "r/ACFTREF.txt", REFERENCE), root).first().rows == 2
    report = {r.table: r.rows for r in ingest.ingest_certificates(spark, write(folder, "l/list.csv", LIST), root).collect()}
    assert report == {"operators": 3, "part135_aircraft": 2}
    t = Tables({n: (lambda n=n: ingest.stored(root, n).read(spark)) for n in (
        "faa_registry", "aircraft_ref", "operators", "part135_aircraft")})
    registry = {r.n_number: r for r in t.faa_registry.collect()}
    assert set(registry) == {"N116HL", "N5"}
    assert (registry["N116HL"].serial_number, registry["N116HL"].mode_s_hex) == ("S1", "A00001")
    # Blank cells of bulk-loaded tables are NULL.
    assert registry["N5"].serial_number is None and registry["N5"].mode_s_hex is None
    operators = {r.certificate_designator: r for r in t.operators.collect()}
    assert (operators["1A"].operator_name, operators["1A"].fsdo, operators["1A"].part) == ("Alpha Air", "WP01", "135")
    rows = sorted((r.n_number, r.operator_name, r.category, r.engine_type) for r in fleet_enriched(t).collect())
    assert rows == [("N116HL", "Alpha Air", "Jet", "Turbo-fan"), ("N116HL", "Beta Air", "Jet", "Turbo-fan")]
    assert charter_fleet(t).count() == t.part135_aircraft.count()


def test_ingest_airport_detail(spark, folder):
    from skyspine.functions import fixed_values as V
    line = [" "] * 1100
    def put(name, text):
        start, length = V.AIRPORT_RECORD[name]
        line[start - 1:start - 1 + len(text)] = text
    line[0:3] = "APT"
    put("location_id", "TEB"); put("owner_name", "CITY"); put("based_jet", " 12"); put("based_heli", "x"); put("based_single", "003")
    path = write(folder, "apt/APT.txt", "".join(line) + "\nRWY" + " " * 50 + "\n", encoding="latin-1")
    report = ingest.ingest_airport_detail(spark, path, folder + "/tables").first()
    assert (report.rows, report.airports_with_jets, report.total_based_jets) == (1, 1, 12)
    row = ingest.stored(folder + "/tables", "faa_airport_detail").read(spark).first()
    assert (row.location_id, row.based_jet, row.based_heli, row.based_total, row.manager_name) == ("TEB", 12, 0, 15, None)


def test_ingest_airports(spark, folder):
    write(folder, "ap/airports/a.csv", ",".join(S.column_names("airports")) + "\n"
          'KTEB,medium_airport,"Teterboro, NJ",40.85,-74.06,9,NA,US,US-NJ,Teterboro,no,KTEB,TEB,KTEB,TEB,,\n'
          "KTEB,small_airport,dup,1,1,1,NA,US,US-NJ,x,yes,,,,,,\n")
    write(folder, "ap/runways/r.csv", ",".join(S.column_names("runways")) + "\n1,KTEB,7000,150,ASP,1,0,06,24\n ,KTEB,1,1,X,1,1,a,b\n"
          "2,KTEB,6015,,ASP,,,01,19\n")
    report = {r.table: r.rows for r in ingest.ingest_airports(spark, folder + "/ap", folder + "/tables").collect()}
    assert report == {"airports": 1, "runways": 2}
    a = ingest.stored(folder + "/tables", "airports").read(spark).first()
    assert (a.name, a.continent, a.scheduled_service, a.elevation_ft, a.home_link) == ("Teterboro, NJ", "NA", False, 9, None)
    r = ingest.stored(folder + "/tables", "runways").read(spark).where("id = 2").first()
    assert (r.width_ft, r.closed, r.lighted) == (None, None, None)


def traffic_csv(period, rows):
    from skyspine.functions import fixed_values as V
    heads = list(V.TRAFFIC_COLUMNS)
    base = {"UNIQUE_CARRIER": "NA", "AIRLINE_ID": "1", "UNIQUE_CARRIER_NAME": "Nice Air", "ORIGIN": "TEB", "ORIGIN_CITY_NAME": "Teterboro, NJ",
            "ORIGIN_STATE_ABR": "NJ", "DEST": "VNY", "DEST_CITY_NAME": "Van Nuys, CA", "DEST_STATE_ABR": "CA", "AIRCRAFT_GROUP": "6",
            "AIRCRAFT_TYPE": "629", "AIRCRAFT_CONFIG": "1", "DEPARTURES_PERFORMED": "1", "SEATS": "8", "PASSENGERS": "5", "FREIGHT": "0",
            "MAIL": "0", "DISTANCE": "2450", "YEAR": period[:4], "MONTH": period[5:], "CLASS": "L"}
    lines = [",".join([*heads, "OTHER"])]
    for r in rows:
        lines.append(",".join(f'"{ {**base, **r}[h]}"' for h in heads) + ",x")
    return "\n".join(lines) + "\n"


def test_traffic_periods(spark, folder):
    files = {
        "2025-11": write(folder, "t/a.csv", traffic_csv("2025-11", [{}, {"SEATS": "99"}, {"DEST": "LAX"}])),
        "2025-10": write(folder, "t/b.csv", traffic_csv("2025-10", [{"DISTANCE": "far"}, {}])),
        "2025-09": write(folder, "t/c.csv", "YEAR,MONTH\n2025,9\n"),
    }
    root = folder + "/tables"
    report = {r.period: (r.rows, r.bad_rows, r.status) for r in ingest.ingest_traffic(spark, files, root).collect()}
    # In 2025-10 both rows have one key and the first of them is bad: the period is left out whole.
    assert report == {"2025-11": (2, 0, "loaded"), "2025-10": (1, 1, "skipped"), "2025-09": (0, 0, "skipped")}
    again = {"2025-11": write(folder, "u/a.csv", traffic_csv("2025-11", [{"DEPARTURES_PERFORMED": "7", "ORIGIN_CITY_NAME": "Elsewhere"}]))}
    ingest.ingest_traffic(spark, again, root)
    rows = {r.dest: r for r in ingest.stored(root, "t100_segment", ("year", "month")).read(spark).collect()}
    assert set(rows) == {"VNY", "LAX"} and rows["VNY"].unique_carrier == "NA"
    assert (float(rows["VNY"].departures), rows["VNY"].origin_city, float(rows["VNY"].seats)) == (7.0, "Teterboro, NJ", 8.0)
    assert float(rows["LAX"].departures) == 1.0


def test_ingest_mail_last_copy_counts(spark, folder):
    import json
    def doc(i, snippet, subject):
        return json.dumps({"id": i, "snippet": snippet, "labelIds": ["A"], "payload": {"headers": [{"name": "Subject", "value": subject}]}})
    root = folder + "/tables"
    ingest.ingest_mail(spark, write(folder, "m1/a.json", "\n".join([doc("1", "s1", "one"), doc("2", "s2", "two"), doc("1", "s3", "x")])), root)
    ingest.ingest_mail(spark, write(folder, "m2/a.json", doc("2", "new", "changed")), root)
    rows = {r.id: (r.snippet, r.subject, r.labels) for r in ingest.stored(root, "emails").read(spark).collect()}
    assert rows["2"] == ("new", "two", ["A"]) and rows["1"][0] == "s3"


def test_periods_are_one_scan(spark, folder, monkeypatch):
    """However many periods, their rows are one text scan and one job beside the headers'; columns are found by place per file."""
    from skyspine.functions import fixed_values as V
    heads = list(V.TRAFFIC_COLUMNS)
    files = {}
    for k in range(40):
        period = f"2020-{k:02d}"
        text = traffic_csv("2020-01", [{"SEATS": str(k)}, {"DEST": "LAX"}])
        if k % 2:  # the columns in another order, with one more before them
            lines = ["y," + line for line in text.splitlines()]
            text = "\n".join(["NEW," + lines[0][2:], *lines[1:]]) + "\n\n"
        files[period] = write(folder, f"p/{period} x%.csv", text)
    plans = []
    from pyspark.sql.readwriter import DataFrameWriter
    original = DataFrameWriter.parquet
    def parquet(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return original(self, path, *a, **k)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    rows, report = ingest.load_periods(spark, files)
    assert len(plans) == 1 and plans[0].count("FileScan text") == 1 and "FileScan csv" not in plans[0] and "Union" not in plans[0]
    got = {r.period: (r.rows, r.status) for r in report.collect()}
    assert got == {p: (2, "loaded") for p in files}
    seats = {r.period: int(r.seats) for r in rows.where("dest = 'VNY'").collect()}
    assert seats == {f"2020-{k:02d}": k for k in range(40)} and len(heads) > 20


def test_bad_files_skip_their_periods_only(spark, folder):
    good = traffic_csv("2020-01", [{}])
    header, row = good.splitlines()
    packed = lambda text: text.encode("latin-1")
    os.makedirs(folder + "/z")
    for name, members in {"good": {"T.csv": packed(good)}, "long": {"T.csv": packed(good + row + ",1,2\n")}, "none": {"x.txt": b""}}.items():
        with zipfile.ZipFile(f"{folder}/z/{name}.zip", "w") as z:
            for member, data in members.items():
                z.writestr(member, data)
    write(folder, "z/broken.zip", "no archive")
    files = {
        "good": write(folder, "q/good.csv", good),
        "long": write(folder, "q/long.csv", good + row + ",more\n"),
        "far": write(folder, "q/far.csv", good + row + "," * 60 + "far\n"),
        "blanks": write(folder, "q/blanks.csv", good + row.replace("VNY", "SMO") + "," * 60 + "\n"),
        "break": write(folder, "q/break.csv", header + "\n" + row.replace("Van Nuys, CA", "Van\nNuys, ""CA") + "\n"),
        "headless": write(folder, "q/headless.csv", "\n\n"),
        "lacking": write(folder, "q/lacking.csv", "YEAR,MONTH\n2020,1\n"),
        "only header": write(folder, "q/only.csv", header + "\n"),
        "missing": folder + "/nowhere.csv",
        **{f"zip {n}": f"{folder}/z/{n}.zip" for n in ("good", "long", "none", "broken")},
    }
    rows, report = ingest.load_periods(spark, files)
    got = {r.period: (r.rows, r.bad_rows, r.status, r.reason) for r in report.collect()}
    lacking = got.pop("lacking")
    assert lacking[2] == "skipped" and "CLASS" in lacking[3]
    assert got.pop("zip none")[2:] == ("skipped", "broken archive: no member ends with .csv")
    assert got.pop("zip broken")[2] == "skipped"
    too_long = (2, 1, "skipped", "rows longer than the header")
    assert got == {"good": (1, 0, "loaded", None), "long": too_long, "far": too_long, "blanks": (2, 0, "loaded", None),
                   "break": (1, 0, "loaded", None), "headless": (0, 0, "skipped", "no header"), "only header": (0, 0, "empty", None),
                   "missing": (0, 0, "skipped", "no such file"), "zip good": (1, 0, "loaded", None), "zip long": too_long}
    shown = {(r.period, r.dest, r.dest_city) for r in rows.collect()}
    assert ("break", "VNY", "Van\nNuys, CA") in shown and len(shown) == 5


def test_files_are_split_unless_a_cell_has_breaks(spark, folder):
    plain = write(folder, "s/plain.csv", "A,B\n" + "".join(f"{i},x\n" for i in range(3000)))
    breaks = write(folder, "s/breaks.csv", "A,B\n" + "".join(f'{i},"x\ny"\n' for i in range(3000)))
    stray = write(folder, "s/stray.csv", 'A,B\n1,5" pipe\n2,6\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert X.read_text_table(spark, plain).rdd.getNumPartitions() > 1
        assert X.read_text_table(spark, plain).count() == 3000
        broken = X.read_text_table(spark, breaks)
        assert broken.rdd.getNumPartitions() == 1 and {r.B for r in broken.collect()} == {"x\ny"} and broken.count() == 3000
        assert sorted(tuple(r) for r in X.read_text_table(spark, stray).collect()) == [("1", '5" pipe'), ("2", "6")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_filled_cells_far_beyond_the_header(spark, folder):
    path = write(folder, "far/a.csv", "A,B\n1,2\n3,4" + "," * 17 + "lost\n5,6" + "," * 40 + '\n"7,' + "," * 30 + '",8\n9\n')
    assert [r._extra for r in X.read_text_table(spark, path, strict=False).collect()] == [None, "lost", None, None, None]
    with pytest.raises(PySparkException, match="more cells than the header"):
        X.read_text_table(spark, path).collect()


def test_titles_are_dropped_by_place(spark, folder):
    write(folder, "bt/1.csv", "T\nA,B\n1,2\nA,B\nT\n")
    write(folder, "bt/2.csv", "T\nA,B\n3,4\n")
    write(folder, "bt/3.csv", "5,6\n7,8\nA,B\n")
    rows = sorted(tuple(r) for r in X.read_banner_table(spark, folder + "/bt").collect())
    assert rows == [("1", "2"), ("3", "4"), ("5", "6"), ("7", "8"), ("A", "B"), ("A", "B"), ("T", "")]


def test_loads_do_not_read_their_tables_again(spark, folder, monkeypatch):
    """Reports come from what was observed while writing: the stored table is opened by no load."""
    from skyspine.sources.store import StoredTable
    monkeypatch.setattr(StoredTable, "read", lambda self, spark, parts=None: (_ for _ in ()).throw(AssertionError(self.root))
                        if parts is None else spark.createDataFrame([], self.schema))
    root = folder + "/tables"
    assert ingest.ingest_registry(spark, write(folder, "m/MASTER.txt", MASTER), root).first().rows == 2
    assert {r.table: r.rows for r in ingest.ingest_certificates(spark, write(folder, "l/list.csv", LIST), root).collect()} == {
        "operators": 3, "part135_aircraft": 2}
    mail = write(folder, "m1/a.json", '{"id": "1", "payload": {}}\n{"id": "1", "payload": {}}\n{"id": "2", "payload": {}}')
    assert ingest.ingest_mail(spark, mail, root).first().rows == 3


def test_ingests_from_the_publishers_archives(spark, folder):
    from skyspine.functions import fixed_values as V
    os.makedirs(folder + "/z")
    record = [" "] * 1100
    for name, text in (("location_id", "TEB"), ("based_jet", " 12"), ("owner_name", "CITÉ")):
        start, _ = V.AIRPORT_RECORD[name]
        record[start - 1:start - 1 + len(text)] = text
    record[0:3] = "APT"
    with zipfile.ZipFile(folder + "/z/all.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("MASTER.txt", "﻿" + MASTER)
        z.writestr("ACFTREF.txt", REFERENCE)
        z.writestr("APT.txt", ("".join(record) + "\r\nRWY\r\n").encode("latin-1"))
    packed, plain = folder + "/packed", folder + "/plain"
    assert ingest.ingest_registry(spark, folder + "/z/all.zip", packed).first().rows == 2
    ingest.ingest_registry(spark, write(folder, "m/MASTER.txt", MASTER), plain)
    ingest.ingest_reference(spark, folder + "/z/*.zip", packed)
    ingest.ingest_reference(spark, write(folder, "r/ACFTREF.txt", REFERENCE), plain)
    for table in ("faa_registry", "aircraft_ref"):
        rows = [sorted(map(str, ingest.stored(root, table).read(spark).collect())) for root in (packed, plain)]
        assert rows[0] == rows[1] and rows[0]
    assert ingest.ingest_airport_detail(spark, folder + "/z/all.zip", packed).first().total_based_jets == 12
    assert ingest.stored(packed, "faa_airport_detail").read(spark).first().owner_name == "CITÉ"
    write(folder, "y/broken.zip", "no archive")
    with pytest.raises(ingest.BrokenArchive):
        ingest.ingest_registry(spark, folder + "/y/broken.zip", packed)
    assert ingest.stored(packed, "faa_registry").read(spark).count() == 2


def test_only_title_like_lines_look_for_their_file(spark, folder):
    """The banner and header are dropped at the head of each file and kept elsewhere; no other line is joined, each is parsed once."""
    titles = "UPDATED,today\nNAME,CODE\n"
    os.makedirs(folder + "/many")
    for i in range(3):
        write(folder, f"many/{i}.csv", f"{titles if i < 2 else ''}a{i},1\nb{i},2\nNAME,CODE\nUPDATED,today\n")
    df = X.read_banner_table(spark, folder + "/many")
    want = [x for i in range(3) for x in ((f"a{i}", "1"), (f"b{i}", "2"), ("NAME", "CODE"), ("UPDATED", "today"))]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < text.index("Union") < text.index("Join") and text.count("from_csv(") == text.count("Generate explode(array(from_csv(") > 0


def test_member_lines_are_not_moved(spark, folder):
    """No join over the lines of archives, each line parsed once; an archive broken inside is left out whole."""
    os.makedirs(folder + "/zz")
    for name, head in (("a", "K,V"), ("b", "V,K"), ("torn", "K,V")):
        with zipfile.ZipFile(f"{folder}/zz/{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("t.csv", "\n".join([head, *(f"{name}{i},{name}{i}" for i in range(60000))]))
    with open(f"{folder}/zz/torn.zip", "r+b") as f:
        f.seek(os.path.getsize(f"{folder}/zz/torn.zip") // 2)
        f.write(b"\xff" * 64)
    members = archive.read_zip_members(spark, folder + "/zz", ".csv")
    table = archive.member_table(members, ["K", "V"])
    text = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and text.count("from_csv(") == text.count("Generate explode(array(from_csv(") == 2
    assert table.groupBy(F.substring("K", 1, 1).alias("k")).count().sort("k").collect() == [("a", 60000), ("b", 60000)]
    assert [os.path.basename(r.archive) for r in archive.bad_archives(members).collect()] == ["torn.zip"]


def test_traffic_archives_are_packed_by_many_tasks(spark):
    from skyspine.workload import loads
    names = [*loads.SHOWN.split(", "), *loads.MEASURES]
    rows = spark.range(0, 400, numPartitions=4).select(*[F.col("id").cast("string").alias(n) for n in names])
    assert spark.read.schema("content STRING").json(loads.zip_traffic(spark, rows, "zips")).count() == 4


def test_landed_periods_are_named_by_their_folders(spark, monkeypatch):
    """The rows of a landing are formed once; the year of rows without one has no file."""
    from skyspine.workload import loads
    names = [*loads.SHOWN.split(", "), *loads.MEASURES]
    formed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            formed.add(len(b))
            yield b
    rows = spark.createDataFrame([(y, *["1"] * (len(names) - 1)) for y in (1996, 1997, None)], ", ".join(
        f"{n} {'BIGINT' if n == 'year' else 'STRING'}" for n in names))
    files = loads.land_traffic(spark, rows.mapInPandas(counted, rows.schema), "traffic")
    assert sorted(files) == ["1996", "1997", "None"] and formed.value == 3
    assert [tuple(r)[0] for r in ingest.load_periods(spark, files)[1].where("status = 'skipped'").collect()] == ["None"]


def test_repeated_rows_land_in_one_file_of_many(spark, folder):
    from skyspine.workload import loads
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        loads.land_twice(spark.range(1000), folder + "/twice")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.read.parquet(folder + "/twice").withColumn("file", F.input_file_name())
    assert rows.select("file").distinct().count() > 1
    assert rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("f")).where("n <> 2 OR f <> 1").count() == 0


def test_children_are_counted_before_parents_are_looked_up(spark):
    """Neither side of the search for orphans holds a key twice, and only keys and counts meet."""
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "id STRING")
    child = spark.createDataFrame([(1, "z"), (2, "z"), (3, "a"), (4, None)], "n INT, p STRING")
    rows = K.check_keys(child, ["n"], parent, {"p": "id"})
    assert [tuple(r) for r in rows.collect()] == [("no parent p", "z", 2)]
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")[1]
    assert below.count("Aggregate [p") == 2


def test_rows_of_periods_are_written_once_before_the_table(spark, folder, monkeypatch):
    """The checked rows are the upsert's batch, and go by the number of their file."""
    from pyspark.sql.readwriter import DataFrameWriter
    written, original = [], DataFrameWriter.parquet
    def parquet(self, path, *a, **k):
        written.append((path, self._df._jdf.queryExecution().executedPlan().toString()))
        return original(self, path, *a, **k)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    files = {"2025-11": write(folder, "t/a.csv", traffic_csv("2025-11", [{}, {"SEATS": "99"}, {"MONTH": "011"}, {"DEST": "LAX"}]))}
    report = [tuple(r) for r in ingest.ingest_traffic(spark, files, folder + "/tables").collect()]
    # Keys are told apart by their text: month 11 and 011 are two rows here, of which the table holds one.
    assert report == [("2025-11", 3, 0, "loaded", None)]
    assert [p.startswith(folder) for p, _ in written] == [False, True] and "named_struct(file," not in written[0][1]
    assert ingest.stored(folder + "/tables", "t100_segment", ("year", "month")).read(spark).count() == 2


def test_landed_traffic_is_packed(spark):
    from pathlib import Path
    from skyspine.standins import domain_tables
    from skyspine.workload.loads import keyed_traffic, land_traffic
    files = land_traffic(spark, keyed_traffic(domain_tables(spark, "/root/testdata/sf0.001"), spark), "traffic")
    assert files and all(f.name.endswith(".csv.gz") for path in files.values() for f in Path(path).glob("part-*"))
