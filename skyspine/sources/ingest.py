"""Ingests: landed files to stored tables. Each takes (spark, landing path, target) and returns its report.

``INGESTS`` is the extension point: a new source is one function and one entry.
"""

from __future__ import annotations

import csv
from functools import partial, reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skyspine import schemas as S
from skyspine.functions import fixed_values as V
from skyspine.functions.clean import drop_blank_key, int_or_zero, norm_tail, row_total, strip_all, yes_no
from skyspine.functions.decode import classify_category, decode_passthrough
from skyspine.operators.airports import jet_capable
from skyspine.operators.keys import keep_first, keyed, typed_load
from skyspine.operators.mail import message_rows
from skyspine.operators.upsert import photo_results
from skyspine.session import scratch
from skyspine.sources import text as X
from skyspine.sources.archive import bad_archives, member_table, read_zip_members
from skyspine.sources.json_feeds import WEATHER, read_mail_json, read_photo_answers, read_weather_json, weather_rows
from skyspine.sources.store import StoredTable
from skyspine.tables import Tables

POSITION = X.POSITION


def stored(root: str, table: str, parts: tuple[str, ...] = (), buckets: int | None = None) -> StoredTable:
    return StoredTable(f"{root}/{table}", S.table_schema(table), tuple(S.KEYS[table]), parts, buckets)


def clean_registry(raw: DataFrame) -> DataFrame:
    """Registration file rows: columns found by header, trimmed, keyed; the first row of a tail wins."""
    rows = strip_all(X.resolve_columns(raw, V.REGISTRY_HEADER, [POSITION]))
    rows = rows.withColumn("n_number", norm_tail(F.col("n_number"))).withColumn(
        "mode_s_hex", F.upper("mode_s_hex"))
    return typed_load(keep_first(rows, ["n_number"], [POSITION]), S.table_schema("faa_registry"))


def clean_reference(raw: DataFrame) -> DataFrame:
    """Aircraft reference rows with type, engine and category decoded."""
    rows = drop_blank_key(strip_all(X.resolve_columns(raw, V.REFERENCE_HEADER)), "code")
    kind, engine = F.col("type_code"), F.col("engine_code")
    decoded = rows.select(
        "code", "manufacturer", "model", decode_passthrough(V.AIRCRAFT_TYPE, kind).alias("aircraft_type"),
        decode_passthrough(V.ENGINE_TYPE, engine).alias("engine_type"),
        classify_category(kind, engine).alias("category"), "num_engines", "num_seats")
    return typed_load(decoded, S.table_schema("aircraft_ref"))


def clean_certificates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certificate list to (operators, tails on certificates); blanks stay blank here."""
    names = [c for c in raw.columns if c != POSITION]
    wanted = dict(V.CERTIFICATE_HEADER)
    if any(V.CERTIFICATE_PART_HEADER[0] in c.strip().lower() for c in names):
        wanted["part"] = [V.CERTIFICATE_PART_HEADER]
    rows = strip_all(drop_blank_key(X.resolve_columns(raw, wanted, [POSITION]), "certificate_designator"))
    if "part" not in wanted:
        rows = rows.withColumn("part", F.lit(V.DEFAULT_PART))
    rows = rows.withColumn("n_number", norm_tail(F.col("n_number")))
    operators = keep_first(rows.select("certificate_designator", "operator_name", "part", "fsdo", POSITION),
                           ["certificate_designator"], [POSITION]).drop(POSITION)
    tails = keep_first(
        drop_blank_key(rows, "n_number").select("n_number", "certificate_designator", "serial_number",
                                                "make_model_series", POSITION),
        ["n_number", "certificate_designator"], [POSITION]).drop(POSITION)
    return operators, tails


def clean_airports(raw: DataFrame, strict: bool = True) -> DataFrame:
    rows = raw.withColumn("scheduled_service", yes_no(F.col("scheduled_service")).cast("string"))
    return typed_load(keep_first(rows, ["ident"], [POSITION]), S.table_schema("airports"), strict=strict)


def clean_runways(raw: DataFrame, strict: bool = True) -> DataFrame:
    rows = drop_blank_key(raw, "id")
    for flag in ("lighted", "closed"):
        rows = rows.withColumn(flag, yes_no(F.col(flag)).cast("string"))
    return typed_load(keep_first(rows, ["id"], [POSITION]), S.table_schema("runways"), strict=strict)


def clean_airport_detail(lines: DataFrame) -> DataFrame:
    """Fixed-width base records to contacts and based-aircraft counts."""
    fields = X.slice_fixed_width(X.filter_record_type(lines, V.AIRPORT_RECORD_TAG), V.AIRPORT_RECORD)
    counted = fields.select(*[int_or_zero(F.col(c)).alias(c) if c in V.BASED_COUNTS else F.nullif(F.col(c), F.lit("")).alias(c)
                              for c in fields.columns])
    total = counted.withColumn("based_total", row_total([F.col(c) for c in V.BASED_COUNTS]))
    return total.select(*S.table_schema("faa_airport_detail").fieldNames())


def shape_traffic(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Traffic rows renamed, keyed and typed; the first row of a key wins."""
    order = S.table_schema("t100_segment").fieldNames()
    rows = X.project_rename(raw, V.TRAFFIC_COLUMNS, order, [POSITION])
    first = keep_first(rows, S.KEYS["t100_segment"], [POSITION])
    return typed_load(first, S.table_schema("t100_segment"), strict=strict)


REPORT_DDL = "period STRING, rows BIGINT, bad_rows BIGINT, status STRING, reason STRING"


def _period_lines(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame, dict[str, list[str]], dict[str, str]]:
    """(file, offset, place, line) of all periods together, the files of each period, and why periods have none.

    All text files are one scan, all archives another, whose lines are stored so that no archive is unpacked twice. An archive
    that cannot be read gives a line without a place that holds the reason.
    """
    held, missing = {}, {}
    for period, path in files.items():
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip") if path.endswith(".zip") else spark.read.format("text")
        try:
            names = [n.replace(":///", ":/") for n in reader.load(path).inputFiles()]  # as rows name their files
            held[period] = [unquote(n) for n in names] if path.endswith(".zip") else names
        except AnalysisException:
            missing[period] = "no such file"
    parts = []
    texts = [p for k, p in files.items() if held.get(k) and not p.endswith(".zip")]
    zips = [p for k, p in files.items() if held.get(k) and p.endswith(".zip")]
    if texts:
        parts.append(spark.read.text(texts).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"),
                                                   F.monotonically_increasing_id().alias("place"), F.col("value").alias("line")))
    if zips:
        members, staged = read_zip_members(spark, zips, ".csv"), scratch(spark, "members")
        members.write.parquet(staged)
        parts.append(spark.read.schema(members.schema).parquet(staged).select(
            F.col("archive").alias("file"), F.lit(0).cast("bigint").alias("offset"), F.col("line_no").alias("place"), "line"))
    lines = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "file STRING, offset BIGINT, place BIGINT, line STRING")
    return lines, held, missing


def _layouts(lines: DataFrame) -> list:
    """One row per file: its header, where that stands, whether a cell may run over several lines, and why it cannot be read.

    Only the first line is kept of each file, so this passes as many rows to the driver as it has listed files.
    """
    at = F.struct("offset", "place")
    filled = F.when(F.col("place").isNotNull() & (F.trim("line") != ""), at)
    return lines.groupBy("file").agg(F.min_by("line", filled).alias("header"), F.min(filled).alias("at"),
                                     F.bool_or(F.col("place").isNotNull() & X.open_quotes(F.col("line"))).alias("breaks"),
                                     F.max(F.when(F.col("place").isNull(), F.col("line"))).alias("fault")).collect()


def _cells(spark: SparkSession, lines: DataFrame, layouts: dict[str, dict], order: list[str]) -> DataFrame:
    """The traffic columns of all lines, each found at its file's place for it; ``_too_long`` marks rows that the header does not cover.

    Headers join by file. A text file with open quotes is read by the file reader, which keeps line breaks in their
    cells, in one scan with the others of its kind; in an archive such a line is a bad row.
    """
    # Files go by their number in the order of their names: rows that are sorted and moved by it are shorter.
    table = spark.createDataFrame([(f, n, x["period"], x["width"], x["places"], *x["at"]) for n, (f, x) in enumerate(sorted(layouts.items()))],
                                  "file STRING, file_no INT, period STRING, width INT, places ARRAY<INT>, first_offset BIGINT, first_place BIGINT")
    most = max(x["width"] for x in layouts.values())

    def shaped(rows: DataFrame, cells: Column, raw: Column, wrong: Column) -> DataFrame:
        beyond = F.exists(F.slice("_cells", F.col("width") + 1, most + len(X.BEYOND)), lambda c: F.coalesce(c, F.lit("")) != "")
        rows = rows.withColumn("_cells", cells)
        named = [F.coalesce(F.get("_cells", F.get("places", F.lit(i))), F.lit("")).alias(c) for i, c in enumerate(order)]
        return rows.select(*named, F.struct("file_no", "offset", "place").alias(POSITION), "period",
                           (wrong | beyond | X.far_cell(raw, most).isNotNull()).cast("string").alias("_too_long"))

    broken = [f for f, x in layouts.items() if x["breaks"] and not f.endswith(".zip")]
    whole = lines.where(F.trim("line") != "")
    whole = whole.where(~F.col("file").isin(broken)) if broken else whole
    # The list comes from the driver, a row a file, so it is sent to the lines and no line is moved.
    rows = whole.join(F.broadcast(table), "file").where((F.col("offset") != F.col("first_offset")) | (F.col("place") != F.col("first_place")))
    rows = rows.withColumn("_parsed", F.explode(F.array(X.cells_of(F.col("line"), most))))  # parsed once, not once a cell
    out = shaped(rows, F.array(*[F.col(f"_parsed.{n}") for n in [*(f"c{i}" for i in range(most)), *X.BEYOND]]), F.col("line"), X.open_quotes(F.col("line")))
    if not broken:
        return out
    names = [*(f"c{i}" for i in range(most)), *X.BEYOND]
    fields = ", ".join(f"{n} STRING" for n in [*names, X.RAW])
    scan = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, escape='"', multiLine=True, columnPruning=False,
                              columnNameOfCorruptRecord=X.RAW).schema(fields).csv([unquote(f) for f in broken])
    scan = scan.select(*names, X.RAW, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"),
                       F.monotonically_increasing_id().alias("place")).join(F.broadcast(table), "file")
    return out.unionByName(shaped(scan, F.array(*names), F.col(X.RAW), F.lit(False)))


def load_periods(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Several period files to (rows of the good periods with their ``period``, report per period).

    A path is a text file, a folder of them, or a zip archive (or a folder ``…/*.zip``) with a ``.csv`` member. A period whose file
    is missing, broken, lacks columns, or holds one bad cell or a row longer than its header, is left out whole and reported as
    skipped; one without rows is reported as empty. However many periods there are, their headers are one job and their
    rows one scan. The checked rows are written once to the shared folder, so that neither the report nor the load
    reads the files again.
    """
    schema = S.table_schema("t100_segment")
    order, heads = schema.fieldNames(), {v: k for k, v in V.TRAFFIC_COLUMNS.items()}
    lines, held, missing = _period_lines(spark, files)
    seen = {r["file"]: r for r in _layouts(lines)}
    skipped, layouts, found = [(p, 0, 0, "skipped", why) for p, why in missing.items()], {}, []
    for period, names in sorted(held.items()):
        own, why = {}, None
        for name in names:
            r = seen.get(name)
            if r is None or (r["header"] is None and not r["fault"]):
                continue  # a file without lines
            if r["fault"]:
                why = f"broken archive: {r['fault']}"
                break
            columns = [c.strip() for c in next(csv.reader([r["header"].lstrip("\ufeff")], skipinitialspace=True))]
            lacking = [heads[c] for c in order if heads[c] not in columns]
            if lacking:
                why = f"columns {lacking} are missing"
                break
            own[name] = {"period": period, "width": len(columns), "places": [columns.index(heads[c]) for c in order], "at": r["at"], "breaks": r["breaks"]}
        if why is None and not own:
            why = "no header"
        if why:
            skipped.append((period, 0, 0, "skipped", why))
        else:
            layouts |= own
            found.append(period)
    report = spark.createDataFrame(skipped, REPORT_DDL)
    if not found:
        return spark.createDataFrame([], S.TABLE_DDL["t100_segment"] + ", period STRING"), report
    rows = _cells(spark, lines, layouts, order)
    # Cells are typed where they are read, as typed rows are shorter to move; a key is told apart by the texts of its cells.
    keys = [k if isinstance(schema[k].dataType, S.T.StringType) else f"_text_{k}" for k in S.KEYS["t100_segment"]]
    rows = rows.withColumns({k: F.col(k.removeprefix("_text_")) for k in keys if k.startswith("_text_")})
    rows = typed_load(rows, S.T.StructType([*schema.fields, *[S.T.StructField(c, S.T.StringType()) for c in (
        "period", "_too_long", *[k for k in keys if k.startswith("_text_")])]]), strict=False, keep=[POSITION])
    # A row too long is kept beside a good one of its key, so that it is seen.
    checked = keep_first(rows, ["period", *keys, "_too_long"], [POSITION]).drop(POSITION, *[k for k in keys if k.startswith("_text_")])
    staged = scratch(spark, "periods")
    checked.write.parquet(staged)
    checked = spark.read.schema(checked.schema).parquet(staged)
    key_missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in S.KEYS["t100_segment"]])
    bad = (F.size("_bad_cells") > 0) | key_missing | F.col("_too_long").cast("boolean")
    counts = {r["period"]: r for r in checked.groupBy("period").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), F.bool_or(F.col("_too_long").cast("boolean")).alias("long")).collect()}
    states = []
    for period in found:
        r = counts.get(period)
        if r is None:
            states.append((period, 0, 0, "empty", None))
        elif r["bad"]:
            states.append((period, r["rows"], r["bad"], "skipped", "rows longer than the header" if r["long"] else "bad cells"))
        else:
            states.append((period, r["rows"], 0, "loaded", None))
    good = checked.where(F.col("period").isin([s[0] for s in states if s[3] == "loaded"]))
    return good.select(*order, "period"), spark.createDataFrame([*states, *skipped], REPORT_DDL)


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """Rows written once to the shared folder, with their number and quality counts gathered on the way.

    The counts stand on the stage that writes, where a task counts once however often it is tried.
    """
    seen, staged = Observation(name), scratch(rows.sparkSession, name)
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]).write.parquet(staged)
    return rows.sparkSession.read.schema(rows.schema).parquet(staged), seen


def observed_report(spark: SparkSession, table: str, seen: Observation) -> DataFrame:
    """The report of a load from what was observed, in the form of ``load_report``."""
    got = seen.get
    fields = ", ".join(["table STRING", *(f"{n} BIGINT" for n in got)])
    return spark.createDataFrame([(table, *got.values())], fields)


def _replace(spark: SparkSession, root: str, table: str, rows: DataFrame, **counts: Column) -> DataFrame:
    """The rows are formed and counted once, into the shared folder. Missing or repeated keys fail the load before it shows."""
    rows, seen = observed(rows, table, **counts)
    stored(root, table).replace(keyed(rows, S.KEYS[table]))
    return observed_report(spark, table, seen)


class BrokenArchive(ValueError):
    """A zip archive that cannot be read to its end, or lacks the member."""


def _zip_lines(spark: SparkSession, landing: str, member: str, encoding: str = "UTF-8-SIG") -> DataFrame:
    """Stored lines of a member: an archive is unpacked once, and one that cannot be read ends the load."""
    members, staged = read_zip_members(spark, landing, member, encoding), scratch(spark, "members")
    members.write.parquet(staged)
    members = spark.read.schema(members.schema).parquet(staged)
    broken = bad_archives(members).first()
    if broken:
        raise BrokenArchive(f"{broken['archive']}: {broken['reason']}")
    return members


def landed_table(spark: SparkSession, landing: str, member: str) -> DataFrame:
    """A landed table with its source order: a text file, a folder of them, or zip archives that hold it as a member."""
    if not landing.endswith(".zip"):
        return X.read_text_table(spark, landing, position=True)
    return packed_table(_zip_lines(spark, landing, member))


def packed_table(lines: DataFrame) -> DataFrame:
    """The table of a zip member's lines, with all columns of its header."""
    header = lines.where("line_no = 0").select("line").first()
    if header is None:
        raise KeyError("no header")
    names = [n.strip() for n in next(csv.reader([header["line"]], skipinitialspace=True))]
    rows = member_table(lines, [n for n in dict.fromkeys(names) if n])
    return rows.withColumn(POSITION, F.struct(F.col("_position.archive").alias("file"), F.lit(0).cast("bigint").alias("offset"),
                                               F.col("_position.line_no").alias("place")))


def ingest_registry(spark: SparkSession, landing: str, root: str) -> DataFrame:
    """``landing`` is the file or the publisher's archive."""
    return _replace(spark, root, "faa_registry", clean_registry(landed_table(spark, landing, "MASTER.txt")))


def ingest_reference(spark: SparkSession, landing: str, root: str) -> DataFrame:
    return _replace(spark, root, "aircraft_ref", clean_reference(landed_table(spark, landing, "ACFTREF.txt")))


def ingest_certificates(spark: SparkSession, landing: str, root: str) -> DataFrame:
    operators, tails = clean_certificates(X.read_banner_table(spark, landing, position=True))
    return _replace(spark, root, "operators", operators).unionByName(
        _replace(spark, root, "part135_aircraft", tails))


def ingest_airports(spark: SparkSession, landing: str, root: str) -> DataFrame:
    """``landing`` holds the folders ``airports`` and ``runways``. The report also says how many airports jets can use."""
    def scan(name):
        return X.read_text_table(spark, f"{landing}/{name}", position=True, multi_line=False)
    loads = {name: observed(clean(scan(name)), name) for name, clean in (("airports", clean_airports), ("runways", clean_runways))}
    for name, (rows, _) in loads.items():
        stored(root, name).replace(keyed(rows, S.KEYS[name]))
    jets = jet_capable(Tables.of(**{name: rows for name, (rows, _) in loads.items()})).first()[0]
    reports = [observed_report(spark, name, seen) for name, (_, seen) in loads.items()]
    return reports[0].withColumn("jet_capable_4000ft", F.lit(jets).cast("bigint")).unionByName(reports[1], allowMissingColumns=True)


def ingest_airport_detail(spark: SparkSession, landing: str, root: str) -> DataFrame:
    lines = (_zip_lines(spark, landing, "APT.txt", "ISO-8859-1").select(F.col("line").alias("value")) if landing.endswith(".zip")
             else X.read_lines(spark, landing))
    rows = clean_airport_detail(lines)
    jets = F.col("based_jet")
    return _replace(spark, root, "faa_airport_detail", rows, airports_with_jets=F.count_if(jets > 0),
                    total_based_jets=F.coalesce(F.sum(jets), F.lit(0)).cast("bigint"))


def ingest_aircraft_types(spark: SparkSession, landing: str, root: str) -> DataFrame:
    rows = typed_load(X.read_code_lookup(spark, landing), S.table_schema("aircraft_type_ref"))
    return _replace(spark, root, "aircraft_type_ref", rows)


def ingest_traffic(spark: SparkSession, files: dict[str, str], root: str) -> DataFrame:
    """Good periods are upserted in one step; the report says which were skipped."""
    rows, report = load_periods(spark, files)
    target = stored(root, "t100_segment", ("year", "month"))
    # Periods load newest first, so of one key in two files the oldest file has the last word.
    target.upsert(rows, S.UPDATE_COLUMNS["t100_segment"], order=[F.col("period").asc()], kept=True)
    return report


def ingest_photos(spark: SparkSession, landing: str, root: str) -> DataFrame:
    """Photo answers: "no photo" is stored too, a failed fetch is not and stays in the backlog."""
    answers = read_photo_answers(spark, landing)
    answers, seen = observed(answers, "photos", processed=F.count_if("fetched_ok"),
                             photos=F.count_if(F.col("fetched_ok") & F.col("local_path").isNotNull()), errors=F.count_if(~F.col("fetched_ok")))
    target = stored(root, "aircraft_photos")
    target.upsert(photo_results(answers, F.current_timestamp()), S.UPDATE_COLUMNS["aircraft_photos"],
                  order=[F.col("photo_id").desc_nulls_last()])
    return observed_report(spark, "aircraft_photos", seen)


def _ingest_messages(messages: DataFrame, root: str, update_cols: list[str]) -> DataFrame:
    """Of several copies of one message in a landing the last one counts. Messages are decoded once."""
    messages, seen = observed(messages, "messages")
    stored(root, "emails").upsert(messages, update_cols, order=[F.col(POSITION).desc()], kept=True)
    return observed_report(messages.sparkSession, "emails", seen)


def ingest_mail(spark: SparkSession, landing: str, root: str) -> DataFrame:
    """Messages of one account."""
    return _ingest_messages(read_mail_json(spark, landing, position=True), root, S.UPDATE_COLUMNS["emails"])


def ingest_mailboxes(spark: SparkSession, landing: str, root: str) -> DataFrame:
    """Messages of all accounts: ``landing`` holds one folder ``mailbox=<address>`` per account."""
    lines = spark.read.text(landing).select("value", "mailbox", X.file_position().alias(POSITION))
    rows = message_rows(lines, mailbox=F.col("mailbox"), keep=[POSITION])
    return _ingest_messages(rows, root, S.UPDATE_COLUMNS["emails_domain_wide"])


#: Weather feeds: the table each goes to, its kind of record, and the columns that name a record.
WEATHER_FEEDS = {"metar": ("metar", "metar", "report_id"), "taf": ("taf", "taf", "taf_id"), "airsigmet": ("hazards", "hazard", "hazard_id"),
                 "isigmet": ("hazards", "hazard", "hazard_id"), "pirep": ("pireps", "pirep", "report_id")}


def weather_table(spark: SparkSession, root: str, feed: str) -> StoredTable:
    """The stored table of a feed; hazards of both feeds share one and say which they come from."""
    table, kind, key = WEATHER_FEEDS[feed]
    schema = weather_rows(spark.createDataFrame([], WEATHER[kind]), kind).schema
    if table == "hazards":
        schema = S.T.StructType([*schema.fields, S.T.StructField("feed", S.T.StringType())])
    return StoredTable(f"{root}/{table}", schema, (key,))


def ingest_weather(spark: SparkSession, landing: str, root: str, feed: str) -> DataFrame:
    """Records of one feed, one per line. A record that is there already, or lands twice, is one; others are added."""
    table, kind, key = WEATHER_FEEDS[feed]
    rows = weather_rows(read_weather_json(spark, landing, kind), kind)
    rows, seen = observed(rows.withColumn("feed", F.lit(feed)) if table == "hazards" else rows, feed)
    weather_table(spark, root, feed).upsert(rows, [c for c in rows.columns if c != key], order=[F.to_json(F.struct(*rows.columns))])
    return observed_report(spark, table, seen)


INGESTS = {
    "faa_registry": ingest_registry,
    "faa_reference": ingest_reference,
    "faa_part135": ingest_certificates,
    "t100_segment": ingest_traffic,
    "bts_aircraft_types": ingest_aircraft_types,
    "ourairports": ingest_airports,
    "faa_airports": ingest_airport_detail,
    "photos": ingest_photos,
    "mail": ingest_mail,
    "mailboxes": ingest_mailboxes,
    **{feed: partial(ingest_weather, feed=feed) for feed in WEATHER_FEEDS},
}
