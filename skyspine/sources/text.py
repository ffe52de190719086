"""Scans of landed text files. Every cell is text; types come later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyspine.functions.clean import na_text_to_blank, strip

POSITION = "_position"


def file_position() -> Column:
    """Order of a row in its source: file, offset of its split, place within the split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"),
                    F.monotonically_increasing_id().alias("place"))


EXTRA = "_extra"
#: Cells beyond the header that are named. Blank ones hold nothing and are no fault; ``far_cell`` finds filled ones farther out.
BEYOND = [f"{EXTRA}{i}" for i in range(16)]
RAW = "_raw_row"
#: One cell of a row with the delimiter before it: quoted, or anything up to the next delimiter.
CELL = r'(?:^|,)(\s*"(?:[^"]|"")*"\s*(?=,|$)|[^,]*)'


def far_cell(raw: Column, width: int) -> Column:
    """The first filled cell that stands behind the named ones, else NULL; only rows with that many delimiters are cut up."""
    cells = F.transform(F.regexp_extract_all(raw, F.lit(CELL), 1), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    behind = F.filter(F.slice(cells, width + len(BEYOND) + 1, 1 << 20), lambda c: c != "")
    commas = F.length(raw) - F.length(F.replace(raw, F.lit(","), F.lit("")))
    return F.when(commas >= width + len(BEYOND), F.get(behind, F.lit(0)))


def open_quotes(line: Column) -> Column:
    """Whether a line holds an odd number of quotes, as one must in which a cell with a line break begins."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def refused(wrong: Column, why: str, row: Column) -> Column:
    """A condition that holds for every row and fails on a wrong one."""
    return F.when(wrong, F.raise_error(F.concat(F.lit(why), row)).cast("boolean")).otherwise(F.lit(True))


def read_text_table(spark: SparkSession, path: str | list[str], position: bool = False, pandas_na: bool = False,
                    multi_line: bool | None = None, keep_leading_space: bool = False, strict: bool = True) -> DataFrame:
    """Delimited file with a header: all cells text, header names trimmed, missing cells blank.

    Blanks after a delimiter are skipped unless ``keep_leading_space``. ``pandas_na`` also blanks texts such as ``NA``, which
    loses real codes and is therefore off by default. ``position`` adds the source order. A row with a filled cell beyond the
    header fails the scan; without ``strict`` it stays, and the column ``_extra`` holds that cell and is NULL elsewhere.
    Line breaks inside quotes belong to their cell, and a file with such breaks is one task. Whether there may be any is
    found by a pass that counts quotes, unless ``multi_line`` says it; files without are split.
    """
    if multi_line is None:
        multi_line = not spark.read.text(path).where(open_quotes(F.col("value"))).isEmpty()
    options = {"header": True, "ignoreLeadingWhiteSpace": not keep_leading_space, "escape": '"', "multiLine": multi_line}
    names = spark.read.options(**options).csv(path).columns
    numbers = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*numbers, *BEYOND, RAW]])
    # Without pruning the parser sees whole rows, whatever columns are asked for.
    scan = spark.read.options(**options, columnPruning=False, columnNameOfCorruptRecord=RAW).schema(schema).csv(path)
    cell = na_text_to_blank if pandas_na else (lambda c: F.coalesce(c, F.lit("")))
    cells = [cell(F.col(n)).alias(name.strip()) for n, name in zip(numbers, names)]
    place = [file_position().alias(POSITION)] if position else []
    extra = F.coalesce(*BEYOND, far_cell(F.col(RAW), len(names)))
    if not strict:
        return scan.select(*cells, extra.alias(EXTRA), *place)
    row = F.concat_ws(",", *numbers, extra)
    return scan.where(refused(extra.isNotNull(), "more cells than the header: ", row)).select(*cells, *place)


def find_column(columns: list[str], alternatives: list[tuple[str, ...]]) -> str:
    """The first column whose name holds all words of the first alternative that fits any column."""
    for words in alternatives:
        for name in columns:
            if all(w in name.strip().lower() for w in words):
                return name
    raise KeyError(f"no column for {alternatives} among {columns}")


def resolve_columns(df: DataFrame, wanted: dict[str, list[tuple[str, ...]]], keep: list[str] | None = None) -> DataFrame:
    """Project to the wanted columns, found by words in their headers."""
    names = [c for c in df.columns if c != POSITION]
    picked = [F.col(f"`{find_column(names, words)}`").alias(target) for target, words in wanted.items()]
    return df.select(*picked, *[F.col(c) for c in keep or []])


def read_banner_table(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """Delimited file whose first line is a title banner and whose second line is the header.

    The first two lines of the landing name the columns; a file that begins with one or both of them has them left out there,
    and nowhere else. Rows with more cells than the header, or with a quote that does not end in their line, fail the scan.
    """
    lines = spark.read.text(path).select("value", file_position().alias(POSITION))
    at_start = lines.where(F.col(f"{POSITION}.offset") == 0)
    banner, header = [r["value"] for r in at_start.limit(2).collect()]
    empty = spark.range(1).select(F.schema_of_csv(F.lit(header)))
    width = len(T.StructType.fromDDL(empty.first()[0][len("STRUCT<"):-1]).fields)
    names_row = spark.range(1).select(F.from_csv(F.lit(header), ", ".join(f"c{i} STRING" for i in range(width)),
                                                   {"escape": '"', "ignoreLeadingWhiteSpace": "true"})).first()
    names = [(n or f"_c{i}").strip() for i, n in enumerate(names_row[0])]
    fields = ", ".join(f"`c{i}` STRING" for i in range(width))
    # One row per file: the place of its first line. Only lines that read like a title are looked up there; others are not moved.
    starts = at_start.groupBy(F.col(f"{POSITION}.file").alias("_file")).agg(F.min(f"{POSITION}.place").alias("_first"))
    titled = (F.col(f"{POSITION}.offset") == 0) & F.col("value").isin(banner, header)
    alike = lines.where(titled).join(starts, F.col(f"{POSITION}.file") == F.col("_file"))
    alike = alike.where(F.col(f"{POSITION}.place") - F.col("_first") >= 2).select("value", POSITION)
    body = lines.where(~titled).unionByName(alike)
    keep = [POSITION] if position else []
    return parse_lines(body, "value", fields, keep).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *keep)


def cells_of(line: Column, width: int) -> Column:
    """Cells of a delimited line by place, as a struct of ``width`` cells and those beyond."""
    fields = ", ".join(f"{n} STRING" for n in [*(f"c{i}" for i in range(width)), *BEYOND])
    return F.from_csv(line, fields, {"escape": '"', "ignoreLeadingWhiteSpace": "true", "columnPruning": "false"})


def parse_lines(lines: DataFrame, column: str, fields: str, keep: list[str]) -> DataFrame:
    """Cells of delimited lines, missing ones blank; lines with too many cells or an open quote fail."""
    names = [f.name for f in T.StructType.fromDDL(fields).fields]
    # The one-element array parses a line once; a plain column would be parsed anew for every cell that the filter looks at.
    rows = lines.select(F.explode(F.array(cells_of(F.col(column), len(names)))).alias("r"), F.col(column).alias("_line"), *keep)
    beyond = F.coalesce(*[F.col(f"r.{n}") for n in BEYOND], far_cell(F.col("_line"), len(names)))
    rows = rows.where(refused(beyond.isNotNull() | open_quotes(F.col("_line")), "no row of the header's cells: ", F.col("_line")))
    return rows.select(*[F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)], *keep)


def read_lines(spark: SparkSession, path: str | list[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Whole lines as ``value`` in a single-byte encoding."""
    return (spark.read.schema("value STRING").option("sep", "\u0001").option("quote", "").option("escape", "")
            .option("encoding", encoding).csv(path))


def filter_record_type(lines: DataFrame, tag: str, column: str = "value") -> DataFrame:
    """Lines that start with the record tag."""
    return lines.where(F.substring(F.col(column), 1, len(tag)) == F.lit(tag))


def slice_fixed_width(lines: DataFrame, layout: dict[str, tuple[int, int]], column: str = "value") -> DataFrame:
    """Named fields cut from each line at (1-based start, length) and trimmed."""
    return lines.select(*[strip(F.substring(F.col(column), start, length)).alias(name)
                          for name, (start, length) in layout.items()])


def read_fixed_width(spark: SparkSession, path: str | list[str], layout: dict[str, tuple[int, int]],
                     tag: str | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    lines = read_lines(spark, path, encoding)
    return slice_fixed_width(filter_record_type(lines, tag) if tag else lines, layout)


def project_rename(df: DataFrame, mapping: dict[str, str], order: list[str] | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """Mapped columns only, renamed, in the target order; header names are compared trimmed."""
    present = {c.strip(): c for c in df.columns}
    missing = [src for src in mapping if src not in present]
    if missing:
        raise KeyError(f"columns {missing} are missing")
    source = {target: present[src] for src, target in mapping.items()}
    return df.select(*[F.col(f"`{source[c]}`").alias(c) for c in order or list(source)],
                     *[F.col(c) for c in keep or []])


def read_code_lookup(spark: SparkSession, path: str, code: str = "Code", description: str = "Description") -> DataFrame:
    """Two-column lookup: both trimmed, rows without a code dropped."""
    table = read_text_table(spark, path, keep_leading_space=True)
    return table.select(strip(F.col(code)).alias("code"), strip(F.col(description)).alias("description")).where(
        F.col("code") != "")
