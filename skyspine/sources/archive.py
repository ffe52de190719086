"""Zip archives: the lines of one member each."""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspine.sources.text import parse_lines

LINES_PER_BATCH = 20000
#: What a member that is broken inside raises while it is read.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError)


def member_lines(archives: DataFrame, suffix: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(archive, member, line_no, line, layout, whole) of the first member with the suffix in each archive (path, content).

    ``layout`` is a digest of the member's first line, and ``whole`` says that the member can be read to its end: it is unpacked
    once beforehand. So no later step has to bring the lines of an archive together.

    Archives are opened in parallel; within one the lines are streamed in batches. An archive without
    such a member, or one that cannot be opened or read to its end, gives a row with NULL ``line_no`` and the reason; of
    one broken inside the lines before the break come too, and ``good_lines`` leaves them out. One archive is one
    task and lies in memory whole, as zip asks for.
    """
    def frame(archive, member, numbers, texts, layout=None, whole=False):
        return pd.DataFrame({"archive": archive, "member": member,
                             "line_no": pd.array(numbers, dtype="Int64"), "line": texts, "layout": layout, "whole": whole})

    def readable(bundle, member) -> bool:
        try:
            with bundle.open(member) as raw:
                while raw.read(1 << 20):
                    pass
        except BROKEN:
            return False
        return True

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                try:
                    bundle = zipfile.ZipFile(io.BytesIO(content))
                    member = next((n for n in bundle.namelist() if n.lower().endswith(suffix.lower())), None)
                    if member is None:
                        raise FileNotFoundError(f"no member ends with {suffix}")
                except (zipfile.BadZipFile, FileNotFoundError) as why:
                    yield frame(archive, None, [None], [str(why)])
                    continue
                whole, layout = readable(bundle, member), None
                try:
                    with bundle.open(member) as raw:
                        numbered = enumerate(io.TextIOWrapper(raw, encoding=encoding))
                        while chunk := list(itertools.islice(numbered, LINES_PER_BATCH)):
                            layout = layout or hashlib.md5(chunk[0][1].rstrip("\n").encode()).hexdigest()
                            yield frame(archive, member, [i for i, _ in chunk], [x.rstrip("\n") for _, x in chunk], layout, whole)
                except BROKEN as why:  # broken inside
                    yield frame(archive, None, [None], [str(why)])

    return archives.select("path", "content").mapInPandas(
        lines, "archive STRING, member STRING, line_no BIGINT, line STRING, layout STRING, whole BOOLEAN")


def read_zip_members(spark: SparkSession, path: str | list[str], suffix: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """The same for the archives in a folder."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return member_lines(archives, suffix, encoding)


def good_lines(members: DataFrame) -> DataFrame:
    """Lines of the archives that were read whole."""
    return members.where(F.col("line_no").isNotNull() & F.col("whole"))


def bad_archives(members: DataFrame) -> DataFrame:
    return members.where(F.col("line_no").isNull()).select("archive", F.col("line").alias("reason"))


def member_table(members: DataFrame, columns: list[str]) -> DataFrame:
    """Delimited member lines to text columns, found by the header line of their archive.

    The position is (archive, line number), so the first of several equal keys can be told. The distinct headers, one
    for each layout the publisher used, are looked at beforehand; a header without one of the columns is an error.
    """
    lines = good_lines(members).withColumn("_position", F.struct("archive", "line_no"))
    headers = lines.where("line_no = 0").select(F.col("line").alias("_header"), "layout")
    parts = []
    for header, layout in headers.distinct().sort("_header").collect():
        names = [n.strip() for n in next(csv.reader([header], skipinitialspace=True))]
        missing = [c for c in columns if c.strip() not in names]
        if missing:
            raise KeyError(f"columns {missing} are missing in {header!r}")
        body = lines.where((F.col("line_no") > 0) & (F.col("layout") == F.lit(layout)))
        cells = parse_lines(body, "line", ", ".join(f"c{i} STRING" for i in range(len(names))), ["_position"])
        parts.append(cells.select(*[F.col(f"c{names.index(c.strip())}").alias(c.strip()) for c in columns], "_position"))
    if not parts:
        empty = lines.select(*[F.lit("").alias(c.strip()) for c in columns], "_position")
        return empty.limit(0)
    return reduce(DataFrame.unionByName, parts)
