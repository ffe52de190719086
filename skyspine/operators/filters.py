"""Row filters: text search and conjunctions of the predicates a caller gave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.text import contains


def search_any(df: DataFrame, words: str, *columns: str) -> DataFrame:
    """Rows where any of the columns contains the words, without regard to case."""
    return df.where(reduce(lambda a, b: a | b, [contains(F.col(c), words) for c in columns]))


def search_one(df: DataFrame, words: str, column: str) -> DataFrame:
    return df.where(contains(F.col(column), words))


def optional_filters(df: DataFrame, *given: tuple[object, Column]) -> DataFrame:
    """All predicates whose argument was given; an empty, zero or absent argument adds nothing."""
    return reduce(lambda rows, g: rows.where(g[1]) if g[0] else rows, given, df)


def exclude_types(df: DataFrame, column: str = "type") -> DataFrame:
    """Landplane airports only; a missing type is dropped as well."""
    return df.where(~F.col(column).isin(V.NOT_LANDPLANE))


def min_threshold(df: DataFrame, column: str, least: int) -> DataFrame:
    """At least so much; zero means no filter, so rows without a value stay."""
    return optional_filters(df, (least, F.col(column) >= F.lit(least)))


def point_lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows by key value."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def flag_filter(df: DataFrame, flag: str, value: bool = True) -> DataFrame:
    return df.where(F.col(flag) if value else ~F.col(flag))


def either_code(df: DataFrame, code: str, first: str = "iata_code", second: str = "local_code") -> DataFrame:
    return df.where((F.col(first) == F.lit(code)) | (F.col(second) == F.lit(code)))


def positive_only(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) > 0)
