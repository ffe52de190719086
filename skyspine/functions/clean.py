"""Cell cleaning: trimming, keys, yes/no, numbers, blanks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V


def strip(col: Column) -> Column:
    """Remove all white space at both ends, not only blanks."""
    return F.btrim(col, F.lit(V.WHITESPACE))


def strip_all(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Trim the named text columns (all text columns by default) in one projection."""
    chosen = set(columns or [name for name, kind in df.dtypes if kind == "string"])
    return df.select(*[strip(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def norm_tail(col: Column) -> Column:
    """Registration mark: trimmed, upper-case, exactly one leading N; blank and NULL give blank."""
    mark = F.upper(strip(F.coalesce(col, F.lit(""))))
    return F.when(mark == "", mark).otherwise(F.concat(F.lit("N"), F.ltrim(mark, F.lit("N"))))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def na_text_to_blank(col: Column) -> Column:
    """Cells that a data-frame reader would take for missing become blank."""
    return F.when(col.isNull() | col.isin(V.NA_TEXTS), F.lit("")).otherwise(col)


def yes_no(col: Column) -> Column:
    word = F.lower(strip(col))
    return F.when(word.isin(V.YES), F.lit(True)).when(word.isin(V.NO), F.lit(False))


def int_or_zero(col: Column) -> Column:
    digits = col.rlike("^[0-9]+$")
    return F.when(digits, col.try_cast("int")).otherwise(F.lit(0))


def row_total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def nonblank(col: Column) -> Column:
    """Predicate: neither NULL nor the empty string."""
    return col.isNotNull() & (col != "")


def drop_blank_key(df: DataFrame, *keys: str) -> DataFrame:
    """Keep rows whose keys hold something besides white space."""
    return df.where(reduce(lambda a, b: a & b, [strip(F.col(k)) != "" for k in keys]))


def upper_code(col: Column) -> Column:
    return F.upper(col)


def truncate_text(col: Column, chars: int) -> Column:
    return F.substring(col, 1, chars)


def first_nonblank(*cols: Column) -> Column:
    """The first value that is neither NULL nor blank; the last one is returned as it is."""
    return F.coalesce(*[blank_to_null(c) for c in cols[:-1]], cols[-1])
