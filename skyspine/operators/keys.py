"""Keys: first row wins, insert if absent, typed loads, violations, parents with children."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in the given order.

    The filter on the row number lets Spark cut each key to one row before the exchange, so a key that
    holds a large share of all rows does not reach one task whole.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def insert_if_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Target plus those batch keys it lacks; within the batch the first row wins."""
    fresh = keep_first(batch, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def typed_load(df: DataFrame, schema: T.StructType, blank_as_null: bool = True, strict: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Text cells to declared types; columns to ``keep`` stay as they are.

    ``strict`` lets one bad cell fail the load. Otherwise a bad cell becomes NULL and ``_bad_cells``
    names its column, so that rejects can be split off. A number with more decimals than its column holds is a bad cell.
    """
    def rounded(raw: Column, field: T.StructField) -> Column:
        """Whether the column would hold another number than the cell."""
        if not isinstance(field.dataType, T.DecimalType):
            return F.lit(False)
        return F.coalesce(raw.try_cast(field.dataType) != raw.try_cast(T.DecimalType(38, 18)), F.lit(False))

    def cell(field: T.StructField) -> Column:
        raw = F.col(field.name)
        if blank_as_null:
            raw = F.nullif(raw, F.lit(""))
        if isinstance(field.dataType, T.StringType):
            return raw.alias(field.name)
        if not strict:
            return F.when(~rounded(raw, field), raw.try_cast(field.dataType)).alias(field.name)
        value = raw.cast(field.dataType)
        if isinstance(field.dataType, T.DecimalType):
            value = F.when(rounded(raw, field), F.raise_error(F.concat(F.lit(f"{field.name} has too many decimals: "), raw)).cast(field.dataType)).otherwise(value)
        return value.alias(field.name)

    def bad(field: T.StructField) -> Column:
        raw = F.nullif(F.col(field.name), F.lit(""))
        return F.when(raw.isNotNull() & (raw.try_cast(field.dataType).isNull() | rounded(raw, field)), F.lit(field.name))

    cells = [*[cell(f) for f in schema.fields], *(keep or [])]
    if strict:
        return df.select(*cells)
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    flags = F.array_compact(F.array(*[bad(f) for f in typed])) if typed else F.array().cast("array<string>")
    return df.select(*cells, flags.alias("_bad_cells"))


def rejects(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.size("_bad_cells") > 0)


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.size("_bad_cells") == 0).drop("_bad_cells")


def check_keys(df: DataFrame, keys: list[str], parent: DataFrame | None = None,
               parent_key: dict[str, str] | None = None, not_null: list[str] | None = None) -> DataFrame:
    """Key violations as (violation, key_text, n): duplicate keys, NULLs, and children without a parent.

    ``parent_key`` maps a column here to its column in ``parent``.
    """
    def report(rows: DataFrame, name: str, columns: list[str], least: int = 1) -> DataFrame:
        """Grouped by the columns themselves; the text is formed for the violators only."""
        key_text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])
        groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
        return groups.select(F.lit(name).alias("violation"), key_text.alias("key_text"), F.col("_n").alias("n"))

    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    parts = [report(df.where(has_key), "duplicate", keys, least=2)]
    for column in not_null or keys:
        parts.append(report(df.where(F.col(column).isNull()), f"null {column}", keys))
    if parent is not None:
        for child, own in (parent_key or {}).items():
            # Both sides hold a key once before they meet.
            known = parent.select(F.col(own).alias(child)).distinct()
            used = df.where(F.col(child).isNotNull()).groupBy(child).agg(F.count(F.lit(1)).alias("n")).join(known, child, "left_anti")
            parts.append(used.select(F.lit(f"no parent {child}").alias("violation"), F.col(child).cast("string").alias("key_text"), "n"))
    return reduce(DataFrame.unionByName, parts)


class KeyViolation(ValueError):
    """A load whose rows break the key of their table."""


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` if every key is there and unique, by one aggregate; else the load fails with the first violations."""
    lacking = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(f"null {k}")) for k in keys])
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | lacking.isNotNull())
    broken = groups.select(F.coalesce(lacking, F.lit("duplicate")).alias("violation"), text.alias("key_text"), "n").limit(10).collect()
    if broken:
        raise KeyViolation(f"key ({', '.join(keys)}): " + "; ".join(f"{r['violation']} {r['key_text']} x {r['n']}" for r in broken))
    return df


def parents_with_children(parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    """``parents LEFT JOIN children`` for a parent that may own a large share of all children.

    The matched part is an inner join, which the adaptive planner can split on either side; parents
    without children are appended.
    """
    matched = children.join(parents, on)
    lone = parents.join(children.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(lone, allowMissingColumns=True)
