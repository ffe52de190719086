"""Explicit null order: ascending puts NULL last, descending puts it first, unless asked otherwise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyspine.session import scratch


def up(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).asc_nulls_last()


def down(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).desc_nulls_first()


def down_nulls_last(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).desc_nulls_last()


#: From this offset on a page is found by counting ranges first.
DEEP = 100_000


def page(df: DataFrame, order: list[Column], limit: int, cap: int | None = None, offset: int = 0) -> DataFrame:
    """One page of a sorted result. The order should end in a unique key. Far pages are found by ``deep_page``."""
    size = limit if cap is None else min(limit, cap)
    if offset >= DEEP:
        return deep_page(df, order, size, offset)
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(size)


def deep_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page far from the start. The rows are dealt into ranges of the order and counted by range; only the ranges that hold
    the page are sorted, so no task handles the rows before it.

    The ranges are stored in the shared folder, as they are drawn from a sample and must be the same for both looks.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    ranges = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranges.write.partitionBy("_range").parquet(path)
    kept = spark.read.schema(ranges.schema).parquet(path)
    before, held = 0, []
    for number, n in sorted((r["_range"], r["count"]) for r in kept.groupBy("_range").count().collect()):
        if before + n > offset and before < offset + limit:
            held.append((number, before))
        before += n
    if not held:
        return df.limit(0)
    rows = kept.where(F.col("_range").isin([number for number, _ in held])).drop("_range")
    return rows.orderBy(*order).offset(offset - held[0][1]).limit(limit)


@dataclass(frozen=True)
class Key:
    """A column of an order, for pages that begin after a row."""
    name: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        col = F.col(self.name)
        if self.descending:
            return col.desc_nulls_first() if self.nulls_first else col.desc_nulls_last()
        return col.asc_nulls_first() if self.nulls_first else col.asc_nulls_last()

    def beyond(self, value: object) -> Column:
        """Whether the column stands after the value in this order."""
        col = F.col(self.name)
        if value is None:
            return col.isNotNull() if self.nulls_first else F.lit(False)
        later = col < F.lit(value) if self.descending else col > F.lit(value)
        return F.coalesce(later, F.lit(not self.nulls_first))


def page_after(df: DataFrame, keys: list[Key], limit: int, after: tuple | None = None) -> DataFrame:
    """The page that follows the row with the key values ``after``; the first page without it.

    The place is a filter, which can reach the scan, so the cost does not grow with the pages before. The keys together must be unique.
    """
    if after is not None:
        same, beyond = F.lit(True), F.lit(False)
        for key, value in zip(keys, after, strict=True):
            beyond = beyond | (same & key.beyond(value))
            same = same & F.col(key.name).eqNullSafe(F.lit(value))
        df = df.where(beyond)
    return df.orderBy(*[k.order() for k in keys]).limit(limit)


def top_k_nulls_last(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return page(df, [down_nulls_last(by), *[up(t) for t in ties]], k)


def latest_n(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    """The newest n rows."""
    return page(df, [down(ts), down(tie)], n)


def order_by_flag(df: DataFrame, flag: Column, *ties: str, nulls_last: bool = True) -> DataFrame:
    """Rows for which the flag holds come first."""
    return df.orderBy(down_nulls_last(flag) if nulls_last else down(flag), *[up(t) for t in ties])


def sort_by_any(df: DataFrame, key: str, kind: str, descending: bool, *ties: str) -> DataFrame:
    """Sort by a key the caller picked: numbers fall back to 0, text treats NULL as blank."""
    if kind == "num":
        col = F.coalesce(F.col(key).try_cast("double"), F.lit(0.0))
    else:
        col = F.collate(F.coalesce(F.col(key).cast("string"), F.lit("")), "UNICODE")
    return df.orderBy(col.desc() if descending else col.asc(), *[up(t) for t in ties])


def first_item(array: Column) -> Column:
    """First element in source order, NULL when there is none."""
    return F.try_element_at(array, F.lit(1))


def first_n_items(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)
