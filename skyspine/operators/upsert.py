"""Upserts: overwrite only listed columns on a key match, keep everything else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyspine.operators.keys import keep_first


def upsert_partial(target: DataFrame, batch: DataFrame, keys: list[str], update_cols: list[str],
                   order: list[Column | str] | None = None) -> DataFrame:
    """Target after the batch: new keys inserted, matched rows get ``update_cols`` from the batch.

    ``order`` says which of several batch rows with one key counts; without it the batch keys must be
    unique. Both sides hold each key once, so the join cannot meet a hot key.
    """
    rows = keep_first(batch, keys, order) if order else batch
    columns = target.columns
    old = target.select(*keys, F.struct(*columns).alias("_old"))
    new = rows.select(*keys, F.struct(*columns).alias("_new"))
    joined = old.join(new, keys, "full_outer")

    def value(name: str) -> Column:
        first, second = ("_new", "_old") if name in update_cols else ("_old", "_new")
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.{name}")).otherwise(F.col(f"{second}.{name}"))

    return joined.select(*[F.col(c) if c in keys else value(c).alias(c) for c in columns])


def upsert_all(target: DataFrame, batch: DataFrame, keys: list[str],
               order: list[Column | str] | None = None) -> DataFrame:
    """Upsert of every column that is not a key."""
    return upsert_partial(target, batch, keys, [c for c in target.columns if c not in keys], order)


def photo_results(answers: DataFrame, as_of: Column) -> DataFrame:
    """Rows to upsert from photo answers: "no photo" is a result, a failed fetch (NULL status) is not."""
    return answers.where(F.col("fetched_ok")).drop("fetched_ok").withColumn("fetched_at", as_of)


def mark_read(notifications: DataFrame) -> DataFrame:
    """Set the flag on all rows where it is not set; a missing flag stays missing."""
    return notifications.withColumn("read", F.when(~F.col("read"), F.lit(True)).otherwise(F.col("read")))
