"""Stored tables on plain Parquet: atomic replace and upserts that rewrite only touched partitions.

A table is a folder with data generations and a commit log. Rows of a generation are invisible until its
commit file is there, so a failed or repeated load never shows half a table, and readers keep what they
opened. One writer at a time is assumed. Partition columns are folders, so filters on them choose the files to open.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyspine.operators.keys import KeyViolation, keep_first
from skyspine.operators.upsert import upsert_partial
from skyspine.session import scratch

COMMIT_DDL = "generation BIGINT, shard STRING, replaces BOOLEAN, source STRING, batch BIGINT, buckets INT"
#: Hash buckets of a new table for which no number is given.
BUCKETS = 16


@dataclass(frozen=True)
class StoredTable:
    """``part_columns`` name the partitioning (numbers or dates, such as year and month); without them rows are spread over
    hash buckets of the key, so that an upsert of few keys rewrites few buckets.

    The number of buckets is settled by the first commit and kept in the log; ``buckets`` may be left out afterwards, and
    any other number is an error. Choose it so that one bucket is a few GB.
    """
    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    part_columns: tuple[str, ...] = ()
    buckets: int | None = None

    def bucket_count(self, spark: SparkSession) -> int:
        kept = self.commits(spark).agg(F.max("buckets")).first()[0]
        if kept is None:
            return self.buckets or BUCKETS
        if self.buckets not in (None, kept):
            raise ValueError(f"{self.root} has {kept} buckets, not {self.buckets}")
        return kept

    def _part(self, spark: SparkSession) -> Column:
        if self.part_columns:
            return F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in self.part_columns])
        return F.concat(F.lit("b"), F.pmod(F.xxhash64(*self.keys), F.lit(self.bucket_count(spark))).cast("string"))

    def commits(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema(COMMIT_DDL).json(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], COMMIT_DDL)

    def live(self, spark: SparkSession) -> DataFrame:
        """(shard, generation) now valid: the newest of each part since the last full replace."""
        log = self.commits(spark)
        since = log.where("replaces").agg(F.coalesce(F.max("generation"), F.lit(0)).alias("g")).scalar()
        return (log.where(F.col("shard").isNotNull() & (F.col("generation") >= since))
                .groupBy("shard").agg(F.max("generation").alias("generation")))

    def read(self, spark: SparkSession, parts: DataFrame | None = None) -> DataFrame:
        """The table, or only the given parts (a column ``shard``).

        The list of live folders is metadata of one row per partition; it becomes the scan's file list.
        """
        live = self.live(spark)
        if parts is not None:
            live = live.join(parts, "shard", "left_semi")
        folders = [f"{self.root}/data/generation={g}/shard={p}" for p, g in
                   live.select("shard", "generation").sort("shard").collect()]
        if not folders:
            return spark.createDataFrame([], self.schema).limit(0)  # which the planner knows to be empty
        names = [f.name for f in self.schema.fields]
        return spark.read.option("basePath", f"{self.root}/data").schema(self.schema).parquet(*folders).select(*names)

    def dead(self, spark: SparkSession) -> DataFrame:
        """(shard, generation) that no reader opened from now on will read: what may be deleted once older readers are done."""
        return self.commits(spark).where("shard IS NOT NULL").select("shard", "generation").exceptAll(
            self.live(spark).select("shard", "generation"))

    def _write(self, df: DataFrame, replaces: bool, source: str | None, batch: int | None) -> None:
        spark = df.sparkSession
        newest = self.commits(spark).agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]
        generation = newest + 1
        folder = f"{self.root}/data/generation={generation}"
        buckets = None if self.part_columns else self.bucket_count(spark)
        (df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], self._part(spark).alias("shard"))
         .hint("rebalance", F.col("shard"))
         .write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy("shard", *self.part_columns)
         .parquet(folder))
        wrote = spark.createDataFrame([(None,)], "shard STRING")
        try:
            found = spark.read.schema(T.StructType([T.StructField("shard", T.StringType())])).parquet(folder)
            wrote = wrote.unionByName(found.select("shard").distinct())
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        (wrote.select(F.lit(generation).cast("bigint").alias("generation"), "shard", F.lit(replaces).alias("replaces"),
                      F.lit(source).cast("string").alias("source"), F.lit(batch).cast("bigint").alias("batch"), F.lit(buckets).cast("int").alias("buckets"))
         .coalesce(1).write.mode("append").json(f"{self.root}/commits"))

    def replace(self, df: DataFrame) -> None:
        """Full refresh: the old rows stay readable until the new ones are committed."""
        self._write(df, True, None, None)

    def upsert(self, batch: DataFrame, update_cols: list[str], order: list[Column | str], source: str | None = None,
               batch_id: int | None = None, kept: bool = False) -> None:
        """Insert new keys, overwrite ``update_cols`` on a match; only parts the batch touches are rewritten.

        ``order`` says which of several batch rows with one key counts: the first. The batch is computed once, into the shared
        folder; one that is ``kept`` there already is not written again, and its rows move once, for the choice and the match.
        A batch already committed by the same source is skipped, so delivery may repeat; a source whose batch
        numbers start anew needs a new name.
        """
        spark = batch.sparkSession
        if source is not None and batch_id is not None:
            done = self.commits(spark).where((F.col("source") == source) & (F.col("batch") == batch_id))
            if not done.isEmpty():
                return
        names = [f.name for f in self.schema.fields]
        rows = keep_first(batch, list(self.keys), order).select(*[F.col(n).cast(self.schema[n].dataType) for n in names])
        every = batch.select(*[F.col(n).cast(self.schema[n].dataType) for n in {*self.keys, *self.part_columns}])
        if not kept:
            staged = scratch(spark, "batch")
            rows.write.parquet(staged)
            rows = every = spark.read.schema(self.schema).parquet(staged)
        missing = every.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys]))
        if not missing.isEmpty():
            raise KeyViolation(f"{self.root}: a row without its key ({', '.join(self.keys)})")
        target = self.read(spark, every.select(self._part(spark).alias("shard")).distinct())
        self._write(upsert_partial(target, rows, list(self.keys), update_cols), False, source, batch_id)


def replace_table(df: DataFrame, table: StoredTable) -> DataFrame:
    """Atomic full refresh; returns the table as now stored."""
    table.replace(df)
    return table.read(df.sparkSession)


def load_report(table: str, df: DataFrame, **counts: Column) -> DataFrame:
    """Row count and quality counts of a load, as one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()]).select(
        F.lit(table).alias("table"), "rows", *counts)


def register_views(tables, names: list[str] | None = None) -> None:
    """Make tables and the three derived views available to SQL under their names."""
    from skyspine.operators.airports import airport_capability
    from skyspine.operators.spine import charter_fleet
    from skyspine.operators.traffic import charter_routes

    derived = {"charter_fleet": charter_fleet, "airport_capability": airport_capability,
               "charter_routes": charter_routes}
    for name in names or [*tables.names(), *derived]:
        frame = derived[name](tables) if name in derived else tables[name]
        frame.createOrReplaceTempView(name)
