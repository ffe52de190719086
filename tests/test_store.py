"""Stored tables: atomic, idempotent, and the stream equals the batch."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyspine.operators import upsert as U
from skyspine.operators.keys import KeyViolation
from skyspine.session import shared_dir
from skyspine.sources.store import StoredTable
from skyspine.streaming.upsert_stream import stream_upsert

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()),
                       T.StructField("measure", T.LongType())])
BASE = [(i, f"old{i}", i) for i in range(40)]
DELTA = [(i, f"new{i}", i * 10) for i in range(30, 60)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def expected():
    merged = {i: (label, m) for i, label, m in BASE}
    for i, label, m in DELTA:
        merged[i] = (merged[i][0] if i in merged else label, m)
    return sorted((i, *v) for i, v in merged.items())


def table(folder, **kw):
    return StoredTable(folder + "/t", SCHEMA, ("id",), **kw)


def test_upsert_partial_keeps_what_is_not_listed(spark):
    merged = U.upsert_partial(frame(spark, BASE), frame(spark, DELTA), ["id"], ["measure"])
    assert rows(merged) == expected()
    twice = U.upsert_partial(merged, frame(spark, DELTA), ["id"], ["measure"])
    assert rows(twice) == expected()


def test_upsert_overwrites_with_null(spark):
    merged = U.upsert_partial(frame(spark, [(1, "a", 5)]), frame(spark, [(1, None, None)]), ["id"], ["measure"])
    assert rows(merged) == [(1, "a", None)]


def test_empty_table_then_upserts(spark, folder):
    t = table(folder, buckets=4)
    assert rows(t.read(spark)) == []
    t.upsert(frame(spark, BASE), ["measure"], ["id"])
    t.upsert(frame(spark, DELTA), ["measure"], ["id"])
    t.upsert(frame(spark, DELTA), ["measure"], ["id"])
    assert rows(t.read(spark)) == expected()


def test_upsert_rewrites_only_touched_parts(spark, folder):
    t = StoredTable(folder + "/t", SCHEMA, ("id",), part_columns=("label",))
    t.replace(frame(spark, [(1, "x", 1), (2, "y", 2)]))
    t.upsert(frame(spark, [(3, "y", 3)]), ["measure"], ["id"])
    live = {r.shard: r.generation for r in t.live(spark).collect()}
    assert live == {"x": 1, "y": 2}
    assert rows(t.read(spark)) == [(1, "x", 1), (2, "y", 2), (3, "y", 3)]


def test_replace_drops_old_parts_and_may_read_itself(spark, folder):
    t = StoredTable(folder + "/t", SCHEMA, ("id",), part_columns=("label",))
    t.replace(frame(spark, [(1, "x", 1), (2, "y", 2)]))
    t.replace(t.read(spark).where("label = 'y'"))
    assert rows(t.read(spark)) == [(2, "y", 2)]
    t.replace(frame(spark, []))
    assert rows(t.read(spark)) == []


def test_failed_load_leaves_the_old_rows(spark, folder):
    t = table(folder, buckets=2)
    t.replace(frame(spark, BASE))
    bad = frame(spark, DELTA).withColumn("measure", F.when(F.col("id") == 45, F.raise_error(F.lit("boom"))).otherwise(
        F.col("measure")).cast("bigint"))
    with pytest.raises(Exception):
        t.replace(bad)
    assert rows(t.read(spark)) == sorted(BASE)
    # Data written without its commit is invisible, and the next load takes the same generation over.
    frame(spark, DELTA).withColumn("shard", F.lit("b0")).write.partitionBy("shard").mode("overwrite").parquet(
        folder + "/t/data/generation=2")
    assert rows(t.read(spark)) == sorted(BASE)
    t.upsert(frame(spark, DELTA), ["measure"], ["id"])
    assert rows(t.read(spark)) == expected()


def test_repeated_batch_is_skipped(spark, folder):
    t = table(folder, buckets=2)
    t.upsert(frame(spark, BASE), ["measure"], ["id"], source="s", batch_id=0)
    t.upsert(frame(spark, [(1, "other", 99)]), ["measure"], ["id"], source="s", batch_id=0)
    assert rows(t.read(spark)) == sorted(BASE)
    t.upsert(frame(spark, [(1, "other", 99)]), ["measure"], ["id"], source="s", batch_id=1)
    assert (1, "old1", 99) in rows(t.read(spark))


def test_stream_equals_batch(spark, folder):
    t = table(folder, buckets=2)
    t.replace(frame(spark, BASE))
    for i in range(0, 30, 10):
        frame(spark, DELTA[i:i + 10]).coalesce(1).write.mode("append").json(folder + "/in")
    def run():
        stream_upsert(spark, folder + "/in", SCHEMA, t, ["measure"], folder + "/check", "feed", files_per_batch=1).awaitTermination()
    run()
    assert rows(t.read(spark)) == expected()
    assert t.commits(spark).where("source LIKE 'feed@%'").select("batch").distinct().count() == 3
    run()
    assert t.commits(spark).where("source LIKE 'feed@%'").select("batch").distinct().count() == 3
    frame(spark, [(5, "late", 500), (30, "late", 301)]).coalesce(1).write.mode("append").json(folder + "/in")
    run()
    got = dict((r[0], r[1:]) for r in rows(t.read(spark)))
    assert got[5] == ("old5", 500) and got[30] == ("old30", 301) and len(got) == 60


def test_stream_survives_a_crash_after_its_commit(spark, folder):
    """The table commit happened but the stream did not note it: the same batch comes again and changes nothing."""
    t = table(folder, buckets=2)
    frame(spark, BASE).coalesce(1).write.json(folder + "/in")
    os.mkdir(folder + "/check")
    with open(folder + "/check/metadata", "w") as f:
        f.write('{"id":"11111111-2222-3333-4444-555555555555"}')
    t.upsert(frame(spark, BASE), ["measure"], ["id"], source="feed@11111111-2222-3333-4444-555555555555", batch_id=0)
    stream_upsert(spark, folder + "/in", SCHEMA, t, ["measure"], folder + "/check", "feed").awaitTermination()
    assert rows(t.read(spark)) == sorted(BASE)
    assert t.commits(spark).agg(F.max("generation")).first()[0] == 1


def test_a_renewed_checkpoint_brings_new_data(spark, folder):
    t = table(folder, buckets=2)
    for k in (1, 2):
        frame(spark, [(k, f"n{k}", k)]).coalesce(1).write.json(f"{folder}/in{k}")
        stream_upsert(spark, f"{folder}/in{k}", SCHEMA, t, ["measure"], f"{folder}/check{k}", "feed").awaitTermination()
    assert rows(t.read(spark)) == [(1, "n1", 1), (2, "n2", 2)]


def test_of_repeated_keys_one_counts(spark, folder):
    t = table(folder, buckets=2)
    t.upsert(frame(spark, [(1, "a", 1), (1, "b", 3), (1, "c", 2)]), ["measure"], [F.col("measure").desc()])
    assert rows(t.read(spark)) == [(1, "b", 3)]
    frame(spark, [(1, "d", 7), (1, "e", 8), (2, "f", 9)]).coalesce(1).write.json(folder + "/in")
    stream_upsert(spark, folder + "/in", SCHEMA, t, ["measure"], folder + "/check", "feed").awaitTermination()
    assert rows(t.read(spark)) == [(1, "b", 8), (2, "f", 9)]  # the last of the file
    with pytest.raises(ValueError):
        stream_upsert(spark, folder + "/in", SCHEMA, t, ["measure"], folder + "/other", "feed", prepare=lambda d: d)


def test_the_number_of_buckets_stays(spark, folder):
    table(folder, buckets=4).replace(frame(spark, BASE))
    for wrong in (7, 1):
        with pytest.raises(ValueError):
            table(folder, buckets=wrong).upsert(frame(spark, DELTA), ["measure"], ["id"])
    table(folder).upsert(frame(spark, DELTA), ["measure"], ["id"])
    assert rows(table(folder, buckets=4).read(spark)) == expected()


def test_partition_filters_choose_the_files(spark, folder):
    t = StoredTable(folder + "/t", SCHEMA, ("id",), part_columns=("measure",))
    t.replace(frame(spark, [(i, "x", i % 10) for i in range(100)]))
    t.upsert(frame(spark, [(3, "y", 3), (200, "z", None)]), ["label"], ["id"])
    some = t.read(spark).where("measure = 3")
    assert rows(some) == [(3, "y", 3), *[(i, "x", 3) for i in range(13, 100, 10)]]
    assert len({os.path.dirname(f) for f in t.read(spark).inputFiles()}) == 11
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(measure" in plan
    assert t.read(spark).where("measure IS NULL").count() == 1
    assert [tuple(r) for r in t.dead(spark).collect()] == [("3", 1)]


def test_mark_read(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, None)], "id INT, read BOOLEAN")
    assert rows(U.mark_read(df)) == [(1, True), (2, True), (3, None)]


def test_photo_failures_are_not_stored(spark):
    df = spark.createDataFrame([("N1", True, True), ("N2", False, True), ("N3", None, False)],
                               "n_number STRING, has_photo BOOLEAN, fetched_ok BOOLEAN")
    kept = U.photo_results(df, F.lit("2024-01-01").cast("timestamp"))
    assert sorted(r.n_number for r in kept.collect()) == ["N1", "N2"] and "fetched_ok" not in kept.columns


def test_a_kept_batch_moves_once(spark, folder):
    """A batch that stands in the shared folder is not staged again; its rows meet the table where the first of each key was chosen."""
    t = table(folder, buckets=4)
    t.upsert(frame(spark, BASE), ["measure"], ["id"])
    path = folder + "/kept"
    spark.createDataFrame([*DELTA, (30, "late", -1)], SCHEMA).write.parquet(path)
    before = set(os.listdir(shared_dir(spark) + "/skyspine"))
    t.upsert(spark.read.schema(SCHEMA).parquet(path), ["measure"], [F.col("measure").desc()], kept=True)
    assert rows(t.read(spark)) == expected() and set(os.listdir(shared_dir(spark) + "/skyspine")) == before
    frame(spark, [(None, "x", 1)]).write.parquet(path + "2")
    with pytest.raises(KeyViolation):
        t.upsert(spark.read.schema(SCHEMA).parquet(path + "2"), ["measure"], ["id"], kept=True)
    assert rows(t.read(spark)) == expected()


def test_nothing_is_joined_with_an_empty_table(spark, folder):
    merged = U.upsert_partial(table(folder).read(spark), frame(spark, BASE), ["id"], ["measure"])
    assert rows(merged) == BASE and "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()
