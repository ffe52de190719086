"""Mixing sources to target weights: every document floor(rate) times, and once more by a hash-seeded coin.

Main path: column expressions, two aggregations (size per source; sums per source and seed) and joins with the table
of sources. Rules for odd rows:

- a null, empty or blank text has size 0: it is copied like any other of its source, and adds no words; a source of size 0
  has target 0 and rate 1, so its documents pass once;
- a null source is a source of its own, last in the order of sources;
- repeated rows are documents of their own that share the coin of their id; a null id has the coin of the empty text;
- an empty table gives an empty result; ``mix`` replaces input columns with the names of its results and keeps all others,
  ``mixed_rows`` keeps all columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyspine.llm.common import stored

#: The table of sources is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 20_000
#: Coins tried per source: the seed whose sum comes nearest the target is used. A multiple of four.
SEEDS = 16
#: What one word is.
WORD = r"[^ \t-\r]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def water_targets(sources: DataFrame, cycle=(1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, none above ``cap`` times its size.

    Weights repeat ``cycle`` over the sources by code point, null last. Dealing the excess again and again ends at one
    level per unit of weight: with sources by rising capacity per weight, the first that is not full sets it. The
    windows run over the table of sources, one row each.
    """
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rising = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (sources.withColumn("w", F.element_at(weights, ((F.row_number().over(order) - 1) % len(cycle) + 1).cast("int")))
         .withColumn("most", F.col("source_size") * F.lit(cap))
         .withColumn("dealt", F.sum("source_size").over(every) * F.lit(share))
         .withColumn("level", (F.col("dealt") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                     / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
         .withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
         .withColumn("open_level", F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("w"), "source", "level"))).over(every)["level"]))
    target = F.when(F.col("open_level").isNull() | (F.col("most") <= F.col("open_level") * F.col("w")), F.col("most"))
    return s.select("source", "source_size", target.otherwise(F.col("open_level") * F.col("w")).alias("target"))


def coins(doc_id: Column, seeds: int) -> list[Column]:
    """``seeds`` numbers in [0, 1) from the id: four from each MD5 of "id:number"."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    out = []
    for k in range(seeds // 4):
        digest = F.md5(F.concat(name, F.lit(f":{k}")))
        out += [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) for i in range(4)]
    return out


def by_source(rows: DataFrame, sources: DataFrame, broadcast: bool, name: str) -> DataFrame:
    """Rows with the table row of their source as the struct ``name``; a null source meets the null source."""
    side = sources.select(F.struct(*sources.columns).alias(name))
    return rows.join(F.broadcast(side) if broadcast else side, rows["source"].eqNullSafe(F.col(name)["source"]))


def mix(docs: DataFrame, cycle=(1, 2, 3), share: float = 1.0, cap: float = 3.0, seeds: int = SEEDS) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, rate, copies and taken.

    rate = target / source_size; copies = floor(rate), and one more if the coin is below the rest. For any one seed
    that probability is the rest; among ``seeds`` coins each source uses the one whose words come nearest its target.
    """
    own = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = docs.drop(*own)
    of = max(docs.columns, key=len) + "_of_source"  # no column of the documents
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = stored(sized, "mix-sizes")
    sources = stored(water_targets(source_sizes(sized), cycle, share, cap), "mix-sources")
    broadcast = sources.count() <= BROADCAST_SOURCES
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    sources = sources.withColumn("rate", rate).withColumn("rest", F.col("rate") - F.floor("rate"))
    tried = by_source(sized, sources.select("source", "rest"), broadcast, of)
    sums = [F.sum(F.when(c < F.col(of)["rest"], F.col("size")).otherwise(0)).alias(f"s{j}")
            for j, c in enumerate(coins(F.col("doc_id"), seeds))]
    sums = tried.groupBy("source").agg(*sums).withColumnRenamed("source", "_s")
    errors = F.array(*[F.struct(F.abs(F.col(f"s{j}") - F.col("rest") * F.col("source_size")).alias("e"), F.lit(j).alias("seed"))
                       for j in range(seeds)])
    chosen = (sources.join(sums, F.col("source").eqNullSafe(F.col("_s")))
              .select("source", "source_size", "target", "rate", "rest", F.array_min(errors)["seed"].alias("seed")))
    chosen = stored(chosen, "mix-seeds")
    out, source = by_source(docs, chosen, broadcast, of), F.col(of)
    coin = F.element_at(F.array(*coins(F.col("doc_id"), seeds)), source["seed"] + 1)
    out = out.withColumn("size", word_count(F.col("text")))
    for name in ("source_size", "target", "rate"):
        out = out.withColumn(name, source[name])
    out = out.withColumn("copies", F.floor(source["rate"]) + (coin < source["rest"]).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(of)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, in its own columns."""
    whole = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    out = mix(whole, **options).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


#: The same rules over the tables for DuckDB.
SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
weighed AS (
  SELECT source, size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM (SELECT source, CAST(sum(size) AS DOUBLE) AS size FROM sized GROUP BY source)),
dealing AS (  -- deal, stop those above three times their size, deal the excess again
  SELECT 0 AS step, source, size, w, w * sum(size) OVER () / sum(w) OVER () AS target FROM weighed
  UNION ALL
  SELECT step + 1, source, size, w,
         CASE WHEN target >= 3 * size THEN 3 * size
              ELSE target + w * sum(greatest(target - 3 * size, 0)) OVER () / sum(CASE WHEN target < 3 * size THEN w ELSE 0 END) OVER () END
  FROM (SELECT *, max(target - 3 * size) OVER () AS above FROM dealing) WHERE above > 0),
targets AS (SELECT source, size AS source_size, target, CASE WHEN size > 0 THEN target / size ELSE 0 END AS rate
            FROM dealing QUALIFY step = max(step) OVER ()),
coins AS (
  SELECT s.*, t.target, t.source_size, t.rate, floor(t.rate) AS whole, t.rate - floor(t.rate) AS rest, k.seed,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(seed // 4 AS VARCHAR)), CAST(1 + 8 * (seed % 4) AS BIGINT), 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, range({SEEDS}) k(seed)),
sums AS (SELECT source, seed, abs(sum(CASE WHEN coin < rest THEN size ELSE 0 END) - any_value(rest) * any_value(source_size)) AS err
         FROM coins GROUP BY source, seed),
best AS (SELECT source, arg_min(seed, (err, seed)) AS seed FROM sums GROUP BY source)
SELECT c.doc_id, c.size, CAST(c.source_size AS BIGINT) AS source_size, c.target,
       CASE WHEN c.size > 0 THEN CAST(c.whole + CAST(c.coin < c.rest AS BIGINT) AS BIGINT) * c.size ELSE 0 END AS taken
FROM coins c JOIN best b ON c.seed = b.seed AND c.source IS NOT DISTINCT FROM b.source
"""


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
