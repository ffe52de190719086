"""Exact top-k inner products as a Voronoi kNN join.

The largest inner products are the nearest neighbours after one more coordinate: with M the largest norm, data get
sqrt(M^2 - |s|^2), queries get 0, and |q - s|^2 = |q|^2 + M^2 - 2 q.s. Pivots cut that space into cells. Per cell of
queries a summary (least and largest distance to the pivot) and the k nearest data distances of every data cell give a
bound on the k-th neighbour of any of its queries; a data row goes to a group of cells only if the triangle inequality
lets it be nearer than that. Groups are solved locally, in blocks of data rows, and the blocks' best are merged.

Only the pivots and the cells' summaries (at most ``pivots`` * (k + 1) numbers) pass through the driver. A hot cell is
many blocks; a block never holds more than some ``BLOCK_ROWS`` data rows and ``GROUP_QUERIES`` queries on average.

Odd rows: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; vectors of
unequal length are padded with zeros; rows that carry the query's id are its own and no candidates; repeated rows are
candidates and queries of their own; with fewer candidates than k all are returned; scores beyond 64 bits are held at
the limits. Other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyspine.llm import common

BLOCK_ROWS = 16_384
GROUP_QUERIES = 512
#: Vectors of a numpy step.
STEP_ROWS = 2_048

FOUND = common.arrow_schema(row=pa.int64(), query_id=pa.int64(), vec_id=pa.int64(), score=pa.int64())


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): components as floor(scale * x); rows that take no part are left out."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & whole)
            .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _dot(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in doubles while sums stay below 2^53, else in 64 bits, else in big integers."""
    width = max(q.shape[1], s.shape[1])
    q, s = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, s))
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(s.astype(float)).max(initial=0)) * width
    if most < 2.0 ** 53:
        return (q.astype(float) @ s.T.astype(float)).astype(np.int64)
    if most < 2.0 ** 62:
        return q @ s.T
    big = q.astype(object) @ s.T.astype(object)
    return np.clip(big, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _distances(points: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points, with their further coordinate, to the pivots, whose last coordinate that is."""
    width = max(points.shape[1], pivots.shape[1] - 1)
    p = np.concatenate([np.pad(points.astype(float), ((0, 0), (0, width - points.shape[1]))), extra[:, None]], axis=1)
    c = np.concatenate([np.pad(pivots[:, :-1], ((0, 0), (0, width - pivots.shape[1] + 1))), pivots[:, -1:]], axis=1)
    d2 = (p * p).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (p @ c.T)
    return np.sqrt(np.maximum(d2, 0))


def _extra(points: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (points.astype(float) ** 2).sum(1), 0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 16) -> DataFrame:
    """(row, query_id, rank, vec_id, score): for each query the k candidates of largest inner product.

    ``vectors`` and ``queries`` are frames of (id, v) as ``scaled`` makes them; ``row`` numbers the query rows. Ties go
    to the smaller id.
    """
    spark = common.prepare(vectors.sparkSession)
    queries = common.stored(queries.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "knn-queries")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total = vectors.agg(F.max(squares).alias("m"), F.count("*").alias("n")).first()
    most, n_data = float(total["m"] or 0.0), total["n"]
    schema = "row long, query_id long, vec_id long, score long"
    empty = spark.createDataFrame([], "row long, query_id long, rank int, vec_id long, score long")
    chosen = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).collect()
    if not chosen:
        return empty
    width = max(len(r["v"]) for r in chosen)
    centres = np.zeros((len(chosen), width + 1))
    for i, r in enumerate(chosen):
        centres[i, :len(r["v"])] = r["v"]
    centres[:, -1] = _extra(centres[:, :-1], most)

    def nearest(extra):
        def run(it):
            for batch in it:
                m = _matrix(batch.column(1))
                d = _distances(m, extra(m), centres)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(d[np.arange(len(m)), cell])], ["x", "cell", "d"])
        return run

    rising = Window.partitionBy("cell").orderBy("d")
    summary = (vectors.select("id", "v").mapInArrow(nearest(lambda m: _extra(m, most)), "x long, cell long, d double")
               .groupBy("cell", "x").agg(F.min("d").alias("d"))
               .withColumn("r", F.row_number().over(rising)).where(F.col("r") <= k + 1).select("cell", "x", "d").collect())
    q_cells = common.stored(queries.select("row", "v").mapInArrow(nearest(lambda m: np.zeros(len(m))), "x long, cell long, d double")
                            .withColumnRenamed("x", "row"), "knn-cells")
    ring = {r["cell"]: (r["lo"], r["hi"], r["n"]) for r in
            q_cells.groupBy("cell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).collect()}
    if not ring:
        return empty
    between = _distances(centres[:, :-1], centres[:, -1], centres)
    cells = sorted(ring)
    slack = 1e-6 * (1.0 + float(between.max(initial=0)) + np.sqrt(most))
    bound = []
    for c in cells:
        reach: dict[int, float] = {}
        for far, x in sorted((ring[c][1] + between[c, s["cell"]] + s["d"], s["x"]) for s in summary):
            reach.setdefault(x, far)
        # one id more than k, as the query's own may be among them
        bound.append(list(reach.values())[k] + slack if len(reach) > k else np.inf)
    lo, hi = np.array([ring[c][0] for c in cells]), np.array([ring[c][1] for c in cells])
    bound = np.array(bound)

    # Neighbouring cells with few queries share a group; a group with many queries is several.
    group_of, parts, held = {}, [], 0
    for c in cells:
        if not parts or held >= GROUP_QUERIES:
            parts.append(0)
            held = 0
        group_of[c] = len(parts) - 1
        held += ring[c][2]
        parts[-1] = held
    parts = [max(1, -(-n // GROUP_QUERIES)) for n in parts]
    groups = np.array([group_of[c] for c in cells])
    blocks = max(1, -(-n_data // BLOCK_ROWS))

    def deal(it):
        for batch in it:
            m = _matrix(batch.column(1))
            d = _distances(m, _extra(m, most), centres)[:, cells]
            wanted = np.maximum(d - hi, lo - d) <= bound
            for g in range(len(parts)):
                rows = np.flatnonzero(wanted[:, groups == g].any(1))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g)), batch.column(0).take(pa.array(rows)),
                                                      batch.column(1).take(pa.array(rows))], ["g", "id", "v"])

    def numbered(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    part_count = F.element_at(F.array(*[F.lit(p) for p in parts]), (F.col("g") + 1).cast("int"))
    data = vectors.select("id", "v").mapInArrow(deal, "g long, id long, v array<long>")
    data = data.select("g", numbered(part_count).alias("part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    to_group = F.element_at(F.create_map(*[x for c in cells for x in (F.lit(c).cast("long"), F.lit(group_of[c]).cast("long"))]), F.col("cell"))
    asked = (queries.join(q_cells.select("row", to_group.alias("g")), "row")
             .select("g", F.pmod(F.xxhash64("row"), part_count).cast("int").alias("part"),
                     numbered(F.lit(blocks)).alias("block"), "row", "id", "v"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            q, rows, own = (_matrix(left["v"].combine_chunks()), left["row"].to_numpy(), left["id"].to_numpy())
            ids, s = right["id"].to_numpy(), _matrix(right["v"].combine_chunks())
            for at in range(0, len(q), 64):
                _best(q[at:at + 64], rows[at:at + 64], own[at:at + 64], s, ids, k, out)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int64)) for c in out], schema=FOUND)

    keys = ["g", "part", "block"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, schema)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")


def _best(q, rows, own, s, ids, k, out) -> None:
    """Appends the k best of the data rows, which stand by rising id, for some queries."""
    scores = np.concatenate([_dot(q, s[at:at + STEP_ROWS]) for at in range(0, len(s), STEP_ROWS)], axis=1)
    for i in range(len(q)):
        line, keep = scores[i], ids != own[i]
        line, names = line[keep], ids[keep]
        if len(line) > k:
            kth = np.partition(line, len(line) - k)[len(line) - k]
            near = np.flatnonzero(line >= kth)
            line, names = line[near], names[near]
        order = np.lexsort((names, ~line))[:k]
        out[0].append(np.full(len(order), rows[i]))
        out[1].append(np.full(len(order), own[i]))
        out[2].append(names[order])
        out[3].append(line[order])


def query(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    data = scaled(embeddings)
    return top_k(data, data.where(F.col("id") % every == 0), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id,
       CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, s.e) DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id, CAST(list_inner_product(q.e, s.e) AS BIGINT) AS score
FROM v q JOIN v s ON s.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
QUALIFY rank <= 5
"""
