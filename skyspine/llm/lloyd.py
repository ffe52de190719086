"""Vector code compression by member-resident Lloyd.

Vectors are cut into equal parts; each part position has a codebook. Every part of every vector is a member of one entry
of its position's codebook and lives in a stored table dealt by (position, entry, salt). A round has two steps: owners
add up the members they hold, which gives the new entries, and look for each member's nearest new entry. Members that
keep theirs are written back by the task that read them; only those that change it go through the next shuffle, to their
new owners. An entry with more than an owner's share of the members is dealt over several salts, so a vector that fills
a third of the table does not meet in one task.

Through the driver go the codebooks, ``parts * entries`` rows of one part each, whatever the number of vectors, and as
many counts. All arithmetic is on whole numbers; partial sums of tasks are added by a small aggregation.

Odd rows: vectors that are null, empty, or hold a null or a component that is not finite are left out. All others must
have one length, a multiple of the number of parts, and floors below 2 ** 28 in size, or the job ends with an error that
says so. Repeated rows count each; equal ids and null ids are rows like others (where the first codebook is taken from the
smallest ids, equal ids go by their vectors and null ids come last). Null labels are one label. Fewer vectors
than entries give a smaller codebook, an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyspine.llm import common

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Floors below this keep every distance of a part within a long.
MOST = 1 << 28


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector, row): the usable vectors in double precision, with a hash of the whole row."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                       F.col("embedding").cast("array<double>").alias("vector"))
    v = v.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    return v.withColumn("row", F.xxhash64("vec_id", "vector", "label"))


def floors(flat: np.ndarray, scale: int) -> np.ndarray:
    scaled = np.floor(flat * scale)
    if len(scaled) and np.abs(scaled).max() >= MOST:
        raise ValueError(f"a component's floor is {MOST} or more in size, so errors would not fit a long")
    return scaled.astype(np.int64)


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """[position, entry, component] of the smallest ids' vectors."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    if len({len(r[0]) for r in first}) > 1 or len(first[0][0]) % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    table = floors(np.array([r[0] for r in first]), scale)
    return np.ascontiguousarray(table.reshape(len(first), parts, -1).transpose(1, 0, 2))


def nearest(members: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each member, ties to the lower one, and its squared distance; exact."""
    entry, distance = np.empty(len(members), dtype=np.int64), np.empty(len(members), dtype=np.int64)
    size = max(1, int(max(np.abs(members).max(initial=0), np.abs(book).max(initial=0))))
    if 4 * size * size * members.shape[1] >= 1 << 63:
        raise ValueError("squared distances of parts this long do not fit a long")
    exact = np.float64 if 4 * size * size * members.shape[1] < 1 << 53 else np.int64  # sums of squares without rounding
    b = book.astype(exact)
    norms = (b * b).sum(axis=1)
    for at in range(0, len(members), 4096):
        m = members[at:at + 4096].astype(exact)
        d = norms - 2 * (m @ b.T)
        best = d.argmin(axis=1)
        entry[at:at + 4096] = best
        distance[at:at + 4096] = d[np.arange(len(m)), best] + (m * m).sum(axis=1)
    return entry, distance


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel().astype(np.int32)))


def _members(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def cut(rows: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """One row per vector and position, with the nearest entry of the first codebooks."""
    parts, _, width = books.shape
    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("entry", T.IntegerType()),
                           T.StructField("vec_id", T.LongType()), T.StructField("row", T.LongType()),
                           T.StructField("label", label), T.StructField("part", T.ArrayType(T.IntegerType()))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        vectors = batch.column(2)
        n = len(vectors)
        lengths = np.diff(np.asarray(vectors.offsets))
        if (lengths != parts * width).any():
            raise ValueError(f"vectors must have one length, a multiple of {parts}")
        table = floors(np.asarray(vectors.flatten(), dtype=np.float64), scale).reshape(n, parts, width)
        for p in range(parts):
            entry, _ = nearest(table[:, p], books[p])
            labels = batch.column(1) if p == 0 else pa.nulls(n, batch.column(1).type)  # with one part of each vector
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, p, dtype=np.int32)), pa.array(entry.astype(np.int32)), batch.column(0), batch.column(3), labels,
                 _lists(table[:, p])], names=schema.names)

    return rows.select("vec_id", "label", "vector", "row").mapInArrow(common.batches(run), schema)


def owner_salt(counts: dict[tuple[int, int], int], parts: int, entries: int, owners: int) -> Column:
    """The salt of a member: its entry's members over one owner's share, so that no owner holds more than that."""
    share = max(1, math.ceil(sum(counts.values()) / owners))
    salts = F.array(*(F.lit(max(1, math.ceil(counts.get((p, e), 0) / share))) for p in range(parts) for e in range(entries)))
    at = F.col("position") * entries + F.col("entry") + 1
    return F.pmod("row", F.element_at(salts, at)).cast("int")


def dealt(members: DataFrame, salt: Column, owners: int) -> DataFrame:
    return members.withColumn("salt", salt).repartition(owners, "position", "entry", "salt").drop("salt")


def census(members: DataFrame) -> dict[tuple[int, int], int]:
    """Members of each entry: at most as many rows as the codebooks have."""
    return {(r["position"], r["entry"]): r["n"] for r in members.groupBy("position", "entry").agg(F.count("*").alias("n")).collect()}


def updated(members: DataFrame, books: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """New codebooks, the floors of the members' means, with the number of members; an entry without members stays."""
    parts, entries, width = books.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in it:
            if not len(batch):
                continue
            group = np.asarray(batch.column(0), dtype=np.int64) * entries + np.asarray(batch.column(1))
            order = np.argsort(group, kind="stable")
            group, first = np.unique(group[order], return_index=True)
            total[group] += np.add.reduceat(_members(batch.column(2))[order], first, axis=0)
            number[group] += np.diff(np.append(first, len(order)))
        held = np.flatnonzero(number)
        if len(held):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * width), pa.array(total[held].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((held // entries).astype(np.int32)), pa.array((held % entries).astype(np.int32)),
                                              pa.array(number[held]), sums], names=["position", "entry", "n", "sums"])

    partial = members.select("position", "entry", "part").mapInArrow(run, "position int, entry int, n long, sums array<long>")
    rows = (partial.select("position", "entry", "n", F.posexplode("sums").alias("at", "total")).groupBy("position", "entry", "at")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    new, counts = books.copy(), {}
    for r in rows:
        new[r["position"], r["entry"], r["at"]] = r["total"] // r["n"]  # floors, below zero as well
        counts[r["position"], r["entry"]] = r["n"]
    return new, counts


def assigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """The members with their nearest entries, the squared distances, and whether the entry is another one."""
    schema = T.StructType([*members.schema.fields, T.StructField("distance", T.LongType()), T.StructField("moves", T.BooleanType())])
    names = members.columns

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not len(batch):
            return
        position, before = np.asarray(batch.column(names.index("position"))), np.asarray(batch.column(names.index("entry")))
        part = _members(batch.column(names.index("part")))
        entry, distance = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        for p in np.unique(position):
            at = position == p
            entry[at], distance[at] = nearest(part[at], books[p])
        columns = [pa.array(entry.astype(np.int32)) if n == "entry" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(distance), pa.array(entry != before)], names=schema.names)

    return members.mapInArrow(common.batches(run), schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             owners: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, entries, error) for each usable vector of (vec_id, embedding, label), and the final codebooks.

    ``entries`` is the array of entry numbers by position; ``owners`` defaults to the shuffle partitions.
    """
    spark = common.prepare(vectors.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS * 16))
    owners = owners or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(vectors)
    books = first_codebooks(rows, parts, entries, scale)
    entries = books.shape[1]
    if not entries:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("entries"), F.lit(0).cast("long").alias("error")), books
    start = common.stored(cut(rows, books, scale), "parts")
    members = common.stored(dealt(start, owner_salt(census(start), parts, entries, owners), owners), "members")
    common.forget(start)
    for k in range(rounds):
        books, counts = updated(members, books)
        if k + 1 == rounds:
            break
        before, round_ = members, common.stored(assigned(members, books), "round")
        salt = owner_salt(counts, parts, entries, owners)
        moved = common.stored(dealt(round_.where("moves").drop("moves", "distance"), salt, owners), "moved")
        stay = round_.where("NOT moves").drop("moves", "distance")
        common.forget(before)
        members = stay.unionAll(moved)
    last = assigned(members, books)
    at = [F.col("position") == p for p in range(parts)]
    out = last.groupBy("vec_id", "row").agg(
        F.any_value("label", True).alias("label"),
        F.array(*(F.max(F.when(c, F.col("entry"))) for c in at)).alias("entries"),
        sum((F.max(F.when(c, F.col("distance"))) for c in at), F.lit(0).cast("long")).alias("error"),
        F.sum(F.when(at[0], 1).otherwise(0)).cast("int").alias("_copies"))
    return out.select("vec_id", "label", "entries", "error", F.explode(F.sequence(F.lit(1), "_copies"))).drop("col"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(vectors: DataFrame) -> DataFrame:
    codes, books = compress(vectors)
    hexed = F.transform("entries", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0"))
    codes = common.stored(codes.select("vec_id", "label", F.array_join(hexed, "").alias("code"), "error"), "codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    def assign(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
    SELECT r, p, min(code) % 256 AS e, min(code) // 256 AS d
    FROM (SELECT c.r, c.p, sum((c.v - b.v) * (c.v - b.v))::BIGINT * 256 + b.e AS code
          FROM comp c JOIN b{k} b ON b.p = c.p AND b.j = c.j GROUP BY c.r, c.p, b.e)
    GROUP BY r, p),"""

    def update(k: int) -> str:
        return f"""
b{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, b.j, coalesce(m.v, b.v) AS v
    FROM b{k} b LEFT JOIN (SELECT c.p, a.e, c.j, floor(sum(c.v)::DOUBLE / count(*))::BIGINT AS v
                           FROM comp c JOIN a{k} a ON a.r = c.r AND a.p = c.p GROUP BY c.p, a.e, c.j) m
    ON m.p = b.p AND m.e = b.e AND m.j = b.j),"""

    steps = "".join(assign(k) + update(k) for k in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS width, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (
    SELECT r, i // width AS p, i % width AS j, floor({SCALE} * embedding[i + 1]::DOUBLE)::BIGINT AS v
    FROM (SELECT r, width, embedding, unnest(range(len(embedding))) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, j, v FROM comp WHERE r <= {ENTRIES}),{steps}{assign(ROUNDS)}
coded AS (
    SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""


SQL = _sql()
