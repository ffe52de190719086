"""Shared parts: settings, Arrow text slices, word hashes, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspine.session import configure, scratch, shared_dir

#: Rows of an Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 256
#: Bytes of text that one numpy step works on; a longer text is a step of its own.
SLICE_BYTES = 1_500_000


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: a cut of the lineage that survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more; frames over other files stay as they are."""
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/skyspine/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if own.split(":", 1)[-1].lstrip("/") in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids that ``without`` broadcasts.
BROADCAST_IDS = 200_000


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows of some ids, given by a frame of one column; rows without an id stay."""
    ids = stored(ids.select(F.col(ids.columns[0]).cast("long").alias("_gone")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col].cast("long") == ids["_gone"], "left_anti")


def id_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def arrow_schema(**fields: pa.DataType) -> pa.Schema:
    return pa.schema(list(fields.items()))


# --- words -------------------------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


class Texts:
    """Some texts as one byte array: text i is ``data[starts[i]:starts[i + 1]]``; a null text is empty."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def folded(self) -> Texts:
        """With A-Z in lower case."""
        return Texts(_FOLD[self.data], self.starts)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of True within single texts: their starts and ends in ``data``, and the first run of each text."""
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[self.starts] = True
        cuts = np.flatnonzero(edge)
        begins = cuts[:-1][inside[cuts[:-1]]] if len(inside) else cuts[:0]
        ends = cuts[1:][inside[cuts[:-1]]] if len(inside) else cuts[:0]
        return begins, ends, np.searchsorted(begins, self.starts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than space and tab to carriage return."""
        return self.runs(~SPACE[self.data])

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans, from one running polynomial sum."""
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * _power_table(_BASE, len(self.data)), out=total[1:])
        raw = (total[ends] - total[begins]) * _power_table(_INVERSE, len(self.data) + 1)[begins]
        return mix(raw + (ends - begins).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """Consecutive texts of a column of at most ``most`` bytes together (or one text), with the first one's position."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    if column.null_count:  # a null slot may hold bytes
        size = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if (size != np.diff(offsets)).any():
            keep = np.repeat(np.asarray(column.is_valid()), np.diff(offsets))
            data = data[offsets[0]:offsets[-1]][keep]
            offsets = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, Texts(data[offsets[at]:offsets[to]], (offsets[at:to + 1] - offsets[at]).astype(np.int64))
        at = to


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` consecutive words; the order of the words counts."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total = (total + words[k:n + k]) * np.uint64(_BASE)
        total ^= total >> np.uint64(29)
    return mix(total)


def batches(run: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]):
    """A function for mapInArrow out of one that works on a batch."""
    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from run(batch)
    return over


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type, from_pandas=False) if not isinstance(c, pa.Array) else c
                                       for c, f in zip(columns, schema)], schema=schema)


# --- vocabularies --------------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, other bytes as 256 and on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(rest)}


# --- connected components ------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Alternates two local steps: each node's larger neighbours are linked to its smallest neighbour, then its smaller
    neighbours and itself. The edges become stars of the roots. Both are aggregations and equi-joins on the node; a
    hot node is one side's single row. Every round is stored in the shared folder. Null ends drop out.
    """
    e = (edges.where("a IS NOT NULL AND b IS NOT NULL")
         .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    e = stored(e, "links")
    loops = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    e = e.where("a <> b")
    before = None
    for _ in range(rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        e = stored(large, "large-star")
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .unionAll(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
                 .where("a <> b").distinct())
        e = stored(small, "small-star")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionAll(e.select(F.col("a").alias("node"), F.col("a").alias("root"))).unionAll(loops).groupBy("node").agg(F.min("root").alias("root"))
