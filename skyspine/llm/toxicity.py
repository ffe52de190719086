"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

1. A bounded sample of labelled rows gives the examples. Their words whose share of toxic examples is surely large (Wilson
   bound) are the vocabulary; document frequencies are then counted over all documents. All other words together are one more term, in texts that hold a term of the vocabulary.
2. The examples stand in blocks. The index keeps, per term and block, the largest weight; with a text's weights that bounds
   every cosine in the block. Blocks are scored from the highest bound down until no bound can reach the k-th best, so the
   neighbours are exact.
3. Neighbours vote by the square of their cosine, against a prior vote; the vote is put on a probability scale by a logistic fit on
   the examples themselves, each judged without itself.

Texts are read twice, once for the sample and once for all term counts; scoring works on the stored counts. The sample, the
vocabulary and the index are bounded by ``EXAMPLES`` and ``TERMS`` and go to every task.

Odd rows: a null text, an empty one, or one without a vocabulary word gets the smoothed share of toxic examples among such examples;
labels other than 0 and 1 and labels without a text teach nothing; repeated labels of an id count as toxic if one does; equal texts
and near copies are one example; repeated rows get equal scores; ties among neighbours go to the smaller id; without any example every score is 0;
an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.llm import common

#: Labelled rows in the sample: those of smallest id hash.
EXAMPLES = 12_000
#: Vocabulary at most: the terms most surely toxic.
TERMS = 4_096
#: Standard errors of the bound, and the least share of toxic examples, that make a word a term.
SURE, LEAST_SHARE = 3.0, 0.3
NEIGHBOURS = 15
BLOCK = 64
#: Weight of the prior vote, in neighbours of cosine 1.
PRIOR_VOTES = 0.5
THRESHOLD = 0.3

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: common.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters, digits and non-ASCII signs, A-Z in lower case; the first word of each text."""
    texts = texts.folded()
    begins, ends, first = texts.runs(_WORD[texts.data])
    return texts.hashes(begins, ends).view(np.int64), first


class Index(NamedTuple):
    idf: np.ndarray
    ids: np.ndarray  # of the examples, in index order
    toxic: np.ndarray
    bounds: np.ndarray  # (terms, blocks): largest weight
    block_terms: list[np.ndarray]
    block_weights: list[np.ndarray]  # (block's terms, its examples)
    blank: float  # score of a text without terms
    fit: tuple[float, float]


def weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1.0 + np.log(tf)) * idf
    return w / np.sqrt((w * w).sum())


def nearest(index: Index, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k nearest examples, by falling cosine, then by id."""
    bound = w @ index.bounds[terms]
    order = np.argsort(-bound, kind="stable")
    place, cosine = np.zeros(0, dtype=np.int64), np.zeros(0)
    for b in order:
        if bound[b] <= 0 or (len(place) >= k and bound[b] < cosine[k - 1] - 1e-12):
            break
        at = np.searchsorted(index.block_terms[b], terms)
        at[at == len(index.block_terms[b])] = 0
        hit = index.block_terms[b][at] == terms
        score = np.round(w[hit] @ index.block_weights[b][at[hit]], 12)
        near = np.flatnonzero(score > 0)
        place, cosine = np.concatenate([place, b * BLOCK + near]), np.concatenate([cosine, score[near]])
        best = np.lexsort((index.ids[place], -cosine))[:k]
        place, cosine = place[best], cosine[best]
    return place, cosine


def vote(index: Index, place: np.ndarray, cosine: np.ndarray) -> float:
    w = cosine * cosine
    prior = index.toxic.mean() if len(index.toxic) else 0.0
    return float((w @ index.toxic[place] + PRIOR_VOTES * prior) / (w.sum() + PRIOR_VOTES))


def judged(index: Index, own: int | None, place: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours without the row itself."""
    keep = index.ids[place] != own if own is not None else np.ones(len(place), dtype=bool)
    return place[keep][:NEIGHBOURS], cosine[keep][:NEIGHBOURS]


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def score_of(index: Index, place: np.ndarray, cosine: np.ndarray) -> float:
    if not len(place):
        return index.blank
    return float(1 / (1 + np.exp(-(index.fit[0] + index.fit[1] * _logit(vote(index, place, cosine))))))


def build(idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int]]]) -> Index:
    """The index of examples (id, toxic, term numbers, term counts)."""
    blank_rows = [e for e in examples if not e[2]]
    blank = (sum(e[1] for e in blank_rows) + 0.5) / (len(blank_rows) + 1) if blank_rows else 0.0
    vectors = []
    for doc, toxic, terms, tf in examples:
        if terms:
            t = np.array(terms)
            vectors.append((doc, toxic, t, weights(np.array(tf, dtype=float), idf[t])))
    # alike examples share a block: by heaviest term, then by the others
    vectors.sort(key=lambda v: (int(v[2][v[3].argmax()]), v[2].tolist(), v[0]))
    blocks = [vectors[i:i + BLOCK] for i in range(0, len(vectors), BLOCK)]
    bounds = np.zeros((len(idf), len(blocks)))
    block_terms, block_weights = [], []
    for b, rows in enumerate(blocks):
        own = np.unique(np.concatenate([t for _, _, t, _ in rows]))
        m = np.zeros((len(own), len(rows)))
        for j, (_, _, t, w) in enumerate(rows):
            m[np.searchsorted(own, t), j] = w
        bounds[own, b] = m.max(axis=1)
        block_terms.append(own)
        block_weights.append(m)
    index = Index(idf, np.array([v[0] for v in vectors], dtype=np.int64), np.array([v[1] for v in vectors], dtype=float),
                  bounds, block_terms, block_weights, blank, (0.0, 1.0))
    votes, gold = [], []
    for doc, toxic, t, w in vectors:
        near = judged(index, doc, *nearest(index, t, w, NEIGHBOURS + 1))
        if len(near[0]):
            votes.append(vote(index, *near))
            gold.append(toxic)
    return index._replace(fit=logistic(_logit(np.array(votes)), np.array(gold, dtype=float)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, float]:
    """Intercept and slope, the slope drawn towards 1."""
    a, b = 0.0, 1.0
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-(a + b * x)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(p - y).sum() + 0.01 * a, ((p - y) * x).sum() + penalty * (b - 1)])
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + penalty]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return a, b


STATS = common.arrow_schema(term=pa.int64(), n=pa.int64(), n_toxic=pa.int64())
COUNTS = common.arrow_schema(doc_id=pa.int64(), terms=pa.list_(pa.int32()), tf=pa.list_(pa.int32()))
SCORES = common.arrow_schema(doc_id=pa.int64(), score=pa.float64(), neighbours=pa.list_(pa.int64()), cosines=pa.list_(pa.float64()))


def _term_stats(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word the examples (toxic, text) that hold it, pre-counted per slice."""
    for batch in it:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, texts in common.text_slices(batch.column(1), 16_000_000):
            words, first = words_of(texts)
            own = [np.unique(words[first[i]:first[i + 1]]) for i in range(len(texts))]
            every, where = np.unique(np.concatenate(own), return_inverse=True)
            hits = np.repeat(toxic[at:at + len(texts)], [len(o) for o in own])
            yield common.record(STATS, every, np.bincount(where, minlength=len(every)), np.bincount(where, hits, len(every)).astype(np.int64))


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, terms, tf) of every row: the vocabulary's words in the text, by number, and how often.

    If there are any, all other words count together as one more term, so that one hit in a long text is far from many in a
    short one.
    """
    width = len(vocabulary) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, texts in common.text_slices(batch.column(1)):
                words, first = words_of(texts)
                place = np.searchsorted(vocabulary, words)
                place[place == len(vocabulary)] = 0
                hit = np.flatnonzero(vocabulary[place] == words) if len(vocabulary) else np.zeros(0, dtype=np.int64)
                owner = np.searchsorted(first, hit, side="right") - 1
                pair, tf = np.unique(owner * width + place[hit], return_counts=True)
                own, hits = np.unique(owner, return_counts=True)
                pair = np.concatenate([pair, own * width + width - 1])
                tf = np.concatenate([tf, np.maximum(1, np.diff(first)[own] - hits)])
                order = np.argsort(pair)
                pair, tf = pair[order], tf[order]
                cut = np.searchsorted(pair // width, np.arange(len(texts) + 1)).astype(np.int32)
                yield common.record(COUNTS, batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(cut, pa.array((pair % width).astype(np.int32))),
                                    pa.ListArray.from_arrays(cut, pa.array(tf.astype(np.int32))))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, terms array<int>, tf array<int>")


def sample(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic, text): at most ``examples`` labelled rows outside the held-out fold, equal texts once."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (common.id_bucket(F.col("doc_id"), folds) != held))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    known = common.stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "toxic-labels")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
            .join(F.broadcast(known), "doc_id"))  # at most ``examples`` rows of two numbers
    rows = rows.groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(
        F.min_by(F.struct("doc_id", "text"), F.col("doc_id")).alias("r"), F.max("toxic").alias("toxic"))
    return apart(common.stored(rows.select("r.doc_id", "toxic", "r.text"), "toxic-sample"))


#: Near copies in the sample share one of so many bands of so many least hashes of three-word windows.
BANDS, BAND_SIZE = 10, 3
KEYS = common.arrow_schema(doc_id=pa.int64(), keys=pa.list_(pa.int64()))


def _band_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = common.mix(np.arange(1, BANDS * BAND_SIZE + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in it:
        for at, texts in common.text_slices(batch.column(1)):
            words, first = words_of(texts)
            keys = []
            for i in range(len(texts)):
                w = words[first[i]:first[i + 1]].view(np.uint64)
                shingles = common.window_hashes(w, 3) if len(w) >= 3 else w
                least = np.array([(shingles * f).min() for f in factors]) if len(shingles) else np.zeros(len(factors), dtype=np.uint64)
                band = common.window_hashes(least, BAND_SIZE)[::BAND_SIZE] if len(shingles) else least[:0]
                keys.append(((band << np.uint64(4)) | np.arange(len(band), dtype=np.uint64)).view(np.int64).tolist())
            yield common.record(KEYS, batch.column(0).slice(at, len(texts)), keys)


def apart(examples: DataFrame) -> DataFrame:
    """The sample with one example of each cluster of near copies, so that a copied text does not make its words terms.

    The keys of the bounded sample are joined on the driver.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holder: dict[int, int] = {}
    rows = examples.select("doc_id", "text").mapInArrow(_band_keys, "doc_id long, keys array<long>").collect()
    for r in sorted(rows):
        parent.setdefault(r["doc_id"], r["doc_id"])
        for key in r["keys"]:
            a, b = root(holder.setdefault(key, r["doc_id"])), root(r["doc_id"])
            parent[max(a, b)] = min(a, b)
    kept = [(x,) for x in parent if parent[x] == x]
    kept = examples.sparkSession.createDataFrame(kept, "doc_id long")
    return common.stored(examples.join(F.broadcast(kept), "doc_id"), "toxic-examples")


def vocabulary_of(examples: DataFrame) -> np.ndarray:
    """Sorted hashes of the words whose toxic share is surely at least ``LEAST_SHARE``, the surest ``TERMS``."""
    stats = (examples.select("toxic", "text").mapInArrow(_term_stats, "term long, n long, n_toxic long")
             .groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t")))
    share, z2 = F.col("t") / F.col("n"), SURE * SURE
    lower = ((share + z2 / (2 * F.col("n")) - SURE * F.sqrt(share * (1 - share) / F.col("n") + z2 / (4 * F.col("n") * F.col("n"))))
             / (1 + z2 / F.col("n")))
    rows = stats.withColumn("lower", lower).where(F.col("lower") >= LEAST_SHARE).orderBy(F.col("lower").desc(), "term").limit(TERMS).collect()
    return np.sort(np.array([r["term"] for r in rows], dtype=np.int64))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score, neighbours, cosines) of every row of ``docs``: neighbours are the ids that voted."""
    spark = common.prepare(docs.sparkSession)
    examples = sample(docs, labels, **options)
    vocabulary = vocabulary_of(examples)
    counts = common.stored(term_counts(docs, vocabulary), "toxic-counts")
    n = counts.count()
    df = np.full(len(vocabulary) + 1, n, dtype=float)  # the last term is in every text
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per term at most
        if r["t"] < len(vocabulary):
            df[r["t"]] = r["count"]
    idf = np.log((n + 1) / (df + 1)) + 1.0
    # the sample's own counts: one row per example, bounded like the sample
    own = term_counts(examples, vocabulary).join(F.broadcast(examples.select("doc_id", "toxic")), "doc_id").collect()
    index = build(idf, sorted((r["doc_id"], r["toxic"], r["terms"], r["tf"]) for r in own))
    shared = spark.sparkContext.broadcast(index)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = shared.value, {}
        for batch in it:
            out = []
            for doc, terms, tf in zip(*(c.to_pylist() for c in batch.columns)):
                if not terms or not len(index.ids):
                    out.append((index.blank, [], []))
                    continue
                key = (tuple(terms), tuple(tf))
                if key not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    t = np.array(terms)
                    seen[key] = nearest(index, t, weights(np.array(tf, dtype=float), index.idf[t]), NEIGHBOURS + 1)
                place, cosine = judged(index, doc, *seen[key])
                out.append((score_of(index, place, cosine), index.ids[place].tolist(), cosine.tolist()))
            yield common.record(SCORES, batch.column(0), *zip(*out))

    return counts.mapInArrow(run, "doc_id long, score double, neighbours array<long>, cosines array<double>")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).select("doc_id", (common.id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours", "cosines")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold.

    The verdict belongs to an id: if several rows share one, all go if one of their texts is toxic. Rows without an id stay.
    """
    return common.without(docs, score(docs, labels).where(F.col("score") >= THRESHOLD).select("doc_id"), "doc_id")
