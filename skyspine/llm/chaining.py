"""Repeated passages by collinear chaining of shared word k-mers.

Every text gives sparse seeds: hashes of ``K`` consecutive words that are the least of some window of ``W`` such hashes, so that any
run of K + W - 1 equal words gives one in both texts. Each seed's first place (smallest id) is its source; all other places are
matched with that one only, so a passage in a third of all documents makes one match per seed and document, and no pairs within the
group. Matches of one document with one source are chained: places must rise in both, each match scores ``GAIN`` and each word of
a gap costs ``GAP``; the best chain to every match comes from a Fenwick tree of prefix maxima over the source's places. Chains are
then aligned on the words themselves, across the gaps and beyond both ends, and kept as passages from ``MIN_WORDS`` words and
``MIN_IDENTITY`` on; an alignment below that identity, as over two passages and what differs between them, is cut into its longest
stretches that reach it. Since an alignment runs on past its chain, seeds that went to another source cost little. Where they cost a passage, a second step finds it if
it is exact: every run of MIN_WORDS words that no passage holds and whose seeds all stand in several documents is matched with the
first document that holds that same run, and aligned too. An edited passage whose seeds went to lower ids can still be lost.

Odd rows: a null or empty text and a text of fewer than K words have no seeds; A-Z count as small letters; rows without an id take no part;
rows of one id are one document, whose repeats within itself are no matches, the first of its texts by content being aligned; ties go
to the smallest id and place; texts of any length are used whole; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.llm import common

K, W = 6, 12
GAIN, GAP = 8.0, 0.25
#: Score of a chain that is worth aligning: a single match.
MIN_SCORE = 8.0
MIN_WORDS, MIN_IDENTITY = 50, 0.8
#: Windows of W hashes within MIN_WORDS words, and seeds that they have at least.
INSIDE = MIN_WORDS - K - W + 2
LEAST_SEEDS = -(-INSIDE // W)
#: Words that an alignment beyond the chain may skip at once on either side, and equal words that must follow.
SKIP, AGAIN = 6, 4

SEEDS = common.arrow_schema(seed=pa.int64(), doc=pa.int64(), pos=pa.int32(), first=pa.bool_())
WORDS = common.arrow_schema(doc=pa.int64(), words=pa.binary(), seeds=pa.binary())
#: Words of MIN_WORDS in a row: ``open`` if no passage holds them, ``first`` at their first place in the document.
WINDOWS = common.arrow_schema(window=pa.int64(), doc=pa.int64(), pos=pa.int32(), open=pa.bool_(), first=pa.bool_())
PASSAGES = common.arrow_schema(doc_id=pa.int64(), start=pa.int64(), end=pa.int64(), source_doc_id=pa.int64(), source_start=pa.int64(),
                               source_end=pa.int64(), matched=pa.int64(), identity=pa.float64())
_PASSAGES_DDL = ("doc_id long, start long, end long, source_doc_id long, source_start long, source_end long, matched long, "
                 "identity double")


def word_hashes(texts: common.Texts) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.folded()
    begins, ends, first = texts.words()
    return texts.hashes(begins, ends), first


def _over(limit: np.ufunc, values: np.ndarray, window: int) -> np.ndarray:
    """The least or greatest of every ``window`` values in a row, from those of 2, 4, 8, ... in a row."""
    width = 1
    while 2 * width <= window:
        values, width = limit(values[:-width], values[width:]), 2 * width
    rest = window - width
    return limit(values[:-rest], values[rest:]) if rest else values


def sparse(hashes: np.ndarray, window: int = W) -> np.ndarray:
    """Places of the hashes that are the least of some window; all least ones of fewer hashes than a window."""
    n = len(hashes)
    if n <= window:
        return np.flatnonzero(hashes == hashes.min()) if n else np.zeros(0, dtype=np.int64)
    least = _over(np.minimum, hashes, window)
    # No hash is below the least of a window that holds it, so it is equal to one of them where it is equal to the greatest of them.
    around = np.full(n + window - 1, least.min(), dtype=hashes.dtype)
    around[window - 1:n] = least
    return np.flatnonzero(hashes == _over(np.maximum, around, window))


def _seeds(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at, texts in common.text_slices(batch.column(1)):
        docs = batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False)
        words, first = word_hashes(texts)
        parts = []
        for i in range(len(texts)):
            grams = common.window_hashes(words[first[i]:first[i + 1]], K)
            places = sparse(grams)
            if len(places):
                new = np.zeros(len(places), dtype=bool)
                new[np.unique(grams[places], return_index=True)[1]] = True
                parts.append((grams[places].view(np.int64), np.full(len(places), docs[i]), places, new))
        if parts:
            seed, doc, pos, new = (np.concatenate(c) for c in zip(*parts))
            yield common.record(SEEDS, seed, doc.astype(np.int64), pos.astype(np.int32), new)


def _words(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at, texts in common.text_slices(batch.column(1)):
        words, first = word_hashes(texts)
        short = (words >> np.uint64(32)).astype(np.uint32)
        yield common.record(WORDS, batch.column(0).slice(at, len(texts)), [short[first[i]:first[i + 1]].tobytes() for i in range(len(texts))],
                            [_ranked(words[first[i]:first[i + 1]]).tobytes() for i in range(len(texts))])


def _ranked(words: np.ndarray) -> np.ndarray:
    """Places of the seeds, and the rank of each one's hash among them."""
    grams = common.window_hashes(words, K)
    places = sparse(grams)
    return np.stack([places, np.unique(grams[places], return_inverse=True)[1]]).astype(np.int32)


def _lists(column: pa.Array, *fields: str) -> Iterator:
    """The lists of a column of numbers as arrays; of structs, one array a field."""
    first = column.offsets.to_numpy()
    held = [column.values.field(f) for f in fields] if fields else [column.values]
    held = [h.to_numpy(zero_copy_only=False) for h in held]
    for begin, end in zip(first[:-1], first[1:]):
        yield [h[begin:end] for h in held] if fields else held[0][begin:end]


def _windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of rows (doc, words, seeds, shared places, passages), the windows whose seeds all stand in other documents too."""
    parts = []
    doc_ids, texts, ranked, places_shared, passages_found = batch.columns
    for doc, words, seeds, shared, found in zip(doc_ids.to_pylist(), texts.to_pylist(), ranked.to_pylist(), _lists(places_shared), passages_found.to_pylist()):
        words = np.frombuffer(words, dtype=np.uint32).astype(np.uint64)
        windows = common.window_hashes(words, MIN_WORDS)
        if not len(windows):
            continue
        places, ranks = np.frombuffer(seeds, dtype=np.int32).reshape(2, -1)
        several = np.zeros(len(places), dtype=bool)
        several[ranks[np.isin(places, shared)]] = True
        # the least hash of every W is a seed, wherever the text goes on beyond them
        rank = np.full(len(words) - K + 1, len(places), dtype=np.int32)
        rank[places] = ranks
        least = _over(np.minimum, rank, W)
        alone = np.concatenate([[0], np.cumsum(~several[least])])
        keep = np.flatnonzero(alone[INSIDE:] == alone[:-INSIDE])
        if not len(keep):
            continue
        held = np.zeros(len(windows) + 1, dtype=np.int64)
        for p in found or ():
            held[min(p["start"], len(windows))] += 1
            held[min(max(p["start"], p["end"] - MIN_WORDS + 1), len(windows))] -= 1
        free = np.cumsum(held[:-1])[keep] == 0
        new = np.zeros(len(keep), dtype=bool)
        new[np.unique(windows[keep], return_index=True)[1]] = True
        some = free | new
        parts.append((windows[keep][some].view(np.int64), np.full(int(some.sum()), doc), keep[some], free[some], new[some]))
    if parts:
        window, doc, pos, free, new = (np.concatenate(c) for c in zip(*parts))
        yield common.record(WINDOWS, window, doc.astype(np.int64), pos.astype(np.int32), free, new)


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains of matches (x rising), best first, as lists of their numbers; no match is in two.

    score(i) = GAIN + max(0, score(j) - GAP * (x_i - x_j + y_i - y_j)) over j with smaller x and y. What j adds is
    score(j) + GAP * (x_j + y_j), whatever i is: a Fenwick tree keeps its largest value over prefixes of y.
    """
    ranks = {v: k + 1 for k, v in enumerate(sorted(set(y)))}
    size = len(ranks)
    best, who = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    waiting: list[int] = []
    for i in range(len(x)):
        if i and x[i] != x[i - 1]:  # matches of one x cannot follow each other
            for j in waiting:
                value, at = score[j] + GAP * (x[j] + y[j]), ranks[y[j]]
                while at <= size:
                    if value > best[at]:
                        best[at], who[at] = value, j
                    at += at & -at
            waiting = []
        at, top, j = ranks[y[i]] - 1, -np.inf, -1
        while at:
            if best[at] > top:
                top, j = best[at], who[at]
            at -= at & -at
        gain = top - GAP * (x[i] + y[i])
        score[i], before[i] = (GAIN + gain, j) if gain > 0 else (GAIN, -1)
        waiting.append(i)
    out, used = [], [False] * len(x)
    for end in sorted(range(len(x)), key=lambda i: -score[i]):
        if used[end] or score[end] < MIN_SCORE:
            continue
        chain, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        out.append(chain[::-1])
    return out


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Most equal words of an alignment of two short runs."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for w in a:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (b == w))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def _beyond(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """How two texts go on alike from their starts: equal runs (place in a, place in b, words)."""
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j)
        differ = a[i:i + n] != b[j:j + n]
        run = int(differ.argmax())
        if not differ[run]:
            run = n
        if run:
            out.append((i, j, run))
        i, j = i + run, j + run
        step = None
        mine, other = _next_words(a, i), _next_words(b, j)
        if set(mine).isdisjoint(other):
            break
        for total in range(1, 2 * SKIP + 1):
            for da in range(max(0, total - SKIP, total - len(other) + 1), min(SKIP, total, len(mine) - 1) + 1):
                if mine[da] == other[total - da]:
                    cost = (max(da, total - da), abs(2 * da - total))
                    if step is None or cost < step[0]:
                        step = (cost, i + da, j + total - da)
            if step is not None and total >= 2 * step[0][0]:
                break
        if step is None:
            break
        i, j = step[1], step[2]
    return out


def _next_words(words: np.ndarray, at: int) -> list[bytes]:
    """The ``AGAIN`` words from each place on that can be reached from ``at``; as bytes, they are compared far faster than as arrays."""
    near = words[at:at + SKIP + AGAIN]
    held, wide = near.tobytes(), near.itemsize
    return [held[k * wide:(k + AGAIN) * wide] for k in range(len(near) - AGAIN + 1)]


def _end(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Words of each text up to the end of the runs, and how many are equal."""
    return (runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2], sum(n for _, _, n in runs)) if runs else (0, 0, 0)


def _mirrored(runs: list[tuple[int, int, int]], i: int, j: int) -> list[tuple[int, int, int]]:
    """Runs found backwards from the places i and j, as places of the texts."""
    return [(i - p - n, j - q - n, n) for p, q, n in reversed(runs)]


def align(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> tuple[int, int, int, int, int]:
    """The passage around a chain of matches: its words in a and in b, and how many are equal."""
    i, j, same = x[0], y[0], 0
    for p, q in zip(x, y):
        if p > i or q > j:
            if p < i or q < j:  # matches that overlap with a shift: go on behind the shift
                p, q = p + max(i - p, j - q), q + max(i - p, j - q)
            same += _edits(a[i:p], b[j:q])
            i, j = p, q
        end = max(0, min(x_end(p, i), x_end(q, j)))
        n = min(end, len(a) - i, len(b) - j)
        same += int((a[i:i + n] == b[j:j + n]).sum())
        i, j = i + n, j + n
    back = _end(_beyond(a[:x[0]][::-1], b[:y[0]][::-1]))
    on = _end(_beyond(a[i:], b[j:]))
    return x[0] - back[0], i + on[0], y[0] - back[1], j + on[1], same + back[2] + on[2]


def x_end(place: int, at: int) -> int:
    """Words of the k-mer at ``place`` that lie behind ``at``."""
    return place + K - max(place, at)


def stretches(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Of the alignment around a chain, the longest stretch that is a passage, and again so on either side of it, as ``align`` gives them."""
    runs = []  # place in a, place in b, words, equal words, equal words of the gap before
    i, j = x[0], y[0]
    for p, q in zip(x, y):
        inner = 0
        if p > i or q > j:
            if p < i or q < j:
                p, q = p + max(i - p, j - q), q + max(i - p, j - q)
            on = _beyond(a[i:p], b[j:q])
            runs += [(i + u, j + v, n, n, 0) for u, v, n in on]
            i, j = i + _end(on)[0], j + _end(on)[1]
            back = _mirrored(_beyond(a[i:p][::-1], b[j:q][::-1]), p, q)
            inner = _edits(a[i:(back[0][0] if back else p)], b[j:(back[0][1] if back else q)])
            for u, v, n in back:
                runs.append((u, v, n, n, inner))
                inner = 0
            i, j = p, q
        n = max(0, min(x_end(p, i), x_end(q, j), len(a) - i, len(b) - j))
        runs.append((i, j, n, int((a[i:i + n] == b[j:j + n]).sum()), inner))
        i, j = i + n, j + n
    before = _mirrored(_beyond(a[:x[0]][::-1], b[:y[0]][::-1]), x[0], y[0])
    runs = [(u, v, n, n, 0) for u, v, n in before] + runs + [(i + u, j + v, n, n, 0) for u, v, n in _beyond(a[i:], b[j:])]
    s, u, n, equal, inner = np.array(runs, dtype=np.int64).T
    e, v, total = s + n, u + n, np.cumsum(equal + inner)
    out, todo = [], [(0, len(s))]
    while todo:
        first, end = todo.pop()
        best = (0, 0, 0)
        for k in range(first, end):
            if e[end - 1] - s[k] < MIN_WORDS or e[end - 1] - s[k] <= best[0]:
                break
            one, other, same = e[k:end] - s[k], v[k:end] - u[k], total[k:end] - total[k] + equal[k]
            good = np.flatnonzero((np.minimum(one, other) >= MIN_WORDS) & (same >= MIN_IDENTITY * np.maximum(one, other)))
            if len(good) and one[good[-1]] > best[0]:
                best = (int(one[good[-1]]), k, k + int(good[-1]))
        if best[0]:
            _, k, to = best
            out.append(tuple(int(c) for c in (s[k], e[to], u[k], v[to], total[to] - total[k] + equal[k])))
            todo += [(first, k), (to + 1, end)]
    return out


def passages(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int]) -> list[tuple[int, int, int, int, int, float]]:
    """Passages (start, end, source start, source end, equal words, identity) of two texts from their matches, by start.

    Without a chain, as in texts that repeat one word, the first match is aligned.
    """
    out: list[tuple[int, int, int, int, int, float]] = []
    for chain in chains(x, y) or [[0]]:
        if any(s <= x[chain[0]] and x[chain[-1]] + K <= e and u <= y[chain[0]] and y[chain[-1]] + K <= v for s, e, u, v, _, _ in out):
            continue  # an alignment went over it already
        along = [x[k] for k in chain], [y[k] for k in chain]
        s, e, u, v, same = align(a, b, *along)
        if min(e - s, v - u) < MIN_WORDS:
            continue
        whole = same >= MIN_IDENTITY * max(e - s, v - u)
        out += [(s, e, u, v, same, same / max(e - s, v - u))
                for s, e, u, v, same in ([(s, e, u, v, same)] if whole else stretches(a, b, *along))]
    return sorted(out)


def _align_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        rows = []
        docs, sources, at, texts, source_texts = batch.columns
        for doc, source, (pos, there), words, source_words in zip(docs.to_pylist(), sources.to_pylist(), _lists(at, "pos", "there"),
                                                                  texts.to_pylist(), source_texts.to_pylist()):
            order = np.lexsort((there, pos))
            found = passages(np.frombuffer(words, dtype=np.uint32), np.frombuffer(source_words, dtype=np.uint32), pos[order].tolist(), there[order].tolist())
            rows += [(doc, s, e, source, u, v, same, identity) for s, e, u, v, same, identity in found]
        if rows:
            yield common.record(PASSAGES, *zip(*rows))


def first_holders(rows: DataFrame, key: str) -> DataFrame:
    """(key, source, there): the smallest id of each key that is in several documents, and its first place there."""
    return (rows.where("first").groupBy(key).agg(F.min("doc").alias("source"), F.max("doc").alias("last"), F.min_by("pos", "doc").alias("there"))
            .where("last > source").drop("last"))


def aligned(matches: DataFrame, words: DataFrame) -> DataFrame:
    both = (matches.join(words.select("doc", "words"), "doc")
            .join(words.select(F.col("doc").alias("source"), F.col("words").alias("source_words")), "source"))
    return both.select("doc", "source", "at", "words", "source_words").mapInArrow(_align_rows, _PASSAGES_DDL)


def repeated(docs: DataFrame) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that stand in a document of smaller id too, in words; see ``PASSAGES``."""
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc IS NOT NULL")
    seeds = common.stored(docs.mapInArrow(common.batches(_seeds), "seed long, doc long, pos int, first boolean"), "chain-seeds")
    shared = (seeds.join(first_holders(seeds, "seed"), "seed").groupBy("doc", "source")
              .agg(F.collect_list(F.struct("pos", "there")).alias("at")))
    shared = common.stored(shared, "chain-matches")
    matches = shared.where((F.col("doc") != F.col("source")) & (F.size("at") >= 2))
    places = shared.groupBy("doc").agg(F.flatten(F.collect_list("at.pos")).alias("shared")).where(F.size("shared") >= LEAST_SEEDS)
    places = common.stored(places, "chain-places")
    involved = matches.select("doc").unionAll(matches.select(F.col("source").alias("doc"))).unionAll(places.select("doc")).distinct()
    involved = common.stored(involved, "chain-documents")
    few = involved.count() <= common.BROADCAST_IDS
    words = (docs.join(F.broadcast(involved) if few else involved, "doc").mapInArrow(common.batches(_words), "doc long, words binary, seeds binary")
             .groupBy("doc").agg(F.min(F.struct("words", "seeds")).alias("w")).select("doc", "w.*"))
    words = common.stored(words, "chain-words")
    found = common.stored(aligned(matches, words), "chain-passages")

    held = found.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start", "end")).alias("found"))
    windows = (words.join(places, "doc").join(held, "doc", "left").select("doc", "words", "seeds", "shared", "found")
               .mapInArrow(common.batches(_windows), "window long, doc long, pos int, open boolean, first boolean"))
    windows = common.stored(windows, "chain-windows")
    left = (windows.where("open").join(first_holders(windows, "window"), "window").where("doc <> source").groupBy("doc", "source")
            .agg(F.collect_list(F.struct("pos", "there")).alias("at")))
    return found.unionAll(aligned(common.stored(left, "chain-left"), words))


def query(docs: DataFrame) -> DataFrame:
    return repeated(docs)
