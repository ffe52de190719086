"""Jaccard join of word n-gram sets by prefix trees, and its connected components.

Sets are ordered by one global order of the n-grams, rarest first. With lead = 3 + n / 64 (n for a smaller set), two sets that link
share at least the smaller one's lead of n-grams among the first n - ceil(t n) + lead of both, and are of similar size. That gives candidate pairs without looking at
whole sets. Sets joined by candidate pairs form groups; only these sets are formed again and brought
together, a group once, or a large group in blocks, every block with every other. There the sets, now most frequent n-gram first,
are stored in a tree, so that similar sets share a path. Each set walks the tree: the overlap with a path is counted once for all
sets below it, and a subtree is left when the lengths that remain cannot reach the threshold, or when all below is joined already.

Equal sets are one node from the start, so groups of copies cost one. N-grams listed as frequent (by lossy counting over all
documents: local counts of at least ``LOCAL_COUNT``, the list held to ``LISTED`` entries) stand last in the order. Their buckets, which may be
huge, are never gathered: their sets are tied to a node of the bucket and their range of sizes instead, and so are sets of other
buckets with more than ``BUCKET`` others of similar size. Two sets that link either share such a node or share all of that lead in small buckets.
The order only moves work; every linked pair is found whatever the counts.

Sets are known by 64-bit hashes of their n-grams and of the whole. Only the list of frequent n-grams passes through the driver.

Odd rows: a null text or one without words is the empty set, linked with nothing, its own component; a text of fewer than
``size`` words is one n-gram, its words; repeated rows and equal sets share a component; rows of one id count as linked; a null id takes
part in no other row's component, and gets the smallest id of its set's copies, or null; texts of any length are used whole;
an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.llm import common

#: N-grams counted together before the rarer ones are let go; the count that stays; the longest list.
COUNTED, LOCAL_COUNT, LISTED = 4_000_000, 3, 1 << 18
#: Sets of a bucket and of similar size that are compared one by one with a set; sets of a bucket that are held at a time.
BUCKET, HELD = 64, 20_000
#: N-grams of the sets of one block.
BLOCK_TOKENS = 1_500_000
#: Length of a piece of path between two tests of the bound.
RUN = 64
#: Rows of ids that are broadcast.
BROADCAST_ROWS = 100_000


def shingle_sets(texts: common.Texts, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-grams of each text."""
    texts = texts.folded()
    begins, ends, first = texts.words()
    words = texts.hashes(begins, ends)
    for i in range(len(texts)):
        w = words[first[i]:first[i + 1]]
        yield np.unique(common.window_hashes(w, min(size, len(w)))) if len(w) else w


def node_of(grams: np.ndarray) -> int:
    """The set's identity, an even signed 64-bit number."""
    total = common.mix(grams).sum(dtype=np.uint64, keepdims=True) + np.array([len(grams)], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(common.mix(total).view(np.int64)[0]) & ~1


def lead(n):
    """N-grams at the front that a set of ``n`` shares with a candidate that is no smaller."""
    return np.minimum(n, 3 + n // 64)


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - (percent * n + 99) // 100 + int(lead(n)))


SETS = common.arrow_schema(doc_id=pa.int64(), n=pa.int64(), node=pa.int64(), token=pa.int64())
_SETS_DDL = "doc_id long, n long, node long, token long"


def _sets_and_counts(size: int):
    """Rows (doc_id, n, node) for texts, and rows (token, n) for n-grams that are frequent among some."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def frequent() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= LOCAL_COUNT
            none = pa.nulls(int(keep.sum()), pa.int64())
            return common.record(SETS, none, n[keep], none, tokens[keep].view(np.int64))

        for batch in it:
            for at, texts in common.text_slices(batch.column(1)):
                sizes, nodes = [], []
                for grams in shingle_sets(texts, size):
                    sizes.append(len(grams))
                    nodes.append(node_of(grams) if len(grams) else None)
                    held.append(grams)
                    count += len(grams)
                yield common.record(SETS, batch.column(0).slice(at, len(texts)), sizes, nodes, pa.nulls(len(texts), pa.int64()))
                if count >= COUNTED:
                    yield frequent()
                    held, count = [], 0
        if held:
            yield frequent()
    return run


def frequent_tokens(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The list of frequent n-grams, sorted, with their counts; as many of the most frequent as fit."""
    total = counts.groupBy("token").agg(F.sum("n").alias("n"))
    levels = total.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("c")).collect()
    room, least = LISTED, None
    for r in sorted(levels, key=lambda r: -r["n"]):
        room -= r["c"]
        if room < 0 and least is not None:
            break
        least = r["n"]  # the highest level even if it does not fit whole: then the limit cuts it
    rows = total.where(F.col("n") >= (1 << 17 if least is None else least)).orderBy(F.desc("n"), "token").limit(LISTED).collect()
    tokens = np.array([r["token"] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["n"] for r in rows], dtype=np.int64)[order]


def rank(grams: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of the n-grams as far as listed, else 0."""
    tokens, counts = listed
    if not len(tokens):
        return np.zeros(len(grams), dtype=np.int64)
    at = np.searchsorted(tokens, grams)
    at[at == len(tokens)] = 0
    return np.where(tokens[at] == grams, counts[at], 0)


ENTRIES = common.arrow_schema(deal=pa.int64(), token=pa.int64(), node=pa.int64(), n=pa.int32(), listed=pa.bool_())
_ENTRIES_DDL = "deal long, token long, node long, n int, listed boolean"


def _prefixes(size: int, percent: int, shared):
    """The first n-grams of every set, once per task and node. Those listed are dealt out by node, the others by n-gram."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, seen = shared.value, set()
        for batch in it:
            for _, texts in common.text_slices(batch.column(0)):
                parts = []
                for grams in shingle_sets(texts, size):
                    node = node_of(grams) if len(grams) else None
                    if node is None or node in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    count = rank(grams, listed)
                    first = np.lexsort((grams, count))[:prefix_size(len(grams), percent)]
                    parts.append((grams[first].view(np.int64), np.full(len(first), node), np.full(len(first), len(grams)), count[first] > 0))
                if parts:
                    token, node, n, known = (np.concatenate(c) for c in zip(*parts))
                    yield common.record(ENTRIES, np.where(known, node, token), token, node, n.astype(np.int32), known)
    return run


PAIRS = common.arrow_schema(a=pa.int64(), b=pa.int64())
#: ``votes`` n-grams of a pair, of which it needs ``need``; a tie needs one.
VOTES = common.arrow_schema(a=pa.int64(), b=pa.int64(), need=pa.int64(), votes=pa.int64())


def ties(token: np.ndarray, node: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """(set, odd node of the bucket and a range of sizes); sets of similar size share one of their two ranges."""
    band = np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.uint64)
    both = [common.mix(token.view(np.uint64) + (band + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) | 1 for k in (0, 1)]
    return np.stack([np.concatenate([node, node]), np.concatenate(both), np.ones(2 * len(node), dtype=np.int64)], axis=1)


def _candidates(percent: int):
    """Votes for pairs of sets (even, even), and ties (even, odd), from entries sorted by n-gram, length and node."""
    def found(token, node, n) -> list[np.ndarray]:
        """Each set with those behind it that are of similar size: a vote for each, or ties for all if they are many."""
        if not len(token):
            return []
        bucket = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) << 32
        end = np.searchsorted(bucket + n, bucket + 100 * n // percent, side="right")
        many = end - np.arange(len(token)) - 1 > BUCKET
        cover = np.zeros(len(token) + 1, dtype=np.int64)
        np.add.at(cover, np.flatnonzero(many), 1)
        np.add.at(cover, end[many], -1)
        tied = np.cumsum(cover[:-1]) > 0
        out = [ties(token[tied], node[tied], n[tied], percent)]
        for d in range(1, BUCKET + 1):
            at = np.flatnonzero(~many[:-d] & (end[:-d] > np.arange(d, len(token))))
            if not len(at):
                break
            x, y = node[at], node[at + d]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y), lead(n[at])], axis=1))
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, big = None, None  # entries of a bucket that may go on; the n-gram of a bucket too large to hold
        for batch in it:
            token, node, n, listed = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            n = n.astype(np.int64)
            out = [ties(token[listed], node[listed], n[listed], percent)]
            rest = [x[~listed] for x in (token, node, n)]
            if carry is not None:
                rest = [np.concatenate(x) for x in zip(carry, rest)]
            if len(rest[0]):
                new = np.concatenate([[True], (rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])])
                rest = [x[new] for x in rest]  # tasks may send the same set
                last = rest[0] == rest[0][-1]
                if last.sum() > HELD:
                    big = rest[0][-1]
                large = rest[0] == big if big is not None else np.zeros(len(last), dtype=bool)
                out.append(ties(*(x[large] for x in rest), percent))
                out += found(*(x[~large & ~last] for x in rest))
                carry = [x[last & ~large] for x in rest]
            yield from summed(np.concatenate(out))
        if carry is not None:
            yield from summed(np.concatenate([np.zeros((0, 3), dtype=np.int64), *found(*carry)]))

    def summed(votes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row per pair, with its votes."""
        if len(votes):
            votes = votes[np.lexsort((votes[:, 1], votes[:, 0]))]
            head = np.flatnonzero(np.concatenate([[True], (votes[1:, :2] != votes[:-1, :2]).any(axis=1)]))
            yield common.record(VOTES, *votes[head].T, np.diff(np.concatenate([head, [len(votes)]])))

    return run


MEMBERS = common.arrow_schema(node=pa.int64(), root=pa.int64(), blocks=pa.int32(), grams=pa.binary())
_MEMBERS_DDL = "node long, root long, blocks int, grams binary"


def packed(grams: np.ndarray, listed: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> bytes:
    """A sorted set, most frequent n-gram first: listed n-grams by ``place`` in their order, as steps that compress well, then the others."""
    known = rank(grams, listed) > 0
    at = np.searchsorted(listed[0], grams)
    steps = np.diff(np.sort(place[at[known]]), prepend=0).astype(np.uint32)
    return np.uint32(len(steps)).tobytes() + steps.tobytes() + grams[~known].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The set as numbers in its order; listed n-grams are their places."""
    n = int(np.frombuffer(data, dtype=np.uint32, count=1)[0])
    steps = np.frombuffer(data, dtype=np.uint32, count=n, offset=4)
    return np.concatenate([np.cumsum(steps, dtype=np.uint64), np.frombuffer(data[4 + 4 * n:], dtype=np.uint64)])


def _members(size: int, shared):
    """Of rows (text, node, root, blocks) whose text is that node's, the packed set."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        place = np.empty(len(listed[0]), dtype=np.int64)
        place[np.lexsort((listed[0], -listed[1]))] = np.arange(len(place))
        for batch in it:
            node = batch.column(1).to_pylist()
            for at, texts in common.text_slices(batch.column(0)):
                keep, sets = [], []
                for i, grams in enumerate(shingle_sets(texts, size), at):
                    if len(grams) and node_of(grams) == node[i]:
                        keep.append(i)
                        sets.append(packed(grams, listed, place))
                some = pa.array(keep, type=pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(some) for k in (1, 2, 3)), pa.array(sets, type=pa.binary())], schema=MEMBERS)
    return run


class Branch:
    """A path of the tree and what hangs on it: sets [first, end) of the sorted list share its n-grams."""

    __slots__ = ("runs", "depth", "ends", "below", "first", "end", "least", "most")


def tree(sets: list[np.ndarray]) -> Branch:
    """The prefix tree of sets in an order that puts equal beginnings together."""
    def branch(first: int, end: int, depth: int) -> Branch:
        a, b = sets[first], sets[end - 1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        to = depth + int(differ[0]) if len(differ) else n
        x = Branch()
        x.runs = [(a[k:min(k + RUN, to)], min(k + RUN, to)) for k in range(depth, to, RUN)]
        x.depth, x.first, x.end, x.below = to, first, end, []
        x.ends = [i for i in range(first, end) if len(sets[i]) == to]
        lengths = [len(s) for s in sets[first:end]]
        x.least, x.most = min(lengths), max(lengths)
        return x

    top = branch(0, len(sets), 0)
    todo = [top]
    while todo:
        x = todo.pop()
        go = x.first
        ended = set(x.ends)
        while go < x.end:
            if go in ended:
                go += 1
                continue
            to = go + 1
            while to < x.end and to not in ended and sets[to][x.depth] == sets[go][x.depth]:
                to += 1
            x.below.append(branch(go, to, x.depth))
            go = to
        todo += x.below
    return top


def walk(top: Branch, n: int, marked: np.ndarray, percent: int, skip) -> Iterator[int]:
    """Places of the sets that link with a set of ``n`` n-grams, those that are ``marked``; ``skip(branch)`` says which branches are
    of no interest."""
    todo = [(top, 0)]
    while todo:
        x, overlap = todo.pop()
        if 100 * n < percent * x.least or 100 * x.most < percent * n or skip(x):
            continue
        for run, depth in x.runs:
            overlap += int(np.count_nonzero(marked[run]))
            if (100 + percent) * (overlap + x.most - depth) < percent * (n + x.most):
                break
        else:
            for i in x.ends:
                if (100 + percent) * overlap >= percent * (n + x.depth):
                    yield i
            todo += [(y, overlap) for y in x.below]


def linked(nodes: list[int], sets: list[np.ndarray], side: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join all linked sets, of one side with each other if there is one side, else of one side with the other."""
    every, codes = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum([len(s) for s in sets])[:-1]
    sets = np.split(codes.astype(np.int32), cut)
    marked = np.zeros(len(every), dtype=bool)
    order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
    trees = [i for i in order if side[i] == max(side)]
    top = tree([sets[i] for i in trees])
    parent = {x: x for x in nodes}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    alone = min(side) == max(side)
    asking = trees if alone else [i for i in order if side[i] == min(side)]
    for at, q in enumerate(asking):
        mine = nodes[q]

        def skip(x: Branch) -> bool:
            if alone and x.end <= at + 1:
                return True
            return x.end - x.first <= 4 and all(root(nodes[trees[k]]) == root(mine) for k in range(x.first, x.end))

        marked[sets[q]] = True
        for place in walk(top, len(sets[q]), marked, percent, skip):
            a, b = root(mine), root(nodes[trees[place]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield mine, nodes[trees[place]]
        marked[sets[q]] = False


def _solve(percent: int):
    """Links from rows (root, i, j, block, node, grams) sorted by root and block pair."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, links = None, [], []

        def solve() -> None:
            nodes, sets, side = [], [], []
            for _, _, _, block, node, grams in {r[4]: r for r in held}.values():
                nodes.append(node)
                sets.append(unpacked(grams))
                side.append(block)
            if len(nodes) > 1 and (key[1] == key[2] or len(set(side)) == 2):
                links.extend(linked(nodes, sets, side, percent))

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if held:
                        solve()
                    key, held = row[:3], []
                held.append(row)
            if len(links) >= 10_000:
                yield common.record(PAIRS, *zip(*links))
                links.clear()
        if held:
            solve()
        if links:
            yield common.record(PAIRS, *zip(*links))
    return run


def join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text); sets link when 100 * overlap >= percent * union."""
    spark = common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.stored(docs.mapInArrow(_sets_and_counts(size), _SETS_DDL), "trie-sets")
    own = rows.where("token IS NULL").drop("token")
    listed = spark.sparkContext.broadcast(frequent_tokens(rows.where("token IS NOT NULL")))

    entries = docs.select("text").mapInArrow(_prefixes(size, percent, listed), _ENTRIES_DDL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(parts, "deal").sortWithinPartitions("token", "n", "node")
    votes = entries.mapInArrow(_candidates(percent), "a long, b long, need long, votes long")
    pairs = votes.groupBy("a", "b", "need").agg(F.sum("votes").alias("votes")).where("votes >= need").select("a", "b")
    groups = common.components(pairs).where(F.col("node") % 2 == 0)

    nodes = common.stored(own.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id")), "trie-nodes")
    grouped = common.stored(nodes.join(groups, "node").where("doc_id IS NOT NULL"), "trie-groups")
    blocks = (grouped.groupBy("root").agg(F.count("*").alias("c"), F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
              .where("c > 1").drop("c"))
    wanted = common.stored(grouped.join(blocks, "root").select("doc_id", "node", "root", "blocks"), "trie-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "node", "root", "blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = texts.mapInArrow(_members(size, listed), _MEMBERS_DDL).withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocked = (members.withColumn("other", other)
               .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "grams")
               .repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j"))
    joined = common.components(blocked.mapInArrow(_solve(percent), "a long, b long"))
    smallest = (nodes.join(joined, "node").groupBy("root").agg(F.min("doc_id").alias("component")))
    of_node = nodes.join(joined, "node", "left").join(smallest, "root", "left").select(
        "node", F.coalesce("component", "doc_id").alias("component"))
    return own.join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id. Rows of the empty set and without an id stay."""
    found = common.stored(join(docs, **options), "trie-components").where("doc_id IS NOT NULL AND n_shingles > 0")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    left = common.without(docs, gone, "doc_id")
    again = common.stored(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "trie-repeats")
    if not again.head(1):
        return left
    repeats = left.join(again, "doc_id", "left_semi").select(*docs.columns)
    return common.without(left, again, "doc_id").unionByName(repeats.dropDuplicates(["doc_id"]))


def query(docs: DataFrame) -> DataFrame:
    return join(docs)


SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM parts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes s ON s.doc_id = a.doc_id JOIN sizes t ON t.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, s.n, t.n HAVING 100 * count(*) >= 90 * (s.n + t.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM parts UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT p.doc_id, coalesce(s.n, 0) AS n_shingles, min(r) AS component_id
FROM parts p JOIN reach USING (doc_id) LEFT JOIN sizes s USING (doc_id) GROUP BY p.doc_id, s.n
"""
