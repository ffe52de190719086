"""Codes, errors and codebooks against a plain version, and the owners' shares."""

import math

import numpy as np
import pytest

from skyspine.llm import common, lloyd

DDL = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, entry STRING, position STRING, n INT, part STRING, row STRING"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 1, "y", "z") for r in rows], DDL).repartition(3)


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Row by row in Python: codes and errors of the usable rows, and the codebooks."""
    use = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows
           if v and all(x is not None and math.isfinite(x) for x in v)]
    use.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(use[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in use]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def closest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c in cut:
                held.setdefault(closest(c[p], books[p])[1], []).append(c[p])
            for k, xs in held.items():
                books[p][k] = [sum(x[j] for x in xs) // len(xs) for j in range(width)]
    out = []
    for (i, _, label), c in zip(use, cut):
        best = [closest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, [b[1] for b in best], sum(b[0] for b in best)))
    return out, books


def vectors(n, seed=3, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (5, 8))
    rows = [(k, [float(np.float32(x)) for x in centres[rng.integers(5)] + rng.normal(0, 0.05, 8)], int(rng.integers(3))) for k in range(n)]
    return rows + [(n + k, rows[0][1], None) for k in range(hot)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3])


def test_like_the_plain_version(spark):
    rows = vectors(150, hot=70) + [(None, vectors(1)[0][1], 1), (3, vectors(1, seed=8)[0][1], 0), (3, vectors(1, seed=8)[0][1], 0),
                                   (900, None, 1), (901, [], 1), (902, [0.1, None] * 4, 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] * 8, 2)]
    got, books = lloyd.compress(frame(spark, rows), parts=2, entries=16, rounds=3, owners=5)
    want, plain_books = plain(rows, parts=2, entries=16, rounds=3)
    assert books.tolist() == plain_books
    assert sorted(((r["vec_id"], r["label"], r["entries"], r["error"]) for r in got.collect()), key=key) == sorted(want, key=key)


def test_query_columns(spark):
    rows = vectors(300)
    got = {r["vec_id"]: r for r in lloyd.query(frame(spark, rows)).collect()}
    want, books = plain(rows)
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    assert len(got) == len(want)
    for i, label, entries, error in want:
        r = got[i]
        assert (r["code"], r["error"], r["label_error"]) == ("".join(f"{e:02x}" for e in entries), error, by_label[label])
    assert {r["codebooks_sha256"] for r in got.values()} == {lloyd.digest(np.array(books))}


def test_empty_and_unusable_tables(spark):
    assert lloyd.query(frame(spark, []).limit(0)).collect() == []
    assert lloyd.query(frame(spark, [(1, None, 2), (2, [float("nan")] * 4, None)])).collect() == []
    one = lloyd.query(frame(spark, [(1, [0.5] * 4, None)])).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in one] == [("00000000", 0, 0)]


@pytest.mark.parametrize("rows", [[(1, [0.5] * 6, 1)], [(1, [0.5] * 4, 1), (2, [0.5] * 8, 1)], [(1, [1e9] * 4, 1)]])
def test_vectors_that_cannot_be_coded_end_the_job(spark, rows):
    with pytest.raises(Exception, match="multiple of 4|errors would not fit"):
        lloyd.query(frame(spark, rows)).collect()


def test_nearest_is_exact_for_large_values():
    rng = np.random.default_rng(1)
    m, b = rng.integers(-lloyd.MOST + 1, lloyd.MOST, (40, 8)), rng.integers(-lloyd.MOST + 1, lloyd.MOST, (9, 8))
    entry, distance = lloyd.nearest(m, b)
    for k, x in enumerate(m.tolist()):
        assert (distance[k], entry[k]) == min((sum((p - q) ** 2 for p, q in zip(x, e)), j) for j, e in enumerate(b.tolist()))


def test_only_movers_are_dealt_and_hot_entries_are_salted(spark):
    rows = frame(spark, vectors(200, hot=400))
    books = lloyd.first_codebooks(lloyd.kept(rows), 2, 8, 1024)
    start = common.stored(lloyd.cut(lloyd.kept(rows), books, 1024), "parts")
    counts = lloyd.census(start)
    assert max(counts.values()) > sum(counts.values()) / 4
    dealt = lloyd.dealt(start, lloyd.owner_salt(counts, 2, 8, 10), 10)
    sizes = dealt.rdd.glom().map(len).collect()
    assert sum(sizes) == 1200 and max(sizes) < 0.45 * 1200 and len([s for s in sizes if s]) >= 6
    again = lloyd.assigned(common.stored(dealt, "members"), books)
    assert again.where("moves").count() == 0
    new, _ = lloyd.updated(start, books)
    moved = lloyd.assigned(start, new)
    assert 0 < moved.where("moves").count() < 600
    assert moved.where("NOT moves").join(start.select("vec_id", "position", "entry"), ["vec_id", "position", "entry"]).count() == moved.where("NOT moves").count()
