import random

import pytest

from skyspine.llm import voronoi_join as vj


def brute(rows, k, every):
    ints = []
    for i, v in rows:
        if i is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        ints.append((i, [int((256 * x) // 1) for x in v]))
    out = []
    for i, q in ints:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, s)), j) for j, s in ints if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=5, every=5, ddl="vec_id LONG, embedding ARRAY<DOUBLE>, label INT, row LONG, g INT"):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], ddl)
    return sorted(tuple(r) for r in vj.query(df, every, k).collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(vj, "GROUP_QUERIES", 20)
    monkeypatch.setattr(vj, "BLOCK_ROWS", 150)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, (0.02, 0.3, 2)[seed]) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(i, list(rows[0][1])) for i in range(700, 730)]  # repeated vectors: ties
    assert run(spark, rows) == brute(rows, 5, 5)


def test_pruning_leaves_rows_out(spark):
    """Far clusters are not sent to a group that cannot need them."""
    rng = random.Random(4)
    rows = [(i, [100.0 * (k == i % 4) + rng.random() for k in range(4)]) for i in range(400)]
    data = vj.scaled(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>"))
    assert sorted(tuple(r)[1:] for r in vj.top_k(data, data.where("id % 40 = 0"), 3).collect()) == brute(rows, 3, 40)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [0.5]), (5, [0.25, 0.25]), (7, None), (8, [None, 1.0]), (9, [nan, 1.0]), (10, [inf, 1.0]), (None, [9.0, 9.0]),
            (11, []), (12, [-0.001, 0.0]), (13, [3.0, 1.0, 5.0]), (15, [1.0, 2.0]), (20, [1.0, 2.0])]
    got = run(spark, rows)
    want = brute(rows, 5, 5)
    # the two rows of id 5 are queries of their own under one id
    assert got == want
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0 ** 22, 1.0]), (1, [2.0 ** 22, 3.0]), (2, [2.0 ** 22, 2.0]), (3, [-(2.0 ** 22), 9.0])]
    assert run(spark, rows) == brute(rows, 5, 5)
