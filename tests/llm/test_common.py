import random

import numpy as np
import pyarrow as pa
import pytest

from skyspine.llm import common


def slices(texts, most=common.SLICE_BYTES):
    return list(common.text_slices(pa.array(texts, type=pa.string()), most))


def test_words_and_hashes_follow_the_bytes():
    texts = ["a bc  a\tä\n", None, "", " \x0b", "bc", "ä " + "x" * 50]
    for most in (1, 7, 1000):
        got = []
        for _, t in slices(texts, most):
            begins, ends, first = t.words()
            h = t.hashes(begins, ends)
            got += [h[first[i]:first[i + 1]].tolist() for i in range(len(t))]
        a, bc, _, u = got[0]
        assert got[1:4] == [[], [], []] and got[0][2] == a and got[4] == [bc] and got[5][0] == u and len({a, bc, u, got[5][1]}) == 4


def test_slices_of_a_slice_and_of_null_slots_with_bytes():
    column = pa.array(["one", "two three", None, "four"]).slice(1)
    assert [bytes(t.data) for _, t in common.text_slices(column)] == [b"two threefour"]
    held = pa.Array.from_buffers(pa.string(), 2, [pa.py_buffer(b"\x02"), pa.py_buffer(np.array([0, 3, 5], dtype=np.int32)), pa.py_buffer(b"gonehe")])
    (_, t), = common.text_slices(held)
    assert bytes(t.data) == b"eh" and t.starts.tolist() == [0, 0, 2]


def test_windows_depend_on_order():
    w = np.array([5, 9, 5, 9, 5], dtype=np.uint64)
    h = common.window_hashes(w, 2)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1] and len(common.window_hashes(w, 6)) == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_a_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(30 + 10 * seed)] + [(100 + i, 101 + i) for i in range(25)] + [(7, None), (300, 300)]
    near = {}
    for a, b in edges:
        if b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == want


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []
