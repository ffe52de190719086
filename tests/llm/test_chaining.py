import random

import numpy as np
import pytest

from skyspine.llm import chaining as ch
from skyspine.llm import common


def passage(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        out += [] if r < rate / 3 else [f"new{rng.randrange(9999)}"] if r < 2 * rate / 3 else [w, "added"] if r < rate else [w]
    return out


def test_fenwick_chains_equal_a_quadratic_search():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(1, 25)
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(n)})
        x, y = [p for p, _ in points], [q for _, q in points]
        best = []
        for i in range(len(x)):
            go = [best[j] - ch.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best.append(ch.GAIN + max([0.0, *go]))
        got = ch.chains(x, y)
        top = max(best)
        assert bool(got) == (top >= ch.MIN_SCORE)
        for k, chain in enumerate(got):
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(chain, chain[1:]))
            if not k:
                steps = sum(ch.GAP * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(chain, chain[1:]))
                assert ch.GAIN * len(chain) - steps == pytest.approx(top)
        assert len({i for c in got for i in c}) == sum(map(len, got))


def test_seeds_hit_every_long_enough_run():
    rng = np.random.default_rng(2)
    run = rng.integers(0, 2 ** 63, ch.K + ch.W - 1).astype(np.uint64)
    for _ in range(200):
        a, b = (common.window_hashes(np.concatenate([rng.integers(0, 2 ** 63, rng.integers(0, 40)).astype(np.uint64), run,
                                                     rng.integers(0, 2 ** 63, rng.integers(0, 40)).astype(np.uint64)]), ch.K) for _ in range(2))
        assert set(a[ch.sparse(a)].tolist()) & set(b[ch.sparse(b)].tolist())
    many = rng.integers(0, 2 ** 63, 20_000).astype(np.uint64)
    assert len(ch.sparse(many)) < 0.17 * len(many)


def test_seeds_are_the_least_of_their_windows():
    rng = np.random.default_rng(3)
    for _ in range(500):
        n, window = int(rng.integers(1, 60)), int(rng.integers(1, 20))
        hashes = rng.integers(0, rng.choice([1, 3, 9, 2 ** 63]), n).astype(np.uint64)
        starts = range(max(1, n - window + 1))
        want = {k for i in starts for k in range(i, min(n, i + window)) if hashes[k] == hashes[i:i + window].min()}
        assert ch.sparse(hashes, window).tolist() == sorted(want)
        if n >= window:
            assert ch._over(np.minimum, hashes, window).tolist() == [int(hashes[i:i + window].min()) for i in starts]


def test_lists_are_read_as_arrays():
    import pyarrow as pa
    pairs = pa.array([[{"pos": 9, "there": 9}], [{"pos": 4, "there": 1}, {"pos": 2, "there": 7}], []], pa.list_(pa.struct([("pos", pa.int32()), ("there", pa.int32())])))
    assert [[p.tolist(), q.tolist()] for p, q in ch._lists(pairs.slice(1), "pos", "there")] == [[[4, 2], [1, 7]], [[], []]]
    assert [a.tolist() for a in ch._lists(pa.array([[1], [2, 3], []], pa.list_(pa.int32())).slice(1))] == [[2, 3], []]


@pytest.mark.parametrize("rate", [0.0, 0.04, 0.1])
def test_planted_passages_are_found_where_they_are(documents, rate):
    rng = random.Random(int(rate * 100))
    rows, planted = [], {}
    for k in range(25):
        p = passage(rng, rng.randrange(80, 200))
        a = passage(rng, rng.randrange(0, 90)) + p + passage(rng, rng.randrange(0, 90))
        before, q = passage(rng, rng.randrange(0, 90)), edited(rng, p, rate)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(before + q + passage(rng, rng.randrange(0, 90))).upper())]
        planted[2 * k + 1] = (2 * k, len(before), len(before) + len(q))
    rows += [(1000 + k, " ".join(passage(rng, 300))) for k in range(30)]
    found = {}
    for r in ch.repeated(documents(rows)).collect():
        assert planted[r["doc_id"]][0] == r["source_doc_id"] and r["identity"] >= ch.MIN_IDENTITY
        start, end = planted[r["doc_id"]][1:]
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + max(0, min(end, r["end"]) - max(start, r["start"]))
        assert start - 8 <= r["start"] and r["end"] <= end + 8
    assert len(found) >= (25 if rate < 0.1 else 22)
    assert sum(found.values()) >= (0.97 if rate < 0.1 else 0.85) * sum(e - s for _, s, e in planted.values())


def test_a_passage_in_many_documents_makes_one_match_each(documents):
    rng = random.Random(5)
    p = passage(rng, 70)
    rows = [(k, " ".join(passage(rng, 30) + p + passage(rng, 30))) for k in range(60)]
    got = ch.repeated(documents(rows)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1, 60)) and {r["source_doc_id"] for r in got} == {0}


def test_seeds_that_went_elsewhere_do_not_shorten_a_passage(documents):
    rng = random.Random(6)
    p = passage(rng, 90)
    rows = [(0, " ".join(passage(rng, 50) + p[:30] + passage(rng, 50))), (1, " ".join(passage(rng, 50) + p + passage(rng, 50))),
            (2, " ".join(passage(rng, 40) + p + passage(rng, 40)))]
    got = [(r["doc_id"], r["start"], r["end"], r["source_doc_id"]) for r in ch.repeated(documents(rows)).collect()]
    assert len(got) == 1 and got[0][0] == 2 and got[0][3] == 1 and abs(got[0][1] - 40) <= 2 and abs(got[0][2] - 130) <= 2


@pytest.mark.parametrize("size", [60, 100, 200])
@pytest.mark.parametrize("one_sided", [False, True])
def test_two_exact_passages_of_one_pair_are_both_found(size, one_sided):
    """At any gap, and with an insert on one side only."""
    rng = np.random.default_rng(size)
    for gap in (10, 20, 45, 60, 100, 150, 220, 300):
        for _ in range(10):
            def new(n):
                return rng.integers(0, 2 ** 32, n).astype(np.uint32)

            p, q, ends = new(size), new(size), [new(rng.integers(0, 60)) for _ in range(4)]
            a = np.concatenate([ends[0], p, new(gap), q, ends[1]])
            b = np.concatenate([ends[2], p, new(0 if one_sided else gap), q, ends[3]])
            grams = [common.window_hashes(t.astype(np.uint64), ch.K) for t in (a, b)]
            there = {int(grams[1][k]): int(k) for k in ch.sparse(grams[1])}
            at = [(int(k), there[int(grams[0][k])]) for k in ch.sparse(grams[0]) if int(grams[0][k]) in there]
            found = ch.passages(a, b, [k for k, _ in at], [k for _, k in at])
            assert all(same >= ch.MIN_IDENTITY * max(e - s, v - u) and min(e - s, v - u) >= ch.MIN_WORDS for s, e, u, v, same, _ in found)
            for begin in (len(ends[0]), len(ends[0]) + size + gap):
                assert sum(max(0, min(e, begin + size) - max(s, begin)) for s, e, *_ in found) >= 0.95 * size


@pytest.mark.parametrize("size, cuts", [(55, [(0, 45)]), (60, [(0, 30), (30, 60)]), (80, [(0, 40), (40, 80)]), (100, [(0, 48), (26, 74), (52, 100)]),
                                        (60, [(0, 20), (20, 40), (40, 60)]), (50, [(0, 25), (20, 50)])])
def test_an_exact_passage_is_found_though_pieces_of_it_stand_in_lower_ids(documents, size, cuts):
    rng = random.Random(size + len(cuts))
    rows, at = [], {}
    for k in range(0, 20 * 25, 20):
        p = passage(rng, size)
        rows += [(k + i, " ".join(passage(rng, 30) + p[s:e] + passage(rng, 30))) for i, (s, e) in enumerate(cuts)]
        at[k + 11] = rng.randrange(60)
        rows += [(k + 10, " ".join(passage(rng, 25) + p + passage(rng, 40))), (k + 11, " ".join(passage(rng, at[k + 11]) + p + passage(rng, 20)))]
    got = {(r["doc_id"], r["source_doc_id"]): r for r in ch.repeated(documents(rows)).collect()}
    assert set(got) == {(d, d - 1) for d in at}
    assert all(abs(r["start"] - at[d]) <= 2 and abs(r["end"] - at[d] - size) <= 2 for (d, _), r in got.items())


def test_odd_rows(documents):
    rng = random.Random(7)
    p = " ".join(passage(rng, 60))
    rows = [(1, None), (2, ""), (3, "few words only"), (4, p), (5, p), (5, p), (None, p), (6, f"{p} {p}"), (7, "w " * 30_000), (8, "w " * 30_000), (9, " ".join(passage(rng, 49)))]
    got = {(r["doc_id"], r["source_doc_id"]): r for r in ch.repeated(documents(rows)).collect()}
    assert set(got) == {(5, 4), (6, 4), (8, 7)}
    assert got[8, 7]["end"] - got[8, 7]["start"] >= ch.MIN_WORDS and got[5, 4]["matched"] == 60
    assert ch.repeated(documents([])).collect() == []


def test_going_on_beyond_a_chain_equals_a_plain_search():
    def plain(a, b):
        i, j, out = 0, 0, []
        while i < len(a) and j < len(b):
            run = 0
            while i + run < len(a) and j + run < len(b) and a[i + run] == b[j + run]:
                run += 1
            out += [(i, j, run)] if run else []
            i, j, step = i + run, j + run, None
            for total in range(1, 2 * ch.SKIP + 1):
                for da in range(max(0, total - ch.SKIP), min(ch.SKIP, total) + 1):
                    p, q = i + da, j + total - da
                    if p + ch.AGAIN <= len(a) and q + ch.AGAIN <= len(b) and list(a[p:p + ch.AGAIN]) == list(b[q:q + ch.AGAIN]):
                        cost = (max(da, total - da), abs(2 * da - total))
                        step = (cost, p, q) if step is None or cost < step[0] else step
                if step is not None and total >= 2 * step[0][0]:
                    break
            if step is None:
                break
            i, j = step[1:]
        return out

    rng = np.random.default_rng(5)
    for n in [*range(12), *range(20, 220)]:
        a = rng.integers(0, 3 if n % 2 else 50, n).astype(np.uint32)
        b = np.delete(a, rng.integers(0, max(n, 1), n // 12)) if n else a
        b = np.where(rng.random(len(b)) < 0.05, 99, b).astype(np.uint32)
        assert ch._beyond(a, b) == plain(a, b)
        assert ch._beyond(a[::-1], b[::-1]) == plain(a[::-1], b[::-1])
    words = np.arange(20, dtype=np.uint32)
    assert ch._next_words(words, 3) == [words[k:k + ch.AGAIN].tobytes() for k in range(3, 3 + ch.SKIP + 1)]
    assert len(ch._next_words(words, 15)) == 2 and ch._next_words(words, 20) == []
