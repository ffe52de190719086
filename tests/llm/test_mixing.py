import random
import re
from collections import defaultdict

import pytest

from skyspine.llm import mixing


def dealt(sizes, cap=3.0):
    """Targets by dealing the excess again until none is above the cap. ``sizes`` by source, in order."""
    weight = {s: float(k % 3 + 1) for k, s in enumerate(sizes)}
    total = sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in sizes}
    while any(target[s] > cap * sizes[s] + 1e-9 for s in sizes):
        over = sum(max(0, target[s] - cap * sizes[s]) for s in sizes)
        open_ = [s for s in sizes if target[s] < cap * sizes[s]]
        for s in sizes:
            if s not in open_:
                target[s] = cap * sizes[s]
        for s in open_:
            target[s] += over * weight[s] / sum(weight[o] for o in open_)
    return target


def docs_of(seed, n=600):
    rng = random.Random(seed)
    names = [None, "é", "Z", "a", "zz", "aa", "b", ""]
    return [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "en", rng.choices(names, [30, 5, 1, 20, 3, 8, 2, 1])[0]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_targets_copies_and_sums(documents, seed):
    rows = docs_of(seed)
    got = mixing.mix(documents(rows)).collect()
    by, taken, copies = defaultdict(int), defaultdict(int), defaultdict(list)
    for _, t, _, s in rows:
        by[s] += len(t.split())
    sizes = {s: by[s] for s in sorted(by, key=lambda s: (s is None, s))}
    target = dealt(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        rate = r["target"] / r["source_size"]
        assert int(rate + 1e-12) <= r["copies"] <= -(-rate // 1) + 1e-9 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        copies[r["source"]].append(r["copies"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 60  # within a longest document
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(documents(rows)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mixed_rows_keep_all_columns(documents):
    docs = documents(docs_of(7, 200))
    want = defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] = r["copies"]
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    original = {r["doc_id"]: r for r in docs.collect()}
    seen = defaultdict(int)
    for r in out.collect():
        assert r == original[r["doc_id"]]
        seen[r["doc_id"]] += 1
    assert seen == {d: c for d, c in want.items() if c}


def test_many_sources_are_joined_by_shuffle(documents, monkeypatch):
    rows = docs_of(2, 100)
    want = sorted(map(tuple, mixing.query(documents(rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.query(documents(rows)).collect())) == want


def test_odd_rows(documents):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y", "en", "empty"), (None, "x y z", "en", None), (3, "x y", "en", "empty"), (4, " \t\n", "en", "blank"),
            (5, "word " * 30_000, "en", "b")]
    got = sorted(((r["doc_id"] or 0, r["size"], r["source_size"], r["taken"]) for r in mixing.query(documents(rows)).collect()))
    assert [g[:3] for g in got] == [(0, 3, 3), (1, 0, 0), (2, 0, 0), (3, 2, 4), (3, 2, 4), (4, 0, 0), (5, 30_000, 30_000)]
    assert all(t == 0 for d, n, s, t in got if n == 0) and got[3] == got[4]
    assert mixing.query(documents([])).collect() == [] and mixing.mixed_rows(documents([])).collect() == []
    assert {r["target"] for r in mixing.query(documents([(1, None), (2, "")])).collect()} == {0.0}


def test_words_are_runs_of_other_characters(values):
    rows = [" a\tb\x0bc\x0cd\re\n ", " x", "", None, "a　b c"]
    assert values(lambda d: mixing.word_count(d["x"]), rows) == [len(re.findall(r"[^\x20\x09-\x0D]+", r or "")) for r in rows]


def test_blank_documents_follow_the_rate_of_their_source(documents):
    rows = [(i, None if i % 4 == 0 else " " if i % 4 == 1 else "a b c", "en", "ab"[i % 3 == 0]) for i in range(120)] + [(500, "", "en", "none")]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == 121
    for r in got:
        assert int(r["rate"] + 1e-12) <= r["copies"] <= -(-r["rate"] // 1) + 1e-9 and r["taken"] == r["copies"] * r["size"]
    assert {r["doc_id"]: (r["rate"], r["copies"], r["taken"]) for r in got}[500] == (1.0, 1, 0)
    kept = {r["doc_id"] for r in mixing.mixed_rows(documents(rows)).collect()}
    assert {r["doc_id"] for r in got if r["copies"]} == kept and {d % 4 for d in kept} == {0, 1, 2, 3}


def test_columns_with_names_used_inside(spark):
    names = ["seed", "rest", "_source", "_s", "w", "most", "_row", "_copy", "target", "copies", "doc_id_of_source"]
    rows = [(i, "a b", "xy"[i % 3 == 0], *[float(i)] * len(names)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, " + ", ".join(f"{n} DOUBLE" for n in names))
    plain = {(r["doc_id"], r["taken"]) for r in mixing.query(docs.select("doc_id", "text", "source")).collect()}
    assert {(r["doc_id"], r["taken"]) for r in mixing.query(docs).collect()} == plain
    got = mixing.mix(docs)
    assert {(r["seed"], r["rest"], r["_source"]) for r in got.collect()} == {(float(i),) * 3 for i in range(60)}
    assert mixing.mixed_rows(docs).columns == docs.columns
