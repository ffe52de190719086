import random
import re
from collections import defaultdict

import numpy as np
import pytest

from skyspine.llm import trie_join as tj


def grams(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute(rows, percent=90, size=3):
    sets = [grams(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(least[root(i)])) for i, (d, _) in enumerate(rows) if d is not None))


def got(df):
    return sorted(tuple(r) for r in df.where("doc_id IS NOT NULL").collect())


def near_copies(seed, n=250):
    """Chains and clusters of edited texts, exact copies, boilerplate in most texts, and very short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = [rng.choice(words) for _ in range(40)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90, 200]))]
        if rng.random() < 0.5:
            base += shared
        for _ in range(rng.choice([1, 1, 2, 6])):
            texts.append(" ".join(base))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(base))
                base[at:at + rng.randrange(2)] = [rng.choice(words) for _ in range(rng.randrange(2))] or [base[at]]
    order = rng.sample(range(1000), n)
    return list(zip(order, texts[:n]))


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_all_pairs(documents, seed):
    rows = near_copies(seed)
    assert got(tj.join(documents(rows))) == brute(rows)


def test_lists_buckets_and_blocks_only_move_work(documents, monkeypatch):
    rows = near_copies(5)
    want = brute(rows)
    monkeypatch.setattr(tj, "LOCAL_COUNT", 2)
    assert got(tj.join(documents(rows))) == want  # nearly all n-grams listed
    monkeypatch.setattr(tj, "LISTED", 0)
    assert got(tj.join(documents(rows))) == want  # none
    for limit, held in ((1, 20_000), (3, 5)):  # few votes, many ties; buckets too large to hold
        monkeypatch.setattr(tj, "BUCKET", limit)
        monkeypatch.setattr(tj, "HELD", held)
        assert got(tj.join(documents(rows))) == want
    monkeypatch.setattr(tj, "LISTED", 1 << 18)
    monkeypatch.setattr(tj, "BLOCK_TOKENS", 600)
    monkeypatch.setattr(tj, "BROADCAST_ROWS", 0)
    assert got(tj.join(documents(rows))) == want  # groups in many blocks, texts joined by shuffle


def test_other_thresholds(documents):
    rows = near_copies(6, 120)
    assert got(tj.join(documents(rows), percent=60)) == brute(rows, 60)


def test_packed_sets_come_back_in_their_order():
    rng = np.random.default_rng(3)
    tokens = np.sort(rng.integers(0, 2 ** 63, 500).astype(np.uint64))
    counts = rng.integers(1, 90, 500)
    place = np.empty(500, dtype=np.int64)
    place[np.lexsort((tokens, -counts))] = np.arange(500)
    for some in (0, 1, 40, 500):
        known, other = rng.choice(tokens, some, replace=False), rng.integers(0, 2 ** 63, 30).astype(np.uint64)
        got = tj.unpacked(tj.packed(np.unique(np.concatenate([known, other])), (tokens, counts), place))
        assert got[:some].tolist() == sorted(place[np.searchsorted(tokens, known)].tolist()) and sorted(got[some:].tolist()) == sorted(other.tolist())
    none = np.zeros(0, dtype=np.uint64)
    assert tj.unpacked(tj.packed(tokens, (none, none.astype(np.int64)), none.astype(np.int64))).tolist() == tokens.tolist()


def test_tree_walk_finds_all_and_leaves_subtrees(monkeypatch):
    monkeypatch.setattr(tj, "RUN", 4)
    rng = random.Random(1)
    for _ in range(40):
        base = rng.sample(range(200), 40)
        sets = []
        for k in range(25):
            s = sorted(set(base[:rng.randrange(20, 41)]) - set(rng.sample(base, rng.randrange(4))) | set(rng.sample(range(200), rng.randrange(3))))
            sets.append(np.array(s, dtype=np.uint64))
        sets = list({s.tobytes(): s for s in sets}.values())
        links = list(tj.linked(list(range(len(sets))), sets, [0] * len(sets), 80))
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            assert root(a) != root(b)  # a forest: no link twice
            parent[root(a)] = root(b)
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 80 * len(a | b):
                    assert root(i) == root(j)
        for a, b in links:
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert 100 * len(x & y) >= 80 * len(x | y)


def test_a_walk_shares_paths():
    """Sets with one beginning are tested on it once, and left together."""
    sets = [np.array([*range(100), 200 + k], dtype=np.int32) for k in range(30)]
    top = tj.tree(sets)
    assert len(top.below) == 30 and top.depth == 100
    looked = []
    marked = np.zeros(400, dtype=bool)
    marked[300:400] = True
    assert list(tj.walk(top, 100, marked, 90, lambda x: looked.append(x) or False)) == [] and len(looked) == 1


def test_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one\t"), (6, "one two"), (7, "two one"), (8, "a b c"), (8, "a b c"), (9, "A B\nC"), (10, "x " * 30_000),
            (11, "x " * 40_000), (12, "end " + "y " * 20 + "z " * 30_000)]
    assert got(tj.join(documents(rows))) == brute(rows)
    some = {r["n_shingles"]: r["component_id"] for r in tj.join(documents([(None, "p q r s"), (30, "p q r s"), (None, "alone here now ok too"), (None, None)])).collect()}
    assert some == {2: 30, 3: None, 0: None}
    assert got(tj.join(documents([]))) == []


def test_one_row_of_each_group_stays(documents):
    rows = near_copies(8, 120) + [(2000, None), (2001, ""), (3000, "rep rep2 rep3 rep4"), (3000, "rep rep2 rep3 rep4"), (None, "some text without id"), (None, "some text without id")]
    docs = documents(rows)
    out = tj.one_per_group(docs)
    assert out.columns == docs.columns
    want = sorted([d for d, n, c in set(brute(rows)) if d == c], key=repr)
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted((d for d in kept if d is not None), key=repr) == want and kept.count(None) == 2


def test_the_list_of_frequent_ngrams_is_bounded(spark, monkeypatch):
    """More n-grams of the highest level than the list holds: as many as fit, by count and then by n-gram."""
    monkeypatch.setattr(tj, "LISTED", 5)
    rows = [(t, 200_000 + t % 2) for t in range(-10, 10)] + [(99, 70_000), (98, 3)]
    tokens, counts = tj.frequent_tokens(spark.createDataFrame(rows, "token LONG, n LONG"))
    assert sorted(tokens.view("int64").tolist()) == [-9, -7, -5, -3, -1] and set(counts.tolist()) == {200_001}
    monkeypatch.setattr(tj, "LISTED", 21)
    tokens, counts = tj.frequent_tokens(spark.createDataFrame(rows, "token LONG, n LONG"))
    assert len(tokens) == 21 and 70_000 in counts.tolist()
    tokens, counts = tj.frequent_tokens(spark.createDataFrame([], "token LONG, n LONG"))
    assert len(tokens) == len(counts) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_five_words_and_eighty_percent(documents, seed):
    """The setting of the pipeline's stage, on edited copies around that similarity."""
    rows = near_copies(seed)
    found = got(tj.join(documents(rows), size=5, percent=80).select("doc_id", "n_shingles", "component_id"))
    assert found == brute(rows, 80, 5)
    assert {d for d, _, c in found if d != c} > {d for d, _, c in brute(rows, 90, 5) if d != c}
