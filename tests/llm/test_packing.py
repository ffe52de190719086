import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skyspine.llm import packing


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(packing.public_vocabulary())
    return lambda text: t.encode(text, add_special_tokens=False).ids + [2]


def test_words_by_themselves_give_the_same_ids(direct):
    words = packing.WordTokens(packing.public_vocabulary(), 2)
    rng = random.Random(5)
    signs = "aAbZéÉÈßİıΣσς'’s.,-#<|≯́ \t\n\r 　 09½²ªºテスト\x1c\x0bK…“"
    texts = ["", "It's the <|endoftext|> end, DON'T!!", "a<|startoftext|>B c", "<|ENDOFTEXT|> x", "<|endoftext|><|endoftext|>", "a" * 300] + ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for t, got in zip(texts, words.encode([t.encode() for t in texts])):
        assert np.frombuffer(got, dtype="<u4").tolist() == direct(t), t


def test_memory_of_words_is_bounded(monkeypatch, direct):
    monkeypatch.setattr(packing, "KEPT_WORDS", 20)
    words = packing.WordTokens(packing.public_vocabulary(), 2)
    for k in range(60):
        text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + j)}" for j in range(15))
        assert np.frombuffer(words.encode([text.encode()])[0], dtype="<u4").tolist() == direct(text)
        assert len(words.known) <= 20


def check(pieces, ids_of):
    """Every id in one piece, sequences gapless and full."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        docs[p["doc_id"]].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == [sum(q["length"] for q in s[:k]) for k in range(len(s))]
        size = sum(p["length"] for p in s)
        assert size == s[0]["window"] <= 4096 and size & (size - 1) == 0 and len({p["window"] for p in s}) == 1
    for doc, got in docs.items():
        whole = sorted(x for t in ids_of[doc] for x in t)
        assert sorted(x for p in got for x in np.frombuffer(p["ids"], dtype="<u4").tolist()) == whole
        if len(ids_of[doc]) == 1:
            got.sort(key=lambda p: p["start"])
            assert [p["start"] for p in got] == [sum(q["length"] for q in got[:k]) for k in range(len(got))]
            assert b"".join(bytes(p["ids"]) for p in got) == np.array(ids_of[doc][0], dtype="<u4").tobytes()
    assert set(docs) == set(ids_of)


@pytest.mark.parametrize("buffer", [1, 9000, 10 ** 6])
def test_round_trip_of_many_lengths(buffer):
    rng = random.Random(buffer)
    docs = [(k, [k] * max(1, int(rng.lognormvariate(5.5, 1.5)))) for k in range(500)] + [(1000, [1] * 30_000), (1001, [2] * 4096), (1002, [])]
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_group", "ids")
    pieces = [dict(zip(names, r)) for r in packing.pack_rows(3, ((d, np.array(t, dtype="<u4").tobytes()) for d, t in docs), buffer_tokens=buffer)]
    check(pieces, {d: [t] for d, t in docs if t})
    groups = defaultdict(int)
    for p in pieces:
        groups[p["step_group"]] += p["length"]
    assert max(groups.values()) <= packing.STEP_TOKENS
    by_window = defaultdict(list)
    for p in pieces:
        if p["window"] >= 512:
            by_window[p["window"]].append(p["step_group"])
    for window, group in by_window.items():  # all but the last group of a window size are equal
        assert all(groups[g] == packing.STEP_TOKENS for g in set(group) - {max(group)})
    cut = sum(p["start"] > 0 for p in pieces if p["doc_id"] < 1000)
    assert cut < 250 if buffer > 1 else True


def test_query_over_odd_rows(spark, documents, direct):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "d e"), (None, "x y"), (4, "long " * 30_000), (5, "Tie"), (6, "Tie")]
    got = packing.pack(documents(rows), packing.public_vocabulary()).collect()
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(direct(t or ""))
    check([r.asDict() for r in got], want)
    for r in packing.query(documents(rows)).collect():
        assert r["doc_tokens"] in [len(t) for t in want[r["doc_id"]]]
    digests = sorted(r["ids_crc32"] for r in packing.query(documents(rows[:2])).collect())
    assert digests == [zlib.crc32(np.array([2], dtype="<u4").tobytes())] * 2
    assert packing.query(documents([])).collect() == []
