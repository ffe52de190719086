"""Groups, links and corpus counts against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyspine.llm import alignment

ODD = ["▁ x", "a" * 3000, " " * 300 + "x", "\x00a", "﻿b", "é中文😀 <s> </s> <unk> <0x41> <|endoftext|>", "   ", "\n\n \n", "x", " ",
       "", None, "the the the cat", "the the the cat", "don't I'll RE 12345", "ﬁ ² é"]


def paths():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    """Both libraries as they are, with the bytes of each id."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    a.encode_special_tokens = True
    letters = {chr(k): k for k in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in letters.values())}

    def bytes_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    return lambda t: a.encode(" " + t, add_special_tokens=False).ids, bytes_a, lambda t: b.encode(t), bytes_b


def plain(texts, tokenizers):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), byte by byte."""
    encode_a, bytes_a, encode_b, bytes_b = tokenizers
    rows, links = [], []
    for t in texts:
        a, b = (encode_a(t), encode_b(t)) if t else ([], [])
        ba, bb = [bytes_a(i) for i in a], [bytes_b(i) for i in b]
        if not t or b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups = []
        for low, high in zip([0, *common], common):
            groups.append(",".join(str(i) for i, e in zip(a, ends_a) if low < e <= high) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if low < e <= high))
        spans_b = list(zip([0, *ends_b], ends_b))
        links.append([(i, j) for i, (s, e) in zip(a, zip([0, *ends_a], ends_a)) for j, (u, v) in zip(b, spans_b) if s < v and u < e])
        rows.append((len(a), len(b), len(common), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for x in links for p in x)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    return [(r[0], r[1], r[2], len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), r[3]) for r, x in zip(rows, links)]


@pytest.mark.parametrize("block_links", [1, 300, 10 ** 7])
def test_like_the_plain_version(spark, documents, tokenizers, block_links):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(40).collect()
    texts = ODD + [r["text"] for r in some]
    got = alignment.align(documents(list(enumerate(texts))), *paths(), block_links).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got}
    for k, want in enumerate(plain(texts, tokenizers)):
        assert by_id[k] == want, texts[k]


def test_repeated_rows_null_ids_and_an_empty_table(spark, documents):
    rows = alignment.align(documents([(1, "a cat"), (1, "a cat"), (None, "a dog"), (2, None)]), *paths()).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "None"]
    assert len({r for r in rows}) == 3
    assert alignment.align(documents([]), *paths()).collect() == []


rising = st.lists(st.integers(1, 60), min_size=1, max_size=30, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(rising, rising), min_size=1, max_size=4))
def test_shared_cuts_are_the_common_ends(pairs):
    a, b, first_a, first_b, at = [], [], [0], [0], 0
    for x, y in pairs:
        end = max(x[-1], y[-1])
        x, y = sorted({*x, end}), sorted({*y, end})
        a += [at + v for v in x]
        b += [at + v for v in y]
        at += end
        first_a.append(len(a))
        first_b.append(len(b))
    got_a, got_b = alignment.shared_cuts(np.array(a), np.array(b), np.array(first_a), np.array(first_b))
    assert [a[k] for k in got_a] == sorted(set(a) & set(b)) == [b[k] for k in got_b]


def test_ranks_stand_for_merges(tokenizers):
    """The proof holds for the vocabulary, and both libraries agree on texts."""
    assert alignment.merges_by_rank(paths()[0])
    fast, slow = alignment.ByteLevel(paths()[0], True), alignment.ByteLevel(paths()[0], False)
    texts = [" " + (t or "") for t in ODD]
    assert fast.encode(texts) == slow.encode(texts) and fast.lossless and not slow.lossless
    import public_tokenizers
    assert not alignment.merges_by_rank(public_tokenizers.path("word_bpe_49k.json"))
