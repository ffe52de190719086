"""Counts equal the library's on whole tables and odd texts."""

import random

import pytest

from skyspine.llm import token_counts

ODD = ["it's 'S I'LL !'s ''s \x0b\x1c\x85\xa0 x　y É́ é İstanbul ΣΑΣ ﬁ 😀 中文 ١٢ ²x <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> \x00 \x7f ªº µ × ÷ a×b ŸÿSTRASSE ẞß",
       "don''t'll're", "x​y", "̀a 'ſ", "Å Å K", "", " ", "\n\n", "a" * 5000, "'" * 3000 + "s", "é" * 100 + "'s", None, "same", "same"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    return path, lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = token_counts.query(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        n = library[1](t)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 2048)


def test_odd_texts(spark, documents, library):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.query(documents(list(enumerate(ODD)))).collect()}
    assert got == {k: library[1](t) for k, t in enumerate(ODD)}
    rows = token_counts.query(documents([(None, "x y"), (1, "x"), (1, "x")])).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in rows) == [(False, 1), (False, 1), (True, 2)]
    assert token_counts.query(documents([])).collect() == []


def test_random_texts(library):
    path, count = library
    counter = token_counts.Counter(path, token_counts.whole_tokens(path), True)
    signs = ["'", "s", "t", "re", "l", "S", "é", "É", " ", "\n", "9", "!", "<|", "endoftext|>", "中", "́", "ß", "\xa0", "\x1c", "~", "the", "cat"]
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 12)))
        assert counter.count(text) == count(text), text


def test_proven_strings_and_other_vocabularies(documents, library, monkeypatch):
    import public_tokenizers
    path, count = library
    whole = token_counts.whole_tokens(path)
    assert len(whole) > 30_000 and {"the", "9", "'s", "é"} <= whole
    assert all(count(s) == 1 for s in random.Random(2).sample(sorted(whole), 500))
    other = public_tokenizers.path("byte_bpe_50k.json")  # another rule for pre-tokens: the library counts whole texts
    assert not token_counts.supported(other)
    assert [r["n_tokens"] for r in token_counts.token_counts(documents([(1, "a b  c")]), other).collect()] == [4]
    monkeypatch.setattr(token_counts, "KEPT", 3)
    counter = token_counts.Counter(path, whole, True)
    words = "qqxz zzqx wwqk vvqk jjqk"
    assert counter.count(words) == counter.count(words) == count(words)
