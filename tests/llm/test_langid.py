import random
import zlib

import pytest

from skyspine.llm import langid

SYLLABLES = {"aa": "ba be ka lo mi", "bb": "sch ung der ein och", "cc": "eau oi tre ça ée"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture
def model():
    rng = random.Random(0)
    return langid.learn({l: [text(rng, l, 200) for _ in range(5)] for l in SYLLABLES}, sorted(SYLLABLES))


def plain_parse(s, train):
    n = i = 0
    while i < len(s):
        k = 1
        while i + k < len(s) and s[i:i + k] in train and s[i:i + k + 1] in train:
            k += 1
        i += k
        n += 1
    return n


@pytest.mark.parametrize("window", [7, 1024])
def test_phrases_equal_a_search_for_longest_matches(monkeypatch, model, window):
    monkeypatch.setattr(langid, "WINDOW", window)
    monkeypatch.setattr(langid, "LANES", 5)
    rng = random.Random(1)
    texts = {l: " ".join(text(rng, l, 200) for _ in range(3)) for l in SYLLABLES}
    model = langid.learn({l: [t] for l, t in texts.items()}, sorted(texts))
    parser = langid.Parser(model)
    train = {l: " " + langid.letters_only(texts[l]) + " " for l in texts}
    some = [text(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 60)) for _ in range(30)] + ["x", "Éa ÇA 12 漢字 zzz", "b" * 90, "Ba-Be!"]
    got = parser.phrases([parser.symbols_of(t) for t in some])
    # letters outside the sample are one symbol, which no sample holds here
    known = set("".join(train.values()))
    for t, row in zip(some, got):
        s = " " + "".join(c if c in known else "\0" for c in langid.letters_only(t)) + " "
        for l, n in zip(model.languages, row):
            assert n == sum(plain_parse(s[a:a + window], train[l]) for a in range(0, len(s), window)), (t, l)


def test_automaton_accepts_the_substrings_only():
    rng = random.Random(2)
    for _ in range(50):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 20))]
        moves, n = langid.suffix_automaton(s)
        step = {(a, c): b for a, c, b in moves.tolist()}
        assert n <= 2 * len(s)
        held = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for _ in range(40):
            t = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
            at = 0
            for c in t:
                at = step.get((at, c), -1) if at >= 0 else -1
            assert (at >= 0) == (tuple(t) in held)


def test_held_out_accuracy_and_odd_rows(spark, documents):
    rng = random.Random(3)
    rows = [(i, text(rng, l, rng.randrange(5, 60)), l) for i in range(300) for l in [rng.choice(list(SYLLABLES))]]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 !! ..", None), (903, "sch ung " * 30_000, None), (5, rows[5][1], rows[5][2]), (None, "eau oi", None)]
    got = langid.query(documents(rows + odd)).collect()
    assert len(got) == 306 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [by[i]["lang_pred"] == l for i, _, l in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and all(held)
    assert [by[k]["lang_pred"] for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "bb", "cc"]
    assert by[900]["score"] == 0.0 and sum(r["doc_id"] == 5 for r in got) == 2
    # the language of held-out rows and the source teach nothing
    turned = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else l, "s%d" % i) for i, t, l in rows]
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.query(documents(turned)).collect()} == {
        r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.query(documents(rows)).collect()}


def test_nothing_to_learn_from(documents):
    assert {r["lang_pred"] for r in langid.query(documents([(1, "abc", None), (2, "x", None)])).collect()} == {"und"}
    assert langid.query(documents([])).collect() == []
