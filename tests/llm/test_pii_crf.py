import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from skyspine.llm import common
from skyspine.llm import pii_crf as crf


def plain_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@pytest.mark.parametrize("signs", ["a@.b-", "01.2 -", "+1 ().-5", "a1@.+ -9", "@a.é١ 4"])
def test_base_spans_equal_the_patterns(signs):
    rng = random.Random(len(signs))
    for _ in range(6000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        assert crf.base_spans(t) == plain_base(t), t


def test_base_spans_of_likely_texts():
    t = "mail é a.b@c.d.e, 4000001234567899 or 4000 0012 3456 7899; 1.2.3.4.5 256.1.1.1 010.0.0.1 +1 (555) 010-2234. +44 1"
    assert crf.base_spans(t) == plain_base(t) and {k for k, _, _ in crf.base_spans(t)} == set(crf.KINDS)


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "@" * 300_000, "1 " * 150_000])
def test_patterns_take_linear_time(text):
    crf.base_spans(text)


def test_decoding_equals_trying_all_labels():
    rng = np.random.default_rng(0)
    for trial in range(12):
        n = 4
        scores = rng.normal(0, 2, (12, 9))
        moves = rng.normal(0, 1, (9, 9))
        gain = (moves[:, :, None] + moves[None] - moves[:, :1, None] - moves[None, :1, :]).max(axis=(0, 2))
        scores[:6, 0] += 1.2 * gain.max() * (trial % 3)
        model = crf.Field(scores, moves, (scores[:, :1] - scores[:, 1:] > gain[None, 1:]).all(axis=1))
        codes = rng.integers(0, 12, n)
        got = crf.decode(codes, np.array([0, n]), model)

        def total(y):
            path = [0, *y, 0]
            return scores[codes, np.array(y)].sum() + sum(moves[a, b] for a, b in zip(path, path[1:]))

        best = max(total(y) for y in itertools.product(range(9), repeat=n))
        assert total(got) == pytest.approx(best)


def spans(texts):
    out = []
    for _, t in common.text_slices(pa.array(texts, type=pa.string())):
        out += list(crf.all_spans(t, crf.field()))
    return out


def test_the_field_has_learned_its_table():
    right = wrong = 0
    for line in crf.LABELLED.strip().split("\n"):
        plain = re.sub(r"\[\w+ ([^\]]*)\]", r"\1", line)
        gold = {(k, s) for k, s in re.findall(r"\[(\w+) ([^\]]*)\]", line) if crf.plausible(k, s)}
        got = {(k, plain[a:b]) for k, a, b in spans([plain])[0][1]}
        right, wrong = right + len(gold & got), wrong + len(gold ^ got)
    assert wrong == 0 and right > 30


def test_it_adds_what_the_patterns_miss_and_leaves_prose_alone():
    (base, every), = spans(["é ring (030) 555-0199 1 or 555-010-9988, +1 (826) 555-4081 192.0.2.7 in 1998"])
    text = "é ring (030) 555-0199 1 or 555-010-9988, +1 (826) 555-4081 192.0.2.7 in 1998"
    assert set(base) <= set(every) and ("phone", "555-010-9988") in {(k, text[a:b]) for k, a, b in every}
    assert ("phone", "+1 (826) 555-4081") in {(k, text[a:b]) for k, a, b in every}
    clean = ["In 1998 some 12,500 people of 40 lands came, see page 301.", "order 123456789 of 2024-05-17, key 8f3a9c", "a | b ### 1 2 3 4 5 6 7 8 9 10 11 12", "12:30 3.14 2.3.1"]
    assert all(s == [] for _, s in spans(clean))


def test_query_and_masking_over_odd_rows(documents):
    rows = [(1, None), (2, ""), (3, "to a@b.cc, é"), (3, "to a@b.cc, é"), (None, "+1 (555) 010-2234"), (4, "w " * 60_000 + "4000001234567899"), (5, "clean text")]
    got = {r["doc_id"]: r for r in crf.query(documents(rows)).collect()}
    assert len(crf.query(documents(rows)).collect()) == 7
    assert got[3]["spans"] == "email:3:9" and got[3]["n_email"] == 1 and got[3]["base_sha256"] == hashlib.sha256(b"email:3:9").hexdigest()
    assert got[1]["spans"] == got[2]["spans"] == "" and got[4]["spans"] == "card:120000:120016" and got[None]["n_phone"] == 1
    docs = documents(rows)
    out = crf.masked(docs)
    assert out.columns == docs.columns
    texts = sorted(((r["doc_id"] or 0, r["text"] and r["text"][-20:]) for r in out.collect()), key=repr)
    assert texts == sorted([(0, "<phone>"), (1, None), (2, ""), (3, "to <email>, é"), (3, "to <email>, é"), (4, ("w " * 20 + "<card>")[-20:]), (5, "clean text")], key=repr)
    assert crf.query(documents([])).collect() == [] and crf.masked(documents([])).collect() == []


def test_overlapping_spans_are_masked_together():
    assert crf.replaced("abcdefgh", [("ip", 1, 4), ("card", 3, 6), ("phone", 7, 8)]) == "a<ip>g<phone>"
    assert crf.replaced("abcdefgh", [("ip", 1, 6), ("card", 2, 3)]) == "a<ip>gh"
