import re
from collections import Counter

from skyspine.llm import rule_ledger as rl


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines),
            len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text)))


TEXTS = [None, "", " \n \t\x0b", "one", "a b c a b c", "a b\na b\n\na b \n", "é ü 漢字 #*| x", "A B C " * 20_000, "x\n" * 60, "Word list | here " * 30,
         "SHOUT " * 30 + "calm " * 29, "the quick brown fox jumps over it " + " ".join(f"w{i}" for i in range(60)), "aaa " * 3, "a b c d a b c"]


def test_measurements_equal_plain_python(documents):
    rows = list(enumerate(TEXTS)) + [(3, "one"), (None, "a b c a b c")]
    got = sorted((tuple(r) for r in rl.ledger(documents(rows)).drop("failed").collect()), key=repr)
    assert got == sorted(((i, *measured(t)) for i, t in rows), key=repr)


def test_policies_are_masks_over_the_ledger(documents):
    book = rl.ledger(documents(list(enumerate(TEXTS)))).cache()
    rows = book.collect()
    for version, rules in rl.POLICIES.items():
        kept = {r["doc_id"]: r["kept"] for r in rl.apply_policy(book, version).collect()}
        for r in rows:
            failed = {n for n in rl.BIT if r["failed"] >> rl.BIT[n] & 1}
            assert kept[r["doc_id"]] == (not failed & set(rules))
        table = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rl.ablation(book, version).collect()}
        for rule in rules:
            hit = [r for r in rows if r["failed"] >> rl.BIT[rule] & 1]
            alone = [r for r in hit if not any(r["failed"] >> rl.BIT[n] & 1 for n in rules if n != rule)]
            assert table[rule] == (len(hit), len(alone))


def test_base_and_empty_table(documents):
    got = {r["doc_id"]: r for r in rl.query(documents(list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        n, _, _, _, repeat, *_ = measured(t)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert got[11]["kept"]
    assert rl.query(documents([])).collect() == []
