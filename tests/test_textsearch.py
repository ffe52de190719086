"""The three ways to search agree, and a stored index reads the rarest words first."""

import random

import pytest
from pyspark.sql import functions as F

from skyspine.operators.mail import mail_list
from skyspine.operators.textindex import (Clause, Query, build_text_index, indexed_search, open_index, scan_search, store_index,
                                           text_search, vocabulary, word_table)

WORDS = ["alpha", "beta", "gamma", "delta", "flights", "flight", "flying", "flown", "the", "of", "Nice", "licensed", "license"]
QUERIES = [
    Query((Clause(("alpha",)),)), Query((Clause(("rare", "alpha")),)), Query((Clause(("alpha beta", "rare")), Clause(("gamma",), ("alpha",)))),
    Query((Clause(("alpha the beta",), ("gamma delta",)),)), Query((Clause((), ("alpha",)),)), Query((Clause(("the of",)),)),
    Query((Clause(("unknown", "alpha")), Clause(("rare",)))), Query((Clause(("unknown",)),)), Query(()), Query((Clause(("flight licensed",)),)),
    Query((Clause(("rare rare",)),)), Query((Clause(("rare",), ("alpha", "beta")), Clause((), ("flying", "nice")))), Query((Clause(("rare", "rare alpha")),)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 25)) + (["rare"] * rng.randint(1, 2) + ["alpha"] if k % 40 == 0 else [])))
            for k in range(400)]
    return spark.createDataFrame([*rows, (400, None), (401, ""), (402, "—")], "id INT, text STRING").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, docs):
    import tempfile
    return store_index(build_text_index(docs, "id", F.col("text")), "id", tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/index")


def ids(df):
    got = [r.id for r in df.select("id").collect()]
    assert len(got) == len(set(got))
    return sorted(got)


@pytest.mark.parametrize("stemmed", [False, True])
def test_all_ways_agree(docs, index, stemmed):
    postings = build_text_index(docs, "id", F.col("text"))
    stems = vocabulary(postings) if stemmed else None
    found = 0
    for q in QUERIES:
        want = ids(text_search(postings, q, "id", docs=docs, stems=stems))
        found += bool(want)
        assert ids(indexed_search(index, q, "id", docs=docs, stemmed=stemmed)) == want, q
        assert ids(scan_search(docs, F.col("text"), q, stemmed=stemmed)) == want, q
    assert found >= 9


def test_word_table(spark, docs, index):
    want = {}
    for r in docs.collect():
        for w in set((r.text or "").lower().split()) - {"—"}:
            want[w] = want.get(w, 0) + 1
    assert {r["token"]: r["docs"] for r in index.words.collect()} == want
    assert {(r["stem"], r["token"]) for r in index.stems.collect()} >= {("flight", "flights"), ("licens", "license"), ("fli", "flying")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("stemmed", [False, True])
def test_frequent_words_are_cut_to_the_rare_words_documents(index, stemmed):
    p = plan(indexed_search(index, Query((Clause(("alpha", "rare")),)), "id", stemmed=stemmed))
    assert p.count("LeftSemi") == 1
    # The semi join stands below the counting of the frequent word's postings, in the plan of the union's second side.
    tail = p[p.index("Union"):] if "Union" in p else p
    assert tail.rindex("HashAggregate", 0, tail.index("LeftSemi")) > 0
    assert "LeftSemi" not in plan(indexed_search(index, Query((Clause(("alpha", "beta")),)), "id", stemmed=stemmed))


def test_only_the_folders_of_the_words_are_read(spark, index):
    found = indexed_search(index, Query((Clause(("alpha",)),)), "id")
    assert "bucket" in plan(found) and "PartitionFilters: [isnotnull(bucket" in plan(found)
    wanted = index.words.where("token = 'alpha'").select("bucket").distinct().count()
    assert wanted == 1


def test_scan_has_no_exchange_and_splits_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = plan(scan_search(docs, F.col("text"), Query((Clause(("alpha", "beta gamma"), ("delta",)),))))
    assert "Exchange" not in p and p.split("FileScan")[0].count("regexp_extract_all") == 1


def test_open_again(spark, docs, folder):
    store_index(build_text_index(docs, "id", F.col("text")), "id", folder + "/i")
    assert ids(indexed_search(open_index(spark, folder + "/i"), Query((Clause(("rare",)),)), "id")) == list(range(0, 400, 40))


def test_words_and_documents_are_dealt_out_before_they_are_grouped(index):
    below = plan(word_table(index.postings, "id")).split("FileScan")[0]
    first = below.rindex("HashAggregate")
    assert "Exchange hashpartitioning(token" in below[first:]


def test_few_candidates_move_no_postings(spark, index):
    """Candidates and found messages have a known size before they are joined, so neither postings nor messages are shuffled to meet them."""
    p = plan(indexed_search(index, Query((Clause(("alpha", "rare")),)), "id", stemmed=True))
    assert "SortMergeJoin" not in p and p.count("LeftSemi, BuildRight") == 1
    emails = spark.range(400).selectExpr("cast(id as int) id", "'m' mailbox", "'a' from_addr", "'n' from_name", "'s' subject", "'t' snippet",
                                         "'b' body", "timestamp '2024-01-01' internal_ts")
    shown = mail_list(emails, Query((Clause(("alpha", "rare")),)), index=index)
    assert ids(shown) == list(range(0, 400, 40)) and "Exchange hashpartitioning" not in plan(shown)
