"""The stages against plain versions of what they decide, each on the rows its predecessor left."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import sqlcheck
from test_packing import check
from test_pii_crf import plain_base
from test_trie_join import brute
from tokenizers import Tokenizer

import corpus_pipeline
from skyspine.llm import mixing, packing, pii_crf, toxicity
from skyspine.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "stage"))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[1:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "PII", "mixing sources to target weights", "packing"]


def test_toxic_documents_go(spark, steps):
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.query(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    before, after = by_id(steps[0]), by_id(steps[1])
    assert after == {d: r for d, r in before.items() if not verdict[d]} and 0 < sum(verdict.values()) < 0.3 * len(before)


def test_one_of_each_group_stays(steps):
    before, after = by_id(steps[1]), by_id(steps[2])
    assert after == {d: before[d] for d, _, c in brute([(d, r["text"]) for d, r in before.items()]) if d == c} and len(after) < len(before)


def test_personal_data_is_masked(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    assert set(before) == set(after)
    for d, r in before.items():
        if after[d]["text"] != r["text"]:
            assert any(f"<{k}>" in after[d]["text"] for k in pii_crf.KINDS) and after[d]["n_chars"] == len(after[d]["text"])
        else:
            assert after[d] == r and not plain_base(r["text"])
        assert not plain_base(after[d]["text"])
    assert any(plain_base(r["text"]) for r in before.values())


def test_sources_are_mixed(steps, tmp_path):
    steps[3].write.parquet(f"{tmp_path}/documents.parquet")
    con = sqlcheck.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {d: taken // size for d, size, _, _, taken in con.execute(mixing.SQL).fetchall() if taken}
    assert Counter(r["doc_id"] for r in steps[4].collect()) == want
    original = by_id(steps[3])
    assert all(r == original[r["doc_id"]] for r in steps[4].collect())


def test_tokens_are_packed(steps):
    t = Tokenizer.from_file(packing.public_vocabulary())
    t.encode_special_tokens = True
    want = defaultdict(list)
    for r in steps[4].collect():
        want[r["doc_id"]].append([*t.encode(r["text"], add_special_tokens=False).ids, 2])
    check([r.asDict() for r in steps[5].collect()], want)


def test_run_gives_the_same(spark, steps):
    def tokens(df):
        return sum(np.frombuffer(r["ids"], dtype="<u4").astype(np.int64).sum() for r in df.collect())

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == steps[-1].columns and tokens(got) == tokens(steps[-1])


def test_stages_on_empty_documents(spark, steps):
    none = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []
