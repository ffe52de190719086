"""From raw documents to packed training sequences, in five stages.

Every stage is a function of (spark, docs, sf_dir), works on all that its predecessor kept, and returns a frame with the
columns of its input, except the last, which returns packed pieces. Odd rows are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspine.llm import mixing, packing, pii_crf, toxicity, trie_join
from skyspine.llm.common import prepare, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold, learned from the labels of ``sf_dir``."""
    prepare(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by three-word sets with a Jaccard index of 0.9 or more."""
    prepare(spark)
    return trie_join.one_per_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; ``n_chars`` follows the text."""
    prepare(spark)
    out = pii_crf.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids as little-endian unsigned 32-bit numbers."""
    prepare(spark)
    return packing.pack(docs, packing.public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL states toxicity scores, field labels or token packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
