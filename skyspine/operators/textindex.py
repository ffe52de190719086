"""Word index, and boolean, phrase and exclusion search: from postings, from a stored index, or by scanning texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.stem import english_stem, may_have_stem
from skyspine.functions.text import tokens
from skyspine.session import scratch

INDEX_BUCKETS = 256
#: Folders of the word and stem tables, which are as small as a vocabulary.
WORD_BUCKETS = 16
#: Frequent words are cut to the documents of the rare ones where they stand in more than so many times as many.
CUT_RATIO = 2


@dataclass(frozen=True)
class Clause:
    """Terms that must all occur and terms that must not; a term of several words is a phrase."""
    all: tuple[str, ...] = ()
    none: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    """A document fits when any clause fits."""
    any_of: tuple[Clause, ...] = field(default_factory=tuple)


def build_text_index(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """One row per word occurrence: (token, key, pos). A narrow step; nothing is gathered per word."""
    return docs.select(key, F.posexplode(tokens(text)).alias("pos", "token")).select("token", key, "pos")


def _bucket(token: Column, buckets: int = INDEX_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_text_index(postings: DataFrame, path: str) -> None:
    """Store an index by word hash, sorted by word inside each file; a frequent word spans several files."""
    (postings.withColumn("bucket", _bucket(F.col("token")))
     .hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "token", "pos")
     .write.mode("overwrite").partitionBy("bucket").parquet(path))


def read_text_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class WordIndex:
    """A stored index: all postings, the documents of each word, and the words of each stem; all cut into folders by hash."""
    postings: DataFrame
    words: DataFrame
    stems: DataFrame


def word_table(postings: DataFrame, key: str) -> DataFrame:
    """(token, docs, uses) of stored postings.

    They are dealt out by word and document first: a task's share of a scan holds far more of such pairs than it should group at once.
    """
    per_doc = postings.select("token", key).repartition("token", key).groupBy("token", key).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("uses"))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again, by which the planner knows their size before it joins them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_index(postings: DataFrame, key: str, path: str) -> WordIndex:
    """Store postings with their word table (token, docs, uses) and stem table (stem, token, docs)."""
    spark = postings.sparkSession
    write_text_index(postings, f"{path}/postings")
    words = word_table(read_text_index(spark, f"{path}/postings"), key)

    def write(rows: DataFrame, by: str, name: str) -> None:
        (rows.withColumn("bucket", _bucket(F.col(by), WORD_BUCKETS)).repartition(F.col("bucket"))
         .sortWithinPartitions("bucket", by).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}"))

    write(words, "token", "words")
    # From the stored words, so that a stem is formed once per word.
    write(spark.read.parquet(f"{path}/words").select(english_stem(F.col("token")).alias("stem"), "token", "docs"), "stem", "stems")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> WordIndex:
    def read(name: str, fields: str) -> DataFrame:
        return spark.read.schema(f"{fields}, bucket INT").parquet(f"{path}/{name}")

    return WordIndex(read_text_index(spark, f"{path}/postings"), read("words", "token STRING, docs LONG, uses LONG"),
                     read("stems", "stem STRING, token STRING, docs LONG"))


def _of_words(table: DataFrame, by: str, wanted: list[str]) -> DataFrame:
    """Rows of a word or stem table; constant folders, so that the scan opens no other."""
    return table.where(F.col(by).isin(wanted) & F.col("bucket").isin(*[_bucket(F.lit(w), WORD_BUCKETS) for w in wanted]))


def _words(term: str, stop_words: frozenset[str]) -> list[tuple[int, str]]:
    """Words of a term with their offsets; stop words leave a gap."""
    found = regex.findall(r"[\p{L}\p{N}]+", term.lower())
    kept = [(i, w) for i, w in enumerate(found) if w not in stop_words]
    return [(i - kept[0][0], w) for i, w in kept]


def vocabulary(postings: DataFrame) -> DataFrame:
    """The distinct words of an index with their stems and number of uses: (token, uses, stem).

    The stem hangs on the number of uses, so that a filter on it is not pushed below the aggregation and
    evaluated for every occurrence.
    """
    words = postings.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return words.withColumn("stem", F.when(F.col("uses") > 0, english_stem(F.col("token"))))


def _query_stems(spark: SparkSession, words: list[str]) -> dict[str, str]:
    rows = spark.createDataFrame([(w,) for w in words], "token STRING").select("token", english_stem(F.col("token")).alias("stem"))
    return {r["token"]: r["stem"] for r in rows.collect()}


def _clauses(query: Query, stop: frozenset[str]) -> tuple[dict[str, list[tuple[int, str]]], list[Clause]]:
    """The words of each term, and the clauses; terms of stop words only and clauses left empty are dropped."""
    terms = {t: _words(t, stop) for c in query.any_of for t in (*c.all, *c.none)}
    terms = {t: w for t, w in terms.items() if w}
    clauses = [Clause(tuple(t for t in c.all if t in terms), tuple(t for t in c.none if t in terms)) for c in query.any_of]
    return terms, [c for c in clauses if c.all or c.none]


def _fits(clauses: list[Clause], has: Callable[[str], Column]) -> Column:
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [*[has(t) for t in c.all], *[~has(t) for t in c.none]]) for c in clauses])


def _occurrences(postings: DataFrame, key: str, terms: dict[str, list[tuple[int, str]]], number: dict[str, int],
                 stems: DataFrame | None, stop: frozenset[str]) -> DataFrame:
    """(key, term): the documents in which each term occurs, by its number.

    Only postings of the terms' words are read. They are counted per document, term and start position: a phrase occurs
    where all its words agree on the start. ``stems`` holds the (stem, token) rows that the words, then stems, stand for.
    """
    wanted: dict[str, list[tuple[int, int, int]]] = {}
    for term, words in terms.items():
        for offset, word in words:
            wanted.setdefault(word, []).append((number[term], offset, len(words)))
    uses = F.create_map(*[x for word, use in wanted.items() for x in (
        F.lit(word),
        F.array(*[F.struct(F.lit(t).alias("term"), F.lit(o).alias("offset"), F.lit(n).alias("words"))
                  for t, o, n in use]))])

    stored = "bucket" in postings.columns
    if stems is not None:
        # The words of a stem are few; joined on the bucket too, they cut a stored index to their folders.
        forms = stems.where(F.col("stem").isin(list(wanted)) & ~F.col("token").isin(list(stop)))
        on = ["bucket", "token"] if stored else ["token"]
        forms = forms.withColumn("bucket", _bucket(F.col("token"))) if stored else forms
        hits = postings.join(forms.select(*on, F.col("stem").alias("word")), on)
    else:
        hits = postings.where(F.col("token").isin(list(wanted))).withColumn("word", F.col("token"))
        if stored:
            # Constant expressions: the scan of a stored index is cut to the words' folders.
            hits = hits.where(F.col("bucket").isin(*[_bucket(F.lit(w)) for w in wanted]))
    hits = hits.select(key, "pos", F.explode(uses[F.col("word")]).alias("use"))
    start = F.when(F.col("use.words") == 1, F.lit(0)).otherwise(F.col("pos") - F.col("use.offset"))
    found = (hits.groupBy(key, F.col("use.term").alias("term"), F.col("use.words").alias("words"),
                          start.alias("start"))
             .agg(F.count(F.lit(1)).alias("n")).where("n >= words"))
    return found.select(key, "term")


def _fitting(found: DataFrame, key: str, clauses: list[Clause], number: dict[str, int], docs: DataFrame | None) -> DataFrame:
    per_doc = found.groupBy(key).agg(*[F.bool_or(F.col("term") == i).alias(f"has_{i}") for i in number.values()])
    if any(not c.all for c in clauses):
        if docs is None:
            raise ValueError("a clause with exclusions only needs the documents")
        per_doc = docs.select(key).join(per_doc, key, "left")
    return per_doc.where(_fits(clauses, lambda t: F.coalesce(F.col(f"has_{number[t]}"), F.lit(False)))).select(key)


def _stemmed(spark: SparkSession, terms: dict[str, list[tuple[int, str]]]) -> dict[str, list[tuple[int, str]]]:
    stem_of = _query_stems(spark, sorted({w for words in terms.values() for _, w in words}))
    return {t: [(o, stem_of[w]) for o, w in words] for t, words in terms.items()}


def text_search(postings: DataFrame, query: Query, key: str, docs: DataFrame | None = None,
                stop_words: list[str] | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Keys of the documents that fit the query, from postings alone; ``indexed_search`` orders the work by a stored word table.

    ``docs`` is needed when a clause has exclusions only. With ``stems`` (see ``vocabulary``) a word stands for all words of its stem.
    """
    stop = frozenset(V.STOP_WORDS if stop_words is None else stop_words)
    terms, clauses = _clauses(query, stop)
    if not clauses:
        return postings.select(key).limit(0)
    if stems is not None:
        terms = _stemmed(postings.sparkSession, terms)
        stems = stems.where(may_have_stem(F.col("token"), sorted({w for words in terms.values() for _, w in words})))
    number = {t: i for i, t in enumerate(terms)}
    return _fitting(_occurrences(postings, key, terms, number, stems, stop), key, clauses, number, docs)


def indexed_search(index: WordIndex, query: Query, key: str, docs: DataFrame | None = None, stop_words: list[str] | None = None,
                   stemmed: bool = False) -> DataFrame:
    """Keys of the documents that fit the query, from a stored index, rarest words first.

    The word table says in how many documents the query's words stand, so a clause with an unknown word is dropped unread.
    The rarest term of every clause gives the candidates; postings of all other words are cut to them by a semi join
    before anything is grouped. Stop words, stems and exclusions are those of ``text_search``.
    """
    postings = index.postings
    spark = postings.sparkSession
    stop = frozenset(V.STOP_WORDS if stop_words is None else stop_words)
    terms, clauses = _clauses(query, stop)
    if not clauses:
        return postings.select(key).limit(0)
    terms = _stemmed(spark, terms) if stemmed else terms
    wanted = sorted({w for words in terms.values() for _, w in words})
    table, by = (index.stems, "stem") if stemmed else (index.words, "token")
    forms = _of_words(table, by, wanted)
    if stemmed:
        forms = kept(forms.where(~F.col("token").isin(list(stop))), "forms")
    sizes = forms.groupBy(by).agg(F.sum("docs").alias("docs"), F.collect_set(_bucket(F.col("token"))).alias("buckets")).collect()
    held = {r[by]: r["docs"] for r in sizes}
    # Constant folders here too: what the planner pushes below the join with the words reads no other.
    postings = postings.where(F.col("bucket").isin(sorted({b for r in sizes for b in r["buckets"]}))) if stemmed else postings
    weight = {t: min(held.get(w, 0) for _, w in words) for t, words in terms.items()}
    clauses = [c for c in clauses if all(weight[t] for t in c.all)]
    if not clauses:
        return postings.select(key).limit(0)
    terms = {t: terms[t] for c in clauses for t in (*c.all, *c.none)}
    number = {t: i for i, t in enumerate(terms)}
    stems = forms if stemmed else None

    lead = {min(c.all, key=lambda t: (weight[t], number[t])) for c in clauses if c.all}
    first, rest = ({t: w for t, w in terms.items() if (t in lead) == leads} for leads in (True, False))

    def documents(some: dict[str, list[tuple[int, str]]]) -> int:
        return sum(held.get(w, 0) for w in {w for words in some.values() for _, w in words})

    if not rest or any(not c.all for c in clauses) or documents(rest) <= CUT_RATIO * documents(first):
        found = _occurrences(postings, key, terms, number, stems, stop)
    else:
        # Kept, so that few candidates are known to be few and the frequent words' postings do not move to meet them.
        led = kept(_occurrences(postings, key, first, number, stems, stop), "led")
        others = postings.join(led.select(key).distinct(), key, "left_semi")
        found = led.unionByName(_occurrences(others, key, rest, number, stems, stop))
    return _fitting(found, key, clauses, number, docs)


def scan_search(docs: DataFrame, text: Column, query: Query, stop_words: list[str] | None = None, stemmed: bool = False) -> DataFrame:
    """Rows of ``docs`` whose text fits the query, without an index: a filter on each text's own words, no exchange."""
    stop = frozenset(V.STOP_WORDS if stop_words is None else stop_words)
    terms, clauses = _clauses(query, stop)
    if not clauses:
        return docs.limit(0)
    words = tokens(F.coalesce(text, F.lit("")))
    if stemmed:
        terms = _stemmed(docs.sparkSession, terms)
        wanted = sorted({w for found in terms.values() for _, w in found})
        near = lambda w: may_have_stem(w, wanted)
        words = F.transform(words, lambda w: F.when(~near(w), w).when(w.isin(list(stop)), F.lit("")).otherwise(english_stem(w)))

    def fits(own: Column) -> Column:
        def has(term: str) -> Column:
            (_, first), *more = terms[term]
            if not more:
                return F.array_contains(own, F.lit(first))
            at = lambda w, i: reduce(lambda a, b: a & b, [w == first, *[F.coalesce(F.get(own, i + o) == x, F.lit(False)) for o, x in more]])
            return F.array_contains(F.transform(own, at), F.lit(True))
        return _fits(clauses, has)

    return docs.where(F.exists(F.array(words), fits))  # bound once, however many terms look at the words
