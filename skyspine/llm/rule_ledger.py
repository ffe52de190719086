"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text; the ledger keeps one failure bit per rule beside the measurements. A policy is a
versioned set of bits: applying it, comparing two of them, or asking what a single rule costs is bitwise arithmetic on
the ledger, without reading texts again. Odd rows:

- a null or empty text has no words and zero measurements; ratios over nothing are 0;
- rows are judged one by one, so repeated rows and repeated ids get equal rows; an empty table gives an empty ledger;
- texts of any length are measured whole; input columns other than the id and the text are not used.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyspine.llm import common

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
CAPITALS = np.zeros(256, dtype=bool)
CAPITALS[65:91] = True
LETTERS = CAPITALS.copy()
LETTERS[97:123] = True
_STARTS_POINT = (np.arange(256) & 0xC0) != 0x80
_NEWLINE = ord("\n")

MEASURES = common.arrow_schema(doc_id=pa.int64(), n_words=pa.int64(), word_chars=pa.int64(), n_symbols=pa.int64(),
                               n_dup_lines=pa.int64(), n_repeat_words=pa.int64(), n_lines=pa.int64(),
                               n_capitals=pa.int64(), n_letters=pa.int64())
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_letters long"

#: Rules in bit order: name, and when a text fails it. Integers only, so that all engines agree.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols_per_word", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "100 * n_capitals > 50 * n_letters"),
]
BIT = {name: k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules whose failure removes a text.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbols_per_word", "repeated_lines"),
    "v2": tuple(BIT),
}
CURRENT = "v2"


def measure(texts: common.Texts, window: int = 3) -> list[np.ndarray]:
    """Word count, code points in words, symbols, repeated lines, words in repeated windows, lines with a word, A-Z, A-Za-z."""
    n = len(texts)
    begins, ends, first = texts.words()
    points = np.concatenate([[0], np.cumsum(_STARTS_POINT[texts.data] & ~common.SPACE[texts.data])])

    def per_text(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(kind[texts.data])])[texts.starts])

    words = texts.hashes(begins, ends)
    line_begin, line_end, line_first = texts.runs(texts.data != _NEWLINE)
    before = np.searchsorted(begins, line_begin)
    worded = np.searchsorted(begins, line_end) > before
    line_hash = texts.hashes(line_begin, line_end)
    dup, lines, repeat = (np.zeros(n, dtype=np.int64) for _ in range(3))
    for i in range(n):
        a, b = line_first[i], line_first[i + 1]
        if b > a:
            own = line_hash[a:b][worded[a:b]]
            lines[i] = len(own)
            dup[i] = len(own) - len(np.unique(own))
        w = words[first[i]:first[i + 1]]
        if len(w) > window:
            _, which, count = np.unique(common.window_hashes(w, window), return_inverse=True, return_counts=True)
            at = np.flatnonzero(count[which] > 1)
            if len(at):
                hit = np.zeros(len(w), dtype=bool)
                for k in range(window):
                    hit[at + k] = True
                repeat[i] = hit.sum()
    return [np.diff(first), np.diff(points[texts.starts]), per_text(SYMBOLS), dup, repeat, lines,
            per_text(CAPITALS), per_text(LETTERS)]


def _measure_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at, texts in common.text_slices(batch.column(1)):
        yield common.record(MEASURES, batch.column(0).slice(at, len(texts)), *measure(texts))


def failure_bits() -> Column:
    return reduce(operator.add, [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): one row per row of ``docs``, failed being the bitmask over ``RULES``."""
    measured = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.batches(_measure_batch), _DDL)
    return measured.withColumn("failed", failure_bits())


def policy_mask(version: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[version])


def passes(version: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy_mask(version))) == 0


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    return book.withColumn("kept", passes(version))


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only): texts failing a rule of the policy, and those that would stay without it.

    One pass: equal masks are counted first, so the rest works on at most 2^rules rows.
    """
    masks = (book.select(F.col("failed").bitwiseAND(F.lit(policy_mask(version))).alias("mask"))
             .groupBy("mask").agg(F.count("*").alias("n")))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << BIT[name]).alias("bit")) for name in POLICIES[version]]))
    by = masks.select("mask", "n", rules.alias("r")).select("mask", "n", "r.rule", "r.bit")
    return by.groupBy("rule").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))


def query(docs: DataFrame) -> DataFrame:
    book = apply_policy(ledger(docs))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~passes("base")).alias("base_failed"), "kept", "failed")


SQL = rf"""
WITH parts AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
         CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Za-z]', '', 'g')) AS BIGINT) AS n_letters
  FROM documents),
windows AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM parts WHERE len(ws) >= 3),
hot AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM hot, range(3) t(k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars, n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines, n_capitals, n_letters
  FROM parts LEFT JOIN covered c USING (r)),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       (failed & {policy_mask(CURRENT)}) = 0 AS kept, failed
FROM f
"""
