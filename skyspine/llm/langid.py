"""Language by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. A text is parsed from the left into the longest phrases that
occur in that text; the language that needs the fewest phrases, each costing log2 of the labelled text's length, wins.
Texts are reduced to small letters with single blanks between words, and parsed in windows of ``WINDOW`` symbols, all
windows and all languages of a batch in step: one table look-up moves every automaton by one symbol.

The automata come from a bounded sample: per language the ``DOCS`` labelled documents of smallest id hash (fewer
if there are more than ten languages), at most ``DOC_CHARS`` characters of each, together at most ``TRAIN_SYMBOLS`` symbols. Every text is parsed whole.

Odd rows: a null text, or one without a letter, is "und" with score 0; rows without a language teach nothing; ties go to
the language with more labelled rows, then to the smaller name; repeated rows get equal answers; with no labelled row at
all every text is "und"; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyspine.llm import common

DOCS = 400
DOC_CHARS = 2_000
TRAIN_SYMBOLS = 200_000
#: Symbols of one step of the parse; a phrase ends at a window's end.
WINDOW = 1_024
#: Letters told apart; rarer ones of the sample, and those outside it, are one symbol.
LETTERS = 120
#: Windows that run in step.
LANES = 2_048

BLANK, OTHER, PAD = 0, 1, 2
PREDICTIONS = common.arrow_schema(doc_id=pa.int64(), lang_pred=pa.string(), score=pa.float64())


class Model(NamedTuple):
    languages: list[str]
    symbols: dict[str, int]
    #: Per language the transitions (state, symbol, next state), the number of states, and the length of its text.
    automata: list[tuple[np.ndarray, int, int]]


def letters_only(text: str) -> str:
    """Small letters, with one blank for every run of other characters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> tuple[np.ndarray, int]:
    """Transitions (state, symbol, next) of the automaton that accepts the substrings; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return np.array([(s, c, t) for s, out in enumerate(step) for c, t in out.items()], dtype=np.int32).reshape(-1, 3), len(step)


def learn(texts_by_language: dict[str, list[str]], order: list[str]) -> Model:
    """The model of some labelled texts; ``order`` breaks ties."""
    per = TRAIN_SYMBOLS // max(1, len(order))
    joined = {l: (" " + " ".join(letters_only(t) for t in texts_by_language[l]) + " ")[:per] for l in order}
    counts: dict[str, int] = {}
    for t in joined.values():
        for c in t:
            counts[c] = counts.get(c, 0) + 1
    common_letters = sorted((c for c in counts if c != " "), key=lambda c: (-counts[c], c))[:LETTERS]
    symbols = {" ": BLANK} | {c: k + 3 for k, c in enumerate(common_letters)}
    automata = []
    for l in order:
        moves, states = suffix_automaton([symbols.get(c, OTHER) for c in joined[l]])
        automata.append((moves, states, len(joined[l])))
    return Model(order, symbols, automata)


class Parser:
    """The dense tables of a model. An entry holds the next row's place in the table and the phrases that end."""

    def __init__(self, model: Model):
        self.model = model
        self.width = len(model.symbols) + 2
        tables, at, self.roots = [], 0, []
        for moves, states, _ in model.automata:
            first = np.full(self.width, -1, dtype=np.int64)
            first[moves[moves[:, 0] == 0, 1]] = moves[moves[:, 0] == 0, 2]
            seen = first >= 0
            # no move: the phrase ends, and the symbol opens the next one or is a phrase by itself
            again = ((at + np.where(seen, first, 0)) * self.width << 2) | np.where(seen, 1, 2)
            table = np.tile(again, (states, 1))
            table[:, PAD] = (at * self.width << 2) | 1
            table[moves[:, 0], moves[:, 1]] = (at + moves[:, 2].astype(np.int64)) * self.width << 2
            table[0, ~seen] = (at * self.width << 2) | 1
            table[0, PAD] = at * self.width << 2
            tables.append(table)
            self.roots.append(at * self.width)
            at += states
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, dtype=np.int64)
        self.table = self.table.astype(np.int32) if self.table.max(initial=0) < 1 << 31 else self.table
        self.cost = np.log2([n for _, _, n in model.automata])
        small = np.arange(0x110000)
        self.symbol = np.full(len(small), BLANK, dtype=np.uint8)
        for c in small:
            ch = chr(c)
            if ch.isalpha():
                self.symbol[c] = model.symbols.get(ch if c < 128 and ch.islower() else ch.lower()[:1], OTHER)

    def symbols_of(self, text: str) -> np.ndarray:
        """A text's symbols: one blank for every run of other characters, also around it; empty without a letter."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = self.symbol[points]
        letter = s != BLANK
        if not letter.any():
            return s[:0]
        s = s[letter | np.concatenate([[False], letter[:-1]])]
        return np.concatenate([[BLANK] if s[0] != BLANK else [], s, [BLANK] if s[-1] != BLANK else []]).astype(np.uint8)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        total = np.zeros((len(texts), len(self.roots)), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // WINDOW) for t in texts])
        sizes = np.array([min(WINDOW, len(t) - a) for t in texts for a in range(0, len(t), WINDOW)], dtype=np.int64)
        starts = np.array([a for t in texts for a in range(0, len(t), WINDOW)], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), LANES):
            some = order[at:at + LANES]
            longest = int(sizes[some[0]])
            lanes = np.full((longest + 1, len(some)), PAD, dtype=np.uint8)
            for j, k in enumerate(some):
                lanes[:sizes[k], j] = texts[owner[k]][starts[k]:starts[k] + sizes[k]]
            running = np.searchsorted(-sizes[some], -np.arange(longest + 1), side="right")  # lanes at least so long
            state = np.repeat(np.array(self.roots, dtype=np.int64)[:, None], len(some), axis=1)
            ended = np.zeros(state.shape, dtype=np.int64)
            for t in range(longest + 1):
                n = int(running[t])
                move = self.table.take(state[:, :n] + lanes[t, :n])
                ended[:, :n] += move & 3
                state[:, :n] = move >> 2
            np.add.at(total, owner[some], ended.T)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        coded = [self.symbols_of(t or "") for t in texts]
        bits = self.phrases(coded) * self.cost
        out = []
        for s, b in zip(coded, bits):
            if not len(s) or not len(b):
                out.append(("und", 0.0))
                continue
            best = int(b.argmin())
            out.append((self.model.languages[best], float(1 / np.exp2(-(b - b[best]) / 4).sum())))
        return out


_parsers: dict[int, Parser] = {}


def sample(docs: DataFrame, folds: int = 5, held: int = 0) -> Model:
    """The model of the labelled rows whose id is not in the held-out fold."""
    labelled = docs.where((common.id_bucket(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select(F.col("lang").cast("string"), F.substring("text", 1, DOC_CHARS).alias("text"), F.xxhash64("doc_id").alias("h"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    chosen = (labelled.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
              .where(F.col("r") <= max(8, min(DOCS, 10 * DOCS // max(1, len(counts))))).select("lang", "r", "text").collect())
    by: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], r["r"])):
        by.setdefault(r["lang"], []).append(r["text"])
    return learn(by, sorted(by, key=lambda l: (-counts[l], l)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parsers.get(id(shared.value))
        if parser is None:
            _parsers.clear()
            parser = _parsers[id(shared.value)] = Parser(shared.value)
        for batch in it:
            for at, texts in common.text_slices(batch.column(1), 4_000_000):
                found = parser.predict(batch.column(1).slice(at, len(texts)).to_pylist())
                yield common.record(PREDICTIONS, batch.column(0).slice(at, len(texts)), [l for l, _ in found], [s for _, s in found])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    found = identify(docs, sample(docs))
    return found.select("doc_id", (common.id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
