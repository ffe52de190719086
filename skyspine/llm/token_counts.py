"""Token counts by whole-token shortcuts.

Offline, on the driver, every string of the vocabulary is encoded alone. Those that come back as one token are proven whole: a
pre-token that equals one counts as 1 without further work, since tokens are merged within a pre-token only. The proven
strings, at most as many as the vocabulary has, go to the tasks. A task cuts texts into pre-tokens, counts the proven ones
directly and has the library merge only the rest, each different string once as long as it is remembered.

Pre-tokens are cut here by the vocabulary's own pattern where text is ASCII or Latin letters. A word (between white
space, which no pre-token crosses) with other signs is left to the library, and so is a text that holds a special
token's string.

Odd rows: a null or empty text has no bytes and no tokens; repeated rows and null ids are rows like others; texts of any
length are counted whole; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.llm import common

LIMIT = 2048
#: Strings that are not whole whose counts a worker remembers; beyond that it starts anew.
KEPT = 500_000
#: Letters that keep to themselves in lower case and under composition, written as a range of the pattern.
LETTERS = "a-zß-öø-ÿ"
SPACES = "\t\n\x0b\x0c\r "
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{SPACES}{LETTERS}0-9]+")
#: Beyond ASCII and those letters, with their capitals; control signs of ASCII that not all readers take alike count too.
ODD = re.compile("[^\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
WORD = re.compile(f"[^{SPACES}]+")

_SCHEMA = common.arrow_schema(doc_id=pa.int64(), n_bytes=pa.int64(), n_tokens=pa.int64())


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def supported(path: str) -> bool:
    """Whether the vocabulary's rules are those that ``PRE_TOKEN`` states for the signs it is used on."""
    import json

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    steps = [s["type"] for s in (rules["normalizer"] or {}).get("normalizers", [])]
    cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    pattern = cuts[0].get("pattern", {}).get("Regex")
    return (steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"] and rules["post_processor"] is None)


def whole_tokens(path: str) -> frozenset[str]:
    """Strings of the vocabulary that encode alone as one token and are one pre-token."""
    tokenizer = _tokenizer(path)
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    letters = common.byte_letters()
    raw = (bytes(letters[c] for c in s.removesuffix(suffix)) for s in tokenizer.get_vocab(with_added_tokens=False)
           if s.endswith(suffix) and s not in added)
    strings = sorted(s for s in {b.decode(errors="ignore") for b in raw} if not ODD.search(s) and s.lower() == s and PRE_TOKEN.findall(s) == [s])
    coded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, coded) if len(e.ids) == 1)


class Counter(dict):
    """Tokens of pre-tokens and odd words: 1 for whole ones; the library merges the rest and its counts are kept."""

    def __init__(self, path: str, whole: frozenset[str], by_pattern: bool):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.by_pattern, self.tokenizer = whole, by_pattern, _tokenizer(path)
        self.merge = self.tokenizer.model.tokenize  # of a pre-token, in the letters that stand for its bytes
        self.letters = {b: c for c, b in common.byte_letters().items() if ord(c) != b}
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def __missing__(self, word: str) -> int:
        n = self.merged(word) if ODD.search(word) else len(self.merge(word.encode().decode("latin-1").translate(self.letters)))
        if len(self) > len(self.whole) + KEPT:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[word] = n
        return n

    def merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not self.by_pattern or self.special.search(text):
            return self.merged(text)
        n_of = self.__getitem__
        if not ODD.search(text):
            return sum(map(n_of, PRE_TOKEN.findall(text.lower())))
        total = 0
        for word in WORD.findall(text):
            total += n_of(word) if ODD.search(word) else sum(map(n_of, PRE_TOKEN.findall(word.lower())))
        return total


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of (doc_id, text); ``path`` is a file of the tokenizers library."""
    common.prepare(docs.sparkSession)
    by_pattern = supported(path)
    whole = whole_tokens(path) if by_pattern else frozenset()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path, whole, by_pattern)
        count = _counters[path].count
        sizes, tokens = [], []
        for _, texts in common.text_slices(batch.column(1)):
            raw, cut = texts.data.tobytes(), texts.starts.tolist()
            for x, y in zip(cut, cut[1:]):
                sizes.append(y - x)
                tokens.append(count(raw[x:y].decode()) if y > x else 0)
        yield common.record(_SCHEMA, batch.column(0), sizes, tokens)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        common.batches(run), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
