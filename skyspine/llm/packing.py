"""Hierarchical multi-length packing.

A document's tokens fill whole longest windows first. The rest goes to the smallest context-size tier that holds it. The
tiers are packed from the longest down: a window opens with its longest piece, its gap takes the longest pieces that fit,
from any shorter tier, and the last gap a cut piece. So every window is full. What a task has left at its end is cut
into windows whose sizes are powers of two, which need no padding either. Windows of one size are dealt into step groups
of equal token counts.

Each task packs its own documents as they stream by, with no shuffle; it holds some ``BUFFER_TOKENS`` tokens and one
document. Sequence and group numbers carry the number of the task.

Odd rows: a null or empty text is the end token alone; repeated rows are packed each by itself; texts of any length are
packed whole; a null id stays null; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import bisect
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from skyspine.llm import common

WINDOWS = (512, 1024, 2048, 4096)
STEP_TOKENS = 65_536
BUFFER_TOKENS = 1_000_000
#: Words whose tokens a worker keeps; beyond that it starts anew.
KEPT_WORDS = 500_000

PIECES = common.arrow_schema(doc_id=pa.int64(), start=pa.int64(), length=pa.int64(), doc_tokens=pa.int64(), sequence_id=pa.int64(),
                             offset=pa.int64(), window=pa.int64(), step_group=pa.int64(), ids=pa.binary())
_DDL = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window long, step_group long, "
        "ids binary")


#: Cut between a letter and an ASCII sign: no token of the vocabulary's pattern spans it. The rest of a word stays whole.
PART = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]++(?=[\x00-\x60\x7b-\x7f]|$)|[^ \n]+")
#: Words that the vocabulary's rules leave as they are: small letters of one code point each.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_letters(word: str) -> str:
    """The letters that stand for a word's UTF-8 bytes: printable Latin-1 itself, other bytes as 256 and on in order."""
    return word.encode().decode("latin-1").translate(_UNPRINTED)


_UNPRINTED = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class WordTokens:
    """Tokens of texts as unsigned 32-bit ids, little-endian as the machine.

    The vocabulary's rules drop white space and capitals, and never cross white space, so words are encoded on their own
    and remembered. The first ``KEPT_WORDS`` stay; after many misses the memory starts anew.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole, self.encoder = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Texts that hold the string of a special token go through ``whole``; small letters alone must not make one of others.
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values() if t.special]
        self.encoder.encode_special_tokens = True
        self.model = self.encoder.model
        self.end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        self.known: dict[str, bytes] = {}
        self.missed = 0

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Of UTF-8 texts; only A-Z is put in lower case here, the rest is left to the vocabulary's rules."""
        named = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if named:
            own = self.whole.encode_batch_fast([texts[k].decode() for k in named], add_special_tokens=False)
            ids = {k: array("I", e.ids).tobytes() + self.end for k, e in zip(named, own)}
            rest = iter(self.encode([t for k, t in enumerate(texts) if k not in ids]))
            return [ids[k] if k in ids else next(rest) for k in range(len(texts))]
        parts = [PART.findall(t.lower().decode()) for t in texts]
        new = list(set().union(*parts) - self.known.keys())
        self.missed += len(new)
        if self.missed > 8 * KEPT_WORDS:
            self.known, self.missed = {}, 0
            new = list(set().union(*parts))
        some, rest, tokenize = {}, [], self.model.tokenize
        for word in new:
            if PLAIN.fullmatch(word):
                some[word] = array("I", [t.id for t in tokenize(word if word.isascii() else _byte_letters(word))]).tobytes()
            else:
                rest.append(word)
        for at in range(0, len(rest), 4096):
            words = rest[at:at + 4096]
            for word, e in zip(words, self.encoder.encode_batch_fast(words, add_special_tokens=False)):
                some[word] = array("I", e.ids).tobytes()
        if len(self.known) + len(some) <= KEPT_WORDS:
            self.known |= some
            get = self.known.__getitem__
        else:
            get = {**{w: self.known[w] for w in set().union(*parts) if w in self.known}, **some}.__getitem__
        return [b"".join(map(get, p)) + self.end for p in parts]


_encoders: dict[tuple, WordTokens] = {}


def encoder(path: str, end_id: int | None) -> WordTokens:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordTokens(path, end_id)
    return _encoders[path, end_id]


class Packer:
    """Packs a stream of documents; ``done`` fills with (window size, [(doc, start, length), ...])."""

    def __init__(self, windows: tuple[int, ...] = WINDOWS):
        self.windows = tuple(sorted(windows))
        self.rest: list[tuple[int, int, int]] = []  # (length, doc, start), by rising length
        self.waiting = 0
        self.done: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc: int, n: int) -> None:
        longest, start = self.windows[-1], 0
        while n - start >= longest:
            self.done.append((longest, [(doc, start, longest)]))
            start += longest
        if n > start:
            self._put(doc, start, n - start)

    def _put(self, doc: int, start: int, length: int) -> None:
        bisect.insort(self.rest, (length, doc, start))
        self.waiting += length

    def _take(self, at: int, most: int) -> tuple[int, int, int]:
        """A piece of at most ``most`` tokens from the waiting rest ``at``; what is cut off waits on."""
        length, doc, start = self.rest.pop(at)
        self.waiting -= length
        if length > most:
            self._put(doc, start + most, length - most)
            length = most
        return doc, start, length

    def pack(self, last: bool) -> None:
        """Packs what waits, down to what might not fill a window; with ``last`` everything."""
        while self.rest and self.waiting >= (1 if last else 2 * self.windows[-1]):
            longest = self.rest[-1][0]
            window = next(w for w in self.windows if w >= longest)
            if self.waiting < window:
                if not last:
                    return
                self._finish()
                return
            pieces, gap = [], window
            while gap:
                fits = bisect.bisect_right(self.rest, (gap, np.inf, 0)) - 1
                piece = self._take(fits if fits >= 0 else len(self.rest) - 1, gap)
                pieces.append(piece)
                gap -= piece[2]
            self.done.append((window, pieces))

    def _finish(self) -> None:
        """The last tokens, in windows of their binary digits."""
        while self.waiting:
            window = 1 << (self.waiting.bit_length() - 1)
            pieces, gap = [], window
            while gap:
                piece = self._take(len(self.rest) - 1, gap)
                pieces.append(piece)
                gap -= piece[2]
            self.done.append((window, pieces))


def pack_rows(task: int, docs: Iterable[tuple[int | None, bytes]], windows=WINDOWS, step_tokens: int = STEP_TOKENS,
              buffer_tokens: int = BUFFER_TOKENS) -> Iterator[tuple]:
    """The pieces of one task's documents, as in ``PIECES``; a sequence's pieces stand together."""
    packer, held, sequence = Packer(windows), {}, 0
    filled: dict[int, int] = {}

    def out() -> Iterator[tuple]:
        nonlocal sequence
        for window, pieces in packer.done:
            filled[window] = filled.get(window, 0) + 1
            group = (filled[window] - 1) * window // step_tokens
            number = (task << 40) | sequence
            sequence += 1
            offset = 0
            for doc, start, length in pieces:
                doc_id, ids, left = held[doc]
                yield (doc_id, start, length, len(ids) // 4, number, offset, window,
                       (task << 40) | (window.bit_length() << 32) | group, ids[4 * start:4 * (start + length)])
                offset += length
                if left == length:
                    del held[doc]
                else:
                    held[doc] = (doc_id, ids, left - length)
        packer.done.clear()

    for k, (doc_id, ids) in enumerate(docs):
        if ids:
            held[k] = (doc_id, ids, len(ids) // 4)
            packer.add(k, len(ids) // 4)
        if packer.waiting >= buffer_tokens:
            packer.pack(last=False)
        if packer.done:
            yield from out()
    packer.pack(last=True)
    yield from out()


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 2, windows: tuple[int, ...] = WINDOWS,
         step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces of all documents (doc_id, text): see ``PIECES``; ``tokenizer`` is the path of a vocabulary file."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, end_id)

        def coded() -> Iterator[tuple[int | None, bytes]]:
            for batch in it:
                for at, texts in common.text_slices(batch.column(1)):
                    raw, cut = texts.data.tobytes(), texts.starts.tolist()
                    yield from zip(batch.column(0).slice(at, len(texts)).to_pylist(), words.encode([raw[a:b] for a, b in zip(cut, cut[1:])]))

        rows, size = [], 0
        for row in pack_rows(TaskContext.get().partitionId(), coded(), windows, step_tokens):
            rows.append(row)
            size += len(row[-1])
            if len(rows) >= 2048 or size >= 1 << 21:
                yield common.record(PIECES, *zip(*rows))
                rows, size = [], 0
        if rows:
            yield common.record(PIECES, *zip(*rows))

    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _DDL)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs, public_vocabulary()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                                  "sequence_id", "offset", "window", "step_group")
