"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both token sequences of a text cover the same bytes. An interval of a text is divided at the common token end nearest to
its middle: ends of the first tokenizer, from the middle outward, are looked up among the ends of the second by bisection.
Both halves are divided again; an interval without a common end inside is a leaf, a group of tokens that belong
together. All intervals of a slice of texts are divided in step, level by level. A first token and a second token of a
leaf are linked where their bytes overlap.

How often two ids are linked in the whole corpus is counted in two steps: each task sums up its links by pair, and the
sums are added by pair. For the way back each task has written its texts in blocks, with its links as numbers into the
block's own list of pairs. The list, not the links, is joined with the counts; then texts and list of a block meet. No
pair has more rows than there are blocks, and a block holds at most ``BLOCK_LINKS`` links and texts, or one text.

Odd rows: null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and an
empty digest. Repeated rows count each; texts of any length are used whole; ids may be null or repeated and stay as
they are; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from skyspine.llm import common

#: Links and texts of a block: its texts and its list of pairs meet in one task.
BLOCK_LINKS = 2_000_000
#: Bytes of text that are tokenized and divided together.
SLICE = 1_000_000

_ROWS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                   ("groups_sha256", pa.string()), ("links", pa.binary()), ("pair", pa.int64()), ("place", pa.int32()), ("n", pa.int64())])
_ROWS_DDL = ("block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pair long, place int, n long")
_SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


# --- tokenizers ----------------------------------------------------------------------------------------------------


def merges_by_rank(path: str) -> bool:
    """Whether merging the pair with the smallest id gives what the vocabulary's list of merges gives.

    So it is if ids follow the list, after those of the single bytes, and each token's own letters are merged to that
    token: then, when a token's turn comes, its letters stand divided in one way wherever they are still divided.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    split, model = rules["pre_tokenizer"], rules["model"]
    if rules["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or model["type"] != "BPE":
        return False
    vocabulary = model["vocab"]
    for k, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocabulary.get(left + right) != 256 + k:
            return False
    encode = Tokenizer.from_file(path).model.tokenize
    return all(len(encode(token)) == 1 for token, i in vocabulary.items() if i < 256 + len(model["merges"]))


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; its special strings are ordinary text.

    With ``by_rank`` (see ``merges_by_rank``) texts are encoded by tiktoken from the same vocabulary, which is faster.
    """

    def __init__(self, path: str, by_rank: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        letters = common.byte_letters()
        tokenizer = Tokenizer.from_file(path)
        special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        if by_rank:
            import public_tokenizers
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
            whole = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: list(map(whole.encode_ordinary, texts))
            self.lossless = {bytes([b]) for b in range(256)} <= ranks.keys()  # no rule of the vocabulary changes a text
        else:
            tokenizer.encode_special_tokens = True
            self.lossless = False
            self.encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece vocabulary; texts come with a leading space, which the library adds by itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
        self.encode = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)


_loaded: dict[tuple, object] = {}


def _once(kind: Callable, *args):
    if (kind, *args) not in _loaded:
        _loaded[kind, *args] = kind(*args)
    return _loaded[kind, *args]


# --- division ------------------------------------------------------------------------------------------------------


def shared_cuts(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the rising token ends ``a`` and ``b`` of the ends that both have, divided from the middles.

    Text i has the ends ``a[a_first[i]:a_first[i + 1]]`` and ``b[b_first[i]:b_first[i + 1]]``, at least one each; the last are equal.
    """
    low, high, b_low, b_high = a_first[:-1], a_first[1:] - 1, b_first[:-1], b_first[1:] - 1  # ends inside an interval: a[low:high]
    cuts, places = [high], [b_high]
    while True:
        inner = (high > low) & (b_high > b_low)
        low, high, b_low, b_high = low[inner], high[inner], b_low[inner], b_high[inner]
        if not len(low):
            return np.sort(np.concatenate(cuts)), np.sort(np.concatenate(places))
        middle = (low + high) // 2
        found, place = np.full(len(low), -1), np.zeros(len(low), dtype=np.int64)
        seeking, near, far = np.arange(len(low)), 0, 1
        while len(seeking):
            step = np.arange(near, far)
            at = middle[seeking, None] + np.stack([step, -1 - step], axis=1).ravel()  # 0, -1, 1, -2, ...
            inside = (at >= low[seeking, None]) & (at < high[seeking, None])
            ends = a[np.where(inside, at, 0)]
            there = np.minimum(np.searchsorted(b, ends), len(b) - 1)
            hit = inside & (b[there] == ends)
            got, first = hit.any(axis=1), hit.argmax(axis=1)
            row = np.flatnonzero(got)
            found[seeking[row]], place[seeking[row]] = at[row, first[row]], there[row, first[row]]
            seeking = seeking[~got & inside.any(axis=1)]
            near, far = far, 2 * far
        split = found >= 0
        found, place = found[split], place[split]
        cuts.append(found)
        places.append(place)
        low, high = np.concatenate([low[split], found + 1]), np.concatenate([found, high[split]])
        b_low, b_high = np.concatenate([b_low[split], place + 1]), np.concatenate([place, b_high[split]])


class Aligned:
    """Groups and links of some texts whose tokens ``a`` and ``b`` cover the same bytes; texts without tokens are left out."""

    def __init__(self, a_ids: np.ndarray, a_ends: np.ndarray, a_first: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, b_first: np.ndarray):
        self.last_a, self.last_b = shared_cuts(a_ends, b_ends, a_first, b_first)  # the last tokens of each group
        self.n_groups = np.diff(np.searchsorted(self.last_a, a_first))
        high = np.searchsorted(b_ends, a_ends)
        low = np.concatenate([[0], high[:-1] + (b_ends[high[:-1]] == a_ends[:-1])])
        width = high - low + 1  # second tokens over each first token
        link_first = np.concatenate([[0], np.cumsum(width)])
        self.link_a = np.repeat(a_ids, width)
        self.link_b = b_ids[np.arange(link_first[-1]) - np.repeat(link_first[:-1] - low, width)]
        self.links_first = link_first[a_first]
        self.a_ids, self.b_ids, self.a_first, self.b_first = a_ids, b_ids, a_first, b_first

    def written(self, signs: np.ndarray, size_a: int, size_b: int) -> list[str]:
        """Each text's groups, as ``a1,a2|b1;a3|b2``; ``signs`` are those of ``_signs``."""
        na, nb = len(self.a_ids), len(self.b_ids)
        end_a, end_b = np.zeros(na, dtype=bool), np.zeros(nb, dtype=bool)
        end_a[self.last_a], end_b[self.last_b] = True, True
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        out = np.empty(na + nb, dtype=np.int64)
        before_b = np.concatenate([[0], self.last_b + 1])
        out[np.arange(na) + before_b[group_a]] = self.a_ids + size_a * end_a
        out[np.arange(nb) + self.last_a[group_b] + 1] = 2 * size_a + self.b_ids + size_b * end_b
        words, cuts = signs[out].tolist(), (self.a_first + self.b_first).tolist()
        return ["".join(words[x:y])[:-1] for x, y in zip(cuts, cuts[1:])]


def _signs(size_a: int, size_b: int) -> np.ndarray:
    """First ids followed by a comma, then by a bar, second ids followed by a comma, then by a semicolon."""
    return np.array([f"{i}{s}" for n, marks in ((size_a, ",|"), (size_b, ",;")) for s in marks for i in range(n)], dtype=object)


def _coded(texts: list[bytes], encode: Callable, parts: list[bytes] | None) -> list[list[int]]:
    """Ids of each text, none if they do not give back its bytes; ``parts`` None if they always do."""
    got = encode([t.decode() for t in texts])
    if parts is None:
        return got
    join, of = b"".join, parts.__getitem__
    return [ids if join(map(of, ids)) == t else [] for t, ids in zip(texts, got)]


def _laid(ids: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, where each token ends if the texts stood one after another, and the first token of each text."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=first[-1])
    ends = np.cumsum(sizes[flat])
    return flat, ends.astype(np.int32) if first[-1] and ends[-1] < 1 << 31 else ends, first


class Block:
    """Rows of consecutive texts with their links, as places in the block's list of pairs, which grows as pairs come."""

    def __init__(self, number: int):
        self.number, self.docs, self.links = number, [], 0
        self.known, self.place, self.n = (np.zeros(0, dtype=np.int64) for _ in range(3))  # pairs by size, their places, links by place

    def placed(self, codes: np.ndarray) -> np.ndarray:
        """The places of pairs in the list, where they are counted; new ones are put at its end."""
        at = np.minimum(np.searchsorted(self.known, codes), max(0, len(self.known) - 1))
        new = np.unique(codes[self.known[at] != codes]) if len(self.known) else np.unique(codes)
        if len(new):
            both = np.concatenate([self.known, new])
            order = np.argsort(both, kind="stable")
            self.place = np.concatenate([self.place, len(self.known) + np.arange(len(new))])[order]
            self.known = both[order]
            at = np.searchsorted(self.known, codes)
        places = self.place[at]
        self.n = np.concatenate([self.n, np.zeros(len(self.known) - len(self.n), dtype=np.int64)]) + np.bincount(places, minlength=len(self.known))
        return places

    def add(self, doc: tuple, links: np.ndarray) -> None:
        """A text's links take two bytes each as long as its places fit them, else four."""
        self.docs.append((*doc, links.astype("<u2" if links.max(initial=0) < 1 << 16 else "<u4").tobytes()))
        self.links += len(links) + 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The texts, then the list with the links of each pair."""
        for at in range(0, len(self.docs), 1024):
            some = self.docs[at:at + 1024]
            yield common.record(_ROWS, [self.number] * len(some), *zip(*some), *(pa.nulls(len(some), f.type) for f in list(_ROWS)[7:]))
        for at in range(0, len(self.known), 1 << 16):
            pairs, place = self.known[at:at + (1 << 16)], self.place[at:at + (1 << 16)]
            yield common.record(_ROWS, np.full(len(pairs), self.number), *(pa.nulls(len(pairs), f.type) for f in list(_ROWS)[1:7]),
                                pairs, place.astype(np.int32), self.n[place])


def align_texts(texts: Iterable[tuple[list[int | None], list[bytes]]], a: ByteLevel, b: Pieces, first_block: int, block_links: int) -> Iterator[Block]:
    """Blocks of the texts, given as batches of ids and UTF-8 texts."""
    sizes_a, sizes_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (a, b))
    signs = _signs(len(sizes_a), len(sizes_b))
    block, none = Block(first_block), ((0, 0, 0, ""), np.zeros(0, dtype=np.int64))
    for ids, raw in texts:
        spaced = [b" " + t for t in raw]
        some = [k for k, t in enumerate(raw) if t]
        got_a = dict(zip(some, _coded([spaced[k] for k in some], a.encode, None if a.lossless else a.bytes)))
        got_b = dict(zip(some, _coded([spaced[k] for k in some], b.encode, b.bytes)))
        whole = [k for k in some if got_a[k] and got_b[k]]
        row = {}
        if whole:
            found = Aligned(*_laid([got_a[k] for k in whole], sizes_a), *_laid([got_b[k] for k in whole], sizes_b))
            codes, cuts = found.link_a * len(sizes_b) + found.link_b, found.links_first.tolist()
            for j, (k, text) in enumerate(zip(whole, found.written(signs, len(sizes_a), len(sizes_b)))):
                row[k] = (len(got_a[k]), len(got_b[k]), int(found.n_groups[j]), hashlib.sha256(text.encode()).hexdigest()), codes[cuts[j]:cuts[j + 1]]
        at = 0
        while at < len(ids):  # as many texts as the block takes, at least one in an empty block
            to, size = at, block.links
            while to < len(ids) and (size == 0 or size + len(row.get(to, none)[1]) < block_links):
                size += len(row.get(to, none)[1]) + 1
                to += 1
            places = block.placed(np.concatenate([row.get(k, none)[1] for k in range(at, to)] or [none[1]]))
            cut = 0
            for k in range(at, to):
                numbers, links = row.get(k, none)
                block.add((ids[k], *numbers), places[cut:cut + len(links)])
                cut += len(links)
            if to < len(ids):
                yield block
                block = Block(block.number + 1)
            at = to
    if block.docs:
        yield block


# --- the corpus ----------------------------------------------------------------------------------------------------


def align(docs: DataFrame, a_path: str, b_path: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per text of (doc_id, text), see ``_SCORED``; ``a_path`` a byte-level vocabulary, ``b_path`` a sentencepiece one."""
    common.prepare(docs.sparkSession)
    by_rank = merges_by_rank(a_path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _once(ByteLevel, a_path, by_rank), _once(Pieces, b_path)

        def texts() -> Iterator[tuple[list[int | None], list[bytes]]]:
            for batch in it:
                for at, part in common.text_slices(batch.column(1), SLICE):
                    raw, cut = part.data.tobytes(), part.starts.tolist()
                    yield batch.column(0).slice(at, len(part)).to_pylist(), [raw[x:y] for x, y in zip(cut, cut[1:])]

        for block in align_texts(texts(), a, b, TaskContext.get().partitionId() << 32, block_links):
            yield from block.rows()

    rows = common.stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ROWS_DDL), "aligned")
    return with_counts(rows, b_path)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): links of each pair in the corpus, and whether no pair of its second id has more."""
    counts = rows.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = common.stored(counts, "pairs")
    highest = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(highest, F.col("pair") % size_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, b_path: str) -> DataFrame:
    counts = pair_counts(rows, len(_once(Pieces, b_path).bytes))
    listed = rows.where("pair IS NOT NULL").select("block", "pair", "place").join(counts, "pair").select(
        F.col("block").alias("of"), "place", "count", "best")
    docs = rows.where("pair IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256")

    def score(docs: pa.Table, listed: pa.Table) -> pa.Table:
        place = np.asarray(listed["place"].combine_chunks())
        count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        count[place], best[place] = np.asarray(listed["count"].combine_chunks()), np.asarray(listed["best"].combine_chunks().cast(pa.int8()))
        numbers = []
        total = [a + b - g for a, b, g in zip(*(docs[c].to_pylist() for c in ("n_a", "n_b", "n_groups")))]  # links of each text
        for links in docs["links"]:
            size = total[len(numbers)]
            at = np.frombuffer(links.as_buffer(), dtype="<u2" if links.as_buffer().size == 2 * size else "<u4")
            numbers.append((len(at), int(best[at].sum()), int(count[at].sum())))
        out = [pa.array(c, type=pa.int64()) for c in zip(*numbers)] if numbers else [pa.array([], type=pa.int64())] * 3
        return pa.table([docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], *out, docs["groups_sha256"]],
                        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return docs.groupBy("block").cogroup(listed.groupBy("of")).applyInArrow(score, _SCORED)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
