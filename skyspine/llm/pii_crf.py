"""Personal data by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans. The field labels the words between blanks from features of their shape alone (counts of
digits, letters and signs), is trained on the small labelled table below, and adds spans that the patterns miss, such as
grouped telephone numbers without a plus sign. Words that touch a base span are left to it, and a span that the field adds must
also look like its kind (``plausible``).

Decoding is exact Viterbi over whole texts. A word whose "outside" score leads by more than any change of its neighbours'
transitions could make up is outside on the best path in any case; the runs of words between such words are decoded on their
own, in numpy batches.

Odd rows: a null or empty text has no spans; positions count code points, ends are exclusive; repeated rows get equal
answers; texts of any length are read whole, and every pattern takes time linear in the text; an empty table gives no
rows; other columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyspine.llm import common

KINDS = ("email", "ip", "card", "phone")

# --- base patterns ---------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails at the first digit of a run fails at its later digits too, and after a match no run goes on.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 if len(p) < 20 else not p.strip("0") for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = digits_of(s) if len(s) < 64 else ""
    return 13 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


# --- the labelled table ------------------------------------------------------------------------------------------------

#: Sentences with their personal data in [kind ...]. Written for this purpose; addresses and numbers are reserved ones.
LABELLED = """
write to [email ann.lee@mail.example.com] before noon
my address is [email j.d+news@example.org] or ask at the desk
[email info@example.net] answers all questions
send it to [email ops-team@sub.example.co.uk], thanks
contact: [email bob_77@example.com]. He will reply
reply to <[email carol@example.org]> today
[email dave@localhost] is the local account
mail [email eve%x@mailhost] for the logs
from [email a.b.c@x.example.com] to [email d.e@y.example.com] on Monday
call [phone +1 (555) 010-2234] or come by
phone [phone +44 20 7946 0018] at any time
her number is [phone +49 30 901820] I think
ring [phone (555) 010-7788] after six
the office [phone (017) 555-7713] is open
use [phone 555-010-4477] in an emergency
dial [phone 555.010.9921] for help
my cell: [phone 1-555-010-3322], home [phone (555) 010-1199]
[phone +33 1 99 00 12 34] is the line in Paris
text [phone +15550104455] please
fax [phone (030) 5550 1234] works too
reach me on [phone 0555 010 223] or [phone +1 555 010 8877]
server [ip 192.0.2.17] did not answer
ping [ip 198.51.100.4] and [ip 203.0.113.250] first
the host [ip 203.0.113.9]:8080 is down
route to [ip 192.0.2.0]/24 is gone
log in from [ip 198.51.100.77]. Then wait
paid with [card 4000001234567899] last week
card [card 4000 0012 3456 7899] was declined
his card is [card 5100-0012-3456-7890], please check
number [card 4000.0012.3456.7899] on the form
charge [card 340000123456789] now
[card 4000/0012/3456/7899] is the one on file
it was in 1998 and again in 2004
there were 12,500 units of 40 kinds
version 2.3.1 came after 2.2
the value is 3.14 or 2.718281828
order 12345678 was sent on 2024-05-17
see page 12 of 99 and line 301
from 9:30 to 17:45 every day
chapter 4, section 4.2.1, figure 17
the total is 1,234,567.89 in all
room 101 on floor 3
code 8f3a9c12 and key a1b2c3d4e5f6
part no. 7781-22 fits model 5500
id 239040950064896 belongs to nobody
number 1234567890123456 is no card
serial 555010443 was lost
the years 1914-1918 and 1939-1945
a score of 3-2 after 90 minutes
see the talk @ 5 or @home
use a @ b in matrix code
values 10 20 30 40 50 60 70
rows 100 200 300 400 and 500
distance 384,400 km in 2.5 s
the ratio is 16:9 or 4:3
what the and of to in that is was
Hello. It was late, and nobody came!
the words ### and $$$ and &&& mean nothing
A | B | C
He said (quietly) that it was over
see (12) and (13) in the list
on 17.05.2024 at 10:00
(555) people came and 010-type forms were used
lines 123-456 and 789-790
add 1 + 1 or +5 percent
temperature -12.5 to +30.2
"""


class Field(NamedTuple):
    """The trained field: scores by shape code and label, transitions, and which codes are outside in any case."""

    scores: np.ndarray
    moves: np.ndarray
    outside: np.ndarray


LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]

# Word-shape features: counts per word, each cut to a few values.
_CLASS = {name: np.zeros(256, dtype=bool) for name in ("digit", "letter", "at", "dot", "dash", "open", "close", "plus", "colon", "other")}
for _b in range(256):
    _c = chr(_b)
    _CLASS["digit" if "0" <= _c <= "9" else "letter" if _b >= 0x80 or _c.isalpha() else
           {"@": "at", ".": "dot", "-": "dash", "(": "open", ")": "close", "+": "plus", ":": "colon"}.get(_c, "other")][_b] = True
#: Per class the least counts of its values after 0.
STEPS = {"digit": (1, 2, 3, 4, 5, 7, 9, 10, 13, 16, 17, 20), "letter": (1, 3), "at": (1, 2), "dot": (1, 2, 3, 4), "dash": (1, 2, 3),
         "open": (1,), "close": (1,), "plus": (1,), "colon": (1, 2), "other": (1, 2, 3)}
_RADIX = [len(s) + 1 for s in STEPS.values()]
_CODES = int(np.prod(_RADIX))


def shape_codes(texts: common.Texts, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per word, from which all its features follow."""
    code = np.zeros(len(begins), dtype=np.int64)
    for name, radix in zip(STEPS, _RADIX):
        code *= radix
        inside = _CLASS[name][texts.data]
        if inside.any():
            count = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
            code += np.searchsorted(np.array(STEPS[name]), count[ends] - count[begins], side="right")
    return code


def _features(codes: np.ndarray) -> np.ndarray:
    """Indices of the features that hold, one per class, and one for digits with a sign, for each code."""
    values = []
    for radix in reversed(_RADIX):
        codes, v = np.divmod(codes, radix)
        values.append(v)
    values = values[::-1]
    at, out = 0, []
    for v, radix in zip(values, _RADIX):
        out.append(at + v)
        at += radix
    name = list(STEPS).index
    digits, signs = values[name("digit")], (values[name("dash")] > 0) + 2 * (values[name("dot")] > 0)
    out.append(at + digits * 8 + signs * 2 + (values[name("letter")] > 0))
    at += _RADIX[0] * 8
    out.append(at + digits * 8 + (values[name("open")] > 0) * 4 + (values[name("close")] > 0) * 2 + (values[name("plus")] > 0))
    at += _RADIX[0] * 8
    out.append(at + values[name("at")] * 10 + values[name("dot")] * 2 + (values[name("letter")] > 0))
    return np.stack(out, axis=1)


_N_FEATURES = sum(_RADIX) + 2 * _RADIX[0] * 8 + 30


def _labelled_words() -> list[tuple[np.ndarray, np.ndarray]]:
    rows = []
    for line in LABELLED.strip().split("\n"):
        plain, marks = "", []
        for part in re.split(r"(\[\w+ [^\]]*\])", line):
            m = re.fullmatch(r"\[(\w+) ([^\]]*)\]", part)
            if m:
                marks.append((m[1], len(plain), len(plain) + len(m[2])))
                part = m[2]
            plain += part
        raw = np.frombuffer(plain.encode(), dtype=np.uint8)
        texts = common.Texts(raw, np.array([0, len(raw)]))
        begins, ends, _ = texts.words()
        labels = np.zeros(len(begins), dtype=np.int64)
        for kind, a, b in marks:
            inside = np.flatnonzero((ends > a) & (begins < b))
            labels[inside] = LABELS.index(f"I-{kind}")
            labels[inside[0]] -= 1
        rows.append((_features(shape_codes(texts, begins, ends)), labels))
    return rows


def train(rounds: int = 400, rate: float = 0.1, decay: float = 0.0003, most_move: float = 1.5) -> Field:
    """Penalised likelihood of the labelled table by gradient steps, all sentences in step; about two seconds.

    Transitions are held within ``most_move``, so that shapes decide and most words are outside in any context.
    """
    rows, n = _labelled_words(), len(LABELS)
    longest = max(len(y) for _, y in rows)
    size = np.array([len(y) for _, y in rows])
    feats = np.zeros((len(rows), longest, rows[0][0].shape[1]), dtype=np.int64)
    gold = np.zeros((len(rows), longest), dtype=np.int64)
    for i, (f, y) in enumerate(rows):
        feats[i, :len(y)], gold[i, :len(y)] = f, y
    there = np.arange(longest) < size[:, None]
    w, t = np.zeros((_N_FEATURES, n)), np.zeros((n, n))
    first, second = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        e = w[feats].sum(axis=2) * there[:, :, None]
        ahead, behind = np.zeros_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + t[0]
        for k in range(1, longest):
            go = log_sum(ahead[:, k - 1, :, None] + t[None], 1) + e[:, k]
            ahead[:, k] = np.where(there[:, k, None], go, ahead[:, k - 1])
        behind[:, -1] = t[:, 0]
        for k in range(longest - 2, -1, -1):
            go = log_sum(t[None] + (e[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            behind[:, k] = np.where(there[:, k + 1, None], go, t[:, 0])
        total = log_sum(ahead[:, -1] + t[:, 0], 1)
        p = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
        gw, gt = decay * w, decay * t
        diff = p.copy()
        np.subtract.at(diff, (np.arange(len(rows))[:, None], np.arange(longest)[None], gold), there.astype(float))
        np.add.at(gw, feats.reshape(-1, feats.shape[2]), diff.reshape(-1, 1, n))
        gt[0] += p[:, 0].sum(0)
        np.subtract.at(gt, (0, gold[:, 0]), 1.0)
        last = size - 1
        gt[:, 0] += p[np.arange(len(rows)), last].sum(0)
        np.subtract.at(gt, (gold[np.arange(len(rows)), last], 0), 1.0)
        for k in range(1, longest):
            on = there[:, k]
            pair = np.exp(ahead[on, k - 1, :, None] + t[None] + (e[on, k] + behind[on, k])[:, None, :] - total[on, None, None])
            gt += pair.sum(0)
            np.subtract.at(gt, (gold[on, k - 1], gold[on, k]), 1.0)
        for x, g, m, v in ((w, gw, first[0], second[0]), (t, gt, first[1], second[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        np.clip(t, -most_move, most_move, out=t)
    scores = w[_features(np.arange(_CODES))].sum(axis=1)
    # what any neighbours' transitions can gain by another label than O, at most
    gain = (t[:, :, None] + t[None, :, :] - t[:, :1, None] - t[None, :1, :]).max(axis=(0, 2))
    outside = (scores[:, :1] - scores[:, 1:] > gain[None, 1:]).all(axis=1)
    return Field(scores, t, outside)


_field: list[Field] = []


def field() -> Field:
    """The trained field, once per worker; training is the same everywhere."""
    if not _field:
        _field.append(train())
    return _field[0]


def viterbi(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of chains padded to (chains, longest, labels); "outside" stands before and after each."""
    chains, longest, n = scores.shape
    best = scores[:, 0] + moves[0]
    back = np.zeros((longest, chains, n), dtype=np.int8)
    for k in range(1, longest):
        on = int(np.searchsorted(-sizes, -k))  # chains are by falling size; these have a word k
        step = best[:on, :, None] + moves[None]
        back[k, :on] = step.argmax(axis=1)
        best[:on] = step.max(axis=1) + scores[:on, k]
    labels = np.zeros((chains, longest), dtype=np.int64)
    now = (best + moves[:, 0]).argmax(axis=1)
    labels[np.arange(chains), sizes - 1] = now
    for k in range(longest - 1, 0, -1):
        on = int(np.searchsorted(-sizes, -k))
        labels[:on, k - 1] = back[k, np.arange(on), labels[:on, k]]
    return labels


def decode(codes: np.ndarray, first: np.ndarray, model: Field) -> np.ndarray:
    """Labels of all words; ``first`` holds each text's first word, and the end."""
    labels = np.zeros(len(codes), dtype=np.int64)
    open_words = ~model.outside[codes]
    if not open_words.any():
        return labels
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[first] = True
    at = np.flatnonzero(open_words)
    head = np.concatenate([[True], (np.diff(at) > 1) | edge[at[1:]]])
    starts = at[head]
    sizes = np.diff(np.concatenate([np.flatnonzero(head), [len(at)]]))
    order = np.argsort(-sizes, kind="stable")
    done = 0
    while done < len(order):
        longest = int(sizes[order[done]])
        some = order[done:done + max(1, 40_000 // longest)]
        done += len(some)
        size = sizes[some]
        place = starts[some][:, None] + np.minimum(np.arange(longest), size[:, None] - 1)
        found = viterbi(model.scores[codes[place]], size, model.moves)
        inside = np.arange(longest) < size[:, None]
        labels[place[inside]] = found[inside]
    return labels


_EDGES = {"email": "<>()[]{},;:.!?\"'", "ip": "()[]{},;:.!?\"'", "card": "()[]{},;:.!?\"'/", "phone": "[]{},;:.!?\"'/"}


def plausible(kind: str, s: str) -> bool:
    """Whether a text that the field marked also looks like its kind."""
    d = digits_of(s)
    if kind == "email":
        local, _, domain = s.partition("@")
        return bool(local) and "@" not in domain and bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*", domain)) and all(c in _LOCAL for c in local)
    if kind == "ip":
        return s.count(".") == 3 and all(p.isdigit() and p.isascii() for p in s.split(".")) and _ip_ok(s)
    if any(not ("0" <= c <= "9") and c not in " ().-/+" for c in s):
        return False
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    if kind == "card":  # no dates or counts
        return _card_ok(s) and min(groups) >= 3
    grouped = len(groups) <= (7 if s[0] == "+" else 5) and (s[0] == "+" or max(groups, default=0) >= 3)
    return grouped and 9 <= len(d) <= 15 and len(d) < len(s) and s[0] in "+(0123456789" and s.count("(") == s.count(")")


def all_spans(texts: common.Texts, model: Field) -> Iterator[tuple[list[Span], list[Span]]]:
    """Of each text the base spans and all spans, both by kind as listed, then by start."""
    begins, ends, first = texts.words()
    labels = decode(shape_codes(texts, begins, ends), first, model)
    marked = np.flatnonzero(labels)
    which = np.searchsorted(first, marked, side="right") - 1
    by_text: dict[int, list[int]] = {}
    for k, i in zip(marked.tolist(), which.tolist()):
        by_text.setdefault(i, []).append(k)
    raw, cut = texts.data.tobytes(), texts.starts.tolist()
    for i in range(len(texts)):
        data = raw[cut[i]:cut[i + 1]]
        text = data.decode("utf-8", "replace")
        base = base_spans(text)
        more = []
        if i in by_text:
            plain = len(text) == len(data)
            runs: list[list[int]] = []  # last word, its label's kind, start, end
            for k in by_text[i]:  # words of one span: labelled alike, next to each other, later ones "inside", none in a base span
                name, x, y = LABELS[labels[k]], int(begins[k]) - cut[i], int(ends[k]) - cut[i]
                if not plain:
                    x, y = len(data[:x].decode("utf-8", "replace")), len(data[:y].decode("utf-8", "replace"))
                if any(x < q and p < y for _, p, q in base):
                    continue
                if runs and name[0] == "I" and runs[-1][0] == k - 1 and runs[-1][1] == name[2:]:
                    runs[-1][0], runs[-1][3] = k, y
                else:
                    runs.append([k, name[2:], x, y])
            for _, kind, x, y in runs:
                while x < y and text[x] in _EDGES[kind]:
                    x += 1
                while y > x and text[y - 1] in _EDGES[kind]:
                    y -= 1
                if x < y and plausible(kind, text[x:y]):
                    more.append((kind, x, y))
        yield base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = common.arrow_schema(doc_id=pa.int64(), base=pa.string(), spans=pa.string())


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): per row of ``docs`` (doc_id, text) the spans, written as kind:start:end joined by commas."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field()
        for batch in it:
            for at, texts in common.text_slices(batch.column(1)):
                found = list(all_spans(texts, model))
                yield common.record(FOUND, batch.column(0).slice(at, len(texts)), [written(b) for b, _ in found], [written(s) for _, s in found])

    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, base string, spans string")


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets, as in <email>; texts without spans are untouched."""
    schema = docs.schema
    place = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field()
        for batch in it:
            out, column = [], batch.column(place)
            for at, texts in common.text_slices(column):
                raw = column.slice(at, len(texts)).to_pylist()
                for text, (_, spans) in zip(raw, all_spans(texts, model)):
                    out.append(replaced(text, spans) if spans else text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, type=column.type))

    common.prepare(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def replaced(text: str, spans: list[Span]) -> str:
    """The text with its spans replaced; spans that overlap are replaced together, under the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def query(docs: DataFrame) -> DataFrame:
    def count(kind: str):
        return F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")

    return find(docs).select("doc_id", *[count(k) for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
