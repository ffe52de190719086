"""English word stems by the public Snowball rules, as one column expression.

Words are few compared with their occurrences, so stems are formed on a vocabulary and matched from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published rule tables.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINAL_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
REGION_PREFIXES = "gener|commun|arsen"
# Suffix -> replacement, tried from the longest; the third part is what must stand before the suffix.
STEP_2 = [
    ("ization", "ize", ""), ("ational", "ate", ""), ("fulness", "ful", ""), ("ousness", "ous", ""), ("iveness", "ive", ""),
    ("tional", "tion", ""), ("biliti", "ble", ""), ("lessli", "less", ""), ("entli", "ent", ""), ("ation", "ate", ""),
    ("alism", "al", ""), ("aliti", "al", ""), ("ousli", "ous", ""), ("iviti", "ive", ""), ("fulli", "ful", ""),
    ("enci", "ence", ""), ("anci", "ance", ""), ("abli", "able", ""), ("izer", "ize", ""), ("ator", "ate", ""),
    ("alli", "al", ""), ("bli", "ble", ""), ("ogi", "og", "l"), ("li", "", "[cdeghkmnrt]"),
]
STEP_3 = [
    ("ational", "ate", ""), ("tional", "tion", ""), ("alize", "al", ""), ("icate", "ic", ""), ("iciti", "ic", ""),
    ("ative", "", ""), ("ical", "ic", ""), ("ness", "", ""), ("ful", "", ""),
]
STEP_4 = [
    ("ement", "", ""), ("ance", "", ""), ("ence", "", ""), ("able", "", ""), ("ible", "", ""), ("ment", "", ""),
    ("ant", "", ""), ("ent", "", ""), ("ism", "", ""), ("ate", "", ""), ("iti", "", ""), ("ous", "", ""), ("ive", "", ""),
    ("ize", "", ""), ("ion", "", "[st]"), ("al", "", ""), ("er", "", ""), ("ic", "", ""),
]
SHORT_SYLLABLE = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"


def _cut(word: str, letters: int, tail: str = "") -> str:
    kept = f"left({word}, length({word}) - {letters})"
    return f"concat({kept}, '{tail}')" if tail else kept


def _case(*cases: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in cases) + f" ELSE {otherwise} END"


def _let(value: str, body: Callable[[str], str], depth: int) -> str:
    """The body with the value bound to a variable, so that it is evaluated once however often it is used."""
    return f"element_at(transform(array({value}), v{depth} -> {body(f'v{depth}')}), 1)"


def _region_start(word: str, start: str, depth: int) -> str:
    """End of the first vowel followed by a non-vowel at or after ``start``; the word's end when there is none."""
    found = f"length(regexp_extract(substring({word}, {start} + 1, length({word})), '{REGION}', 0))"
    return _let(found, lambda n: _case((f"{n} > 0", f"{start} + {n}"), otherwise=f"length({word})"), depth)


def _longest(word: str, rules: list[tuple[str, str, str]], region: str, stricter: dict[str, str]) -> str:
    """Replace the longest suffix that fits, if it lies in its region and stands after the right letters."""
    cases = []
    for suffix, tail, before in rules:
        inside = f"length({word}) - {len(suffix)} >= {stricter.get(suffix, region)}"
        if before:
            inside += f" AND {word} RLIKE '{before}{suffix}$'"
        cases.append((f"endswith({word}, '{suffix}')", _case((inside, _cut(word, len(suffix), tail)), otherwise=word)))
    return _case(*cases, otherwise=word)


def _steps(word: str, steps: list[Callable[[str, int], str]], depth: int) -> str:
    if not steps:
        return word
    return _let(word, lambda w: _steps(steps[0](w, depth + 1), steps[1:], depth + 1), depth)


def _plural(w: str) -> str:
    return _case((f"endswith({w}, 'sses')", _cut(w, 2)),
                 (f"{w} RLIKE 'ie[ds]$'", _case((f"length({w}) > 4", _cut(w, 2)), otherwise=_cut(w, 1))),
                 (f"{w} RLIKE '[us]s$'", w), (f"{w} RLIKE '[aeiouy].+s$'", _cut(w, 1)), otherwise=w)


def _past(w: str, r1: str, depth: int) -> str:
    """Past and progressive forms; what is left may need its e back or lose a doubled letter."""
    def repaired(left: str) -> str:
        return _case((f"{left} RLIKE '(at|bl|iz)$'", f"concat({left}, 'e')"),
                     (f"{left} RLIKE '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$'", _cut(left, 1)),
                     (f"{left} RLIKE '{SHORT_SYLLABLE}' AND {r1} >= length({left})", f"concat({left}, 'e')"), otherwise=left)

    def by_ending(end: str) -> str:
        rest = f"left({w}, length({w}) - length({end}))"
        return _case((f"{end} = ''", w),
                     (f"{end} IN ('eed', 'eedly')", _case((f"length({rest}) >= {r1}", f"concat({rest}, 'ee')"), otherwise=w)),
                     (f"{rest} RLIKE '[aeiouy]'", _let(rest, repaired, depth + 1)), otherwise=w)

    return _let(f"regexp_extract({w}, '(eedly|eed|ingly|edly|ing|ed)$', 1)", by_ending, depth)


def _final_letter(w: str, r1: str, r2: str) -> str:
    before = f"length({w}) - 1"
    drop_e = f"endswith({w}, 'e') AND ({before} >= {r2} OR ({before} >= {r1} AND NOT {_cut(w, 1)} RLIKE '{SHORT_SYLLABLE}'))"
    return _case((f"({drop_e}) OR (endswith({w}, 'll') AND {before} >= {r2})", _cut(w, 1)), otherwise=w)


def _stem_lambda() -> str:
    def regular(marked: str, r1: str, r2: str, depth: int) -> str:
        after_plural = [
            lambda w, d: _past(w, r1, d),
            lambda w, d: _case((f"{w} RLIKE '.[^aeiouy][yY]$'", _cut(w, 1, "i")), otherwise=w),
            lambda w, d: _longest(w, STEP_2, r1, {}),
            lambda w, d: _longest(w, STEP_3, r1, {"ative": r2}),
            lambda w, d: _longest(w, STEP_4, r2, {}),
            lambda w, d: _final_letter(w, r1, r2),
            lambda w, d: f"translate({w}, 'Y', 'y')",
        ]
        final = ", ".join(f"'{x}'" for x in FINAL_AFTER_PLURAL)
        return _let(_plural(marked), lambda p: _case((f"{p} IN ({final})", p), otherwise=_steps(p, after_plural, depth + 1)), depth)

    def with_regions(marked: str) -> str:
        def first(prefix: str) -> str:
            return _case((f"{prefix} > 0", prefix), otherwise=_region_start(marked, "0", 3))
        start = _let(f"length(regexp_extract({marked}, '^({REGION_PREFIXES})', 1))", first, 2)
        return _let(start, lambda r1: _let(_region_start(marked, r1, 3), lambda r2: regular(marked, r1, r2, 4), 3), 2)

    special = _case(*((f"w = '{word}'", f"'{stem}'") for word, stem in SPECIAL.items()), ("length(w) <= 2", "w"),
                    otherwise=_let("regexp_replace(w, '(^|[aeiou])y', '$1Y')", with_regions, 1))
    return f"w -> {special}"


#: The rules as one SQL lambda, written once: an expression of this size is slow to put together call by call.
STEM_LAMBDA = _stem_lambda()


def english_stem(word: Column) -> Column:
    """Stem of a lower-case word."""
    return F.element_at(F.call_function("transform", F.array(word), F.expr(STEM_LAMBDA)), 1)


def may_have_stem(word: Column, stems: list[str]) -> Column:
    """A cheap condition that every word with one of the stems fulfils.

    The rules change a word from its end and keep its first two letters, but for the special words.
    """
    near = word.isin([w for w, stem in SPECIAL.items() if stem in stems])
    for start in sorted({stem[:2] for stem in stems}):
        near = near | word.startswith(start)
    return near
