"""Text and mail scalars."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.clean import blank_to_null


def contains_pattern(words: str) -> str:
    """The pattern for "contains"; ``%`` and ``_`` in the words stay wildcards.

    A backslash before any other character has no effect, so it is left out.
    """
    return re.sub(r"\\([^%_\\])", r"\1", f"%{words}%")


def contains(col: Column, words: str) -> Column:
    """Case-insensitive contains."""
    return col.ilike(contains_pattern(words))


def search_document(*parts: Column) -> Column:
    """The searched text of a message: its parts with one blank between, also where a part is missing."""
    pieces = [F.coalesce(parts[0], F.lit(""))]
    for p in parts[1:]:
        pieces += [F.lit(" "), F.coalesce(p, F.lit(""))]
    return F.concat(*pieces)


def tokens(col: Column) -> Column:
    """Lower-case words: runs of letters and digits. Positions count every word, stop words too."""
    return F.regexp_extract_all(F.lower(col), F.lit("[\\p{L}\\p{N}]+"), 0)


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, V.TAG_PATTERN, " ")


def decode_b64url(col: Column) -> Column:
    """URL-safe base64, padded or not, to text; bytes that are no UTF-8 are dropped, other data is blank."""
    std = F.replace(F.replace(col, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    padded = F.concat(std, F.repeat(F.lit("="), F.pmod(-F.length(col), F.lit(4))))
    text = F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(col.isNotNull(), F.coalesce(F.replace(text, F.lit("\ufffd"), F.lit("")), F.lit("")))


def header_value(headers: Column, name: str) -> Column:
    """Value of a header by lower-cased name; the last of several wins, none gives NULL."""
    named = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.try_element_at(F.transform(named, lambda h: h["value"]), F.lit(-1))


def header_map(headers: Column) -> Column:
    """All headers as a map from lower-cased name; the last of several wins."""
    names = F.transform(headers, lambda h: F.lower(h["name"]))

    def is_last(h: Column, i: Column) -> Column:
        later = F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1)))
        return ~F.array_contains(later, F.lower(h["name"]))

    last = F.filter(headers, is_last)
    return F.map_from_entries(F.transform(last, lambda h: F.struct(F.lower(h["name"]), h["value"])))


_ATOM = r'[^\s()<>@,:;"\[\]\\]+'
_SPEC = f"{_ATOM}@{_ATOM}"
_QUOTED = r'"[^"\\()<>@:;\[\]]*"'
# ``address``, ``<address>``, ``Name <address>`` and ``"Name" <address>``; every other form needs the mail grammar.
COMMON_ADDRESS = rf"^ *(?:{_SPEC}|(?:(?:{_QUOTED}|{_ATOM}(?: {_ATOM})*) ?)?<{_SPEC}>) *$"


def address_name(col: Column) -> Column:
    """Display name of an address in a common form; blank when there is only an address."""
    return F.btrim(F.regexp_extract(col, '^ *"?(.*?)"? ?<', 1))


def address_spec(col: Column) -> Column:
    """The address of a common form."""
    return F.regexp_extract(col, f"({_SPEC})>? *$", 1)


def epoch_ms_ts(col: Column) -> Column:
    """Epoch milliseconds as text to a timestamp; blank and NULL give NULL."""
    return F.timestamp_millis(blank_to_null(col).cast("bigint"))


def labels_array(col: Column) -> Column:
    return F.coalesce(col, F.array().cast("array<string>"))
