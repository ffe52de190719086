"""Code decoding, labels, formatting and period arithmetic."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyspine.functions import fixed_values as V
from skyspine.functions.clean import blank_to_null, nonblank


def literal_map(table: dict) -> Column:
    """A small fixed code table as a map literal."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def lookup(table: dict, code: Column) -> Column:
    """Label of a code, NULL for a code that is not in the table."""
    return F.try_element_at(literal_map(table), F.coalesce(code, F.lit("")))


def decode_passthrough(table: dict, code: Column) -> Column:
    """Label of a code; an unknown code stands for itself."""
    return F.coalesce(lookup(table, code), code)


def classify_category(type_code: Column, engine_code: Column) -> Column:
    """Aircraft category; the rotor types win over the engine."""
    return (
        F.when(type_code.isin(V.ROTOR_TYPES), "Helicopter")
        .when(engine_code.isin(V.JET_ENGINES), "Jet")
        .when(engine_code.isin(V.TURBOPROP_ENGINES), "Turboprop")
        .when(engine_code.isin(V.PISTON_ENGINES), "Piston")
        .when(engine_code.isin(V.ELECTRIC_ENGINES), "Electric")
        .otherwise("Other")
    )


def owner_type(code: Column) -> Column:
    """Registrant type label, ``Type x`` for an unknown code, a dash for none."""
    other = F.when(nonblank(code), F.concat(F.lit("Type "), code)).otherwise(F.lit(V.DASH))
    return F.coalesce(lookup(V.OWNER_TYPE, code), other)


def status_label(code: Column) -> Column:
    labels = {k: label for k, (label, _) in V.REGISTRATION_STATUS.items()}
    return (
        F.when(~nonblank(code) | code.isNull(), F.lit(V.DASH))
        .when(code.isin(list(labels)), lookup(labels, code))
        .when(code.rlike("^[0-9]+$"), F.lit("In process"))
        .otherwise(code)
    )


def status_tier(code: Column) -> Column:
    tiers = {k: tier for k, (_, tier) in V.REGISTRATION_STATUS.items()}
    numeric = F.when(code.rlike("^[0-9]+$"), F.lit("warn")).otherwise(F.lit("neutral"))
    return F.coalesce(lookup(tiers, code), numeric)


def class_desc(code: Column) -> Column:
    return lookup(V.CHARTER_CLASSES, code)


def city_of(col: Column, separator: str = ",") -> Column:
    """The part before the first separator."""
    return F.split_part(col, F.lit(separator), F.lit(1))


def pad_code(col: Column, width: int = 3) -> Column:
    """Zero-pad to the width; a longer code is cut to it."""
    return F.lpad(col, width, "0")


def _words(col: Column) -> Column:
    """Split into runs of word characters and single other characters; nothing is lost."""
    return F.regexp_extract_all(col, F.lit("\\w+|\\W"), 0)


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 2147483647))


def clean_type(col: Column) -> Column:
    """``large_airport`` -> ``Large``: drop the first suffix, blanks for underscores, capitals."""
    spaced = F.translate(F.regexp_replace(col, "^(.*?)_airport", "$1"), "_", " ")
    return F.coalesce(F.array_join(F.transform(_words(spaced), _capital), ""), F.lit(""))


def title_case(col: Column) -> Column:
    """Capital at each ASCII word start, company suffixes and numerals all upper-case."""
    return F.array_join(
        F.transform(
            _words(F.lower(col)),
            lambda w: F.when(w.isin(V.UPPER_WORDS), F.upper(w)).when(w.rlike("^[a-z]"), _capital(w)).otherwise(w),
        ),
        "",
    )


def parse_seats(col: Column) -> Column:
    """The leading integer; zero or no number is missing."""
    number = F.regexp_extract(col, "^\\s*([+-]?[0-9]+)", 1).try_cast("bigint")
    return F.nullif(number, F.lit(0).cast("bigint"))


def format_interval(seconds: Column) -> Column:
    """Seconds in the largest unit that divides them."""
    def unit(size: int, mark: str) -> Column:
        return F.concat((seconds / size).cast("bigint").cast("string"), F.lit(mark))

    return (
        F.when(seconds.isNull(), F.lit(V.DASH))
        .when(seconds % 604800 == 0, unit(604800, "w"))
        .when(seconds % 86400 == 0, unit(86400, "d"))
        .when(seconds % 3600 == 0, unit(3600, "h"))
        .when(seconds % 60 == 0, unit(60, "m"))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )


def age_text(ts: Column, as_of: Column) -> Column:
    """How long before ``as_of``, in the largest whole unit."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))

    def whole(unit_seconds: int, mark: str) -> Column:
        return F.concat(F.floor(micros / (unit_seconds * 1000000)).cast("string"), F.lit(mark))

    return (
        F.when(ts.isNull(), F.lit("never"))
        .when(micros < 60 * 1000000, whole(1, "s ago"))
        .when(micros < 3600 * 1000000, whole(60, "m ago"))
        .when(micros < 86400 * 1000000, whole(3600, "h ago"))
        .otherwise(whole(86400, "d ago"))
    )


def distinct_codes(extra: list[Column], known: list[Column]) -> Column:
    """Secondary codes that hold something and do not repeat a primary code, in the given order."""
    held = F.array_compact(F.array(*[blank_to_null(c) for c in extra]))
    return F.filter(held, lambda c: ~F.array_contains(F.array_compact(F.array(*[F.coalesce(k, F.lit("")) for k in known])), c))


def pair_label(left: Column, right: Column, separator: str = "/") -> Column:
    """Both parts around a separator, blanks for missing ones."""
    return F.concat(F.coalesce(left, F.lit("")), F.lit(separator), F.coalesce(right, F.lit("")))


def joined_label(*parts: Column, separator: str = ", ") -> Column:
    """The parts that hold something, joined."""
    return F.concat_ws(separator, *[blank_to_null(p) for p in parts])


def period_label(year: Column, month: Column) -> Column:
    name = F.try_element_at(F.array(*[F.lit(m) for m in V.MONTH_LABELS]), month.cast("int"))
    return F.concat(name, F.lit(" "), year.cast("string"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient to one decimal, missing when the denominator is zero or missing."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 1)


def round_measure(col: Column) -> Column:
    """Half away from zero, on exact decimals."""
    return F.round(col.cast("decimal(18,2)"), 0)


def whole_number(col: Column) -> Column:
    """Half toward plus infinity."""
    return F.floor(col + F.lit(0.5)).cast("bigint")


def format_count(col: Column) -> Column:
    return F.coalesce(F.format_number(col, 0), F.lit(V.DASH))


def coord_text(lat: Column, lon: Column) -> Column:
    both = lat.isNotNull() & lon.isNotNull()
    return F.when(both, F.format_string("%.4f, %.4f", lat, lon)).otherwise(F.lit(V.DASH))


def recent_periods(as_of: Column, n: int, lag_months: int = V.PUBLISH_LAG_MONTHS) -> Column:
    """The n newest (year, month) likely published at ``as_of``, newest first."""
    first = F.trunc(as_of, "MM")

    def period(i: Column) -> Column:
        day = F.add_months(first, -(i + F.lit(lag_months)))
        return F.struct(F.year(day).alias("year"), F.month(day).alias("month"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), period)


def cycle_dates(page: Column, pattern: str = V.CYCLE_PATTERN) -> Column:
    """Distinct published cycle dates in a page, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(page, F.lit(pattern), 1)))


def latest_cycle(page: Column, as_of: Column) -> Column:
    """The newest cycle not after ``as_of``, else the newest of all."""
    dates = cycle_dates(page)
    day = F.date_format(as_of, "yyyy-MM-dd")
    return F.coalesce(F.array_max(F.filter(dates, lambda d: d <= day)), F.array_max(dates))


def result_json(**counts: Column) -> Column:
    """A run summary as JSON text."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in counts.items()]))
