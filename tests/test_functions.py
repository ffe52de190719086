"""Scalar rules on small literal inputs with results worked out by hand."""

import email.utils

import pytest
from pyspark.sql import functions as F

from skyspine.functions import clean as C
from skyspine.functions import decode as D
from skyspine.functions import fixed_values as V
from skyspine.functions import text as X
from skyspine.functions import weather as W
from skyspine.operators import mail as M


def test_norm_tail(values):
    rows = [" 116hl ", "N116HL", "NN12", "N", "", None, "\t77a\n"]
    assert values(lambda d: C.norm_tail(d.x), rows) == ["N116HL", "N116HL", "N12", "N", "", "", "N77A"]


def test_strip_takes_all_white_space(values):
    rows = ["\t a b \r\n", " x ", "\x1cy\x1f", "  z", ""]
    assert values(lambda d: C.strip(d.x), rows) == [r.strip() for r in rows]


def test_yes_no(values):
    rows = ["Yes", "1", "TRUE", " no", "0", "false", "", "maybe", None]
    assert values(lambda d: C.yes_no(d.x), rows) == [True, True, True, False, False, False, None, None, None]


def test_int_or_zero(values):
    assert values(lambda d: C.int_or_zero(d.x), ["007", "", "1a", "-1", None, "12"]) == [7, 0, 0, 0, 0, 12]


def test_na_texts(values):
    assert values(lambda d: C.na_text_to_blank(d.x), ["NA", "N/A", "null", "Na", "x", None]) == ["", "", "", "Na", "x", ""]


def test_first_nonblank(values):
    rows = [("", "b"), (None, "b"), ("a", "b"), ("", None)]
    assert values(lambda d: C.first_nonblank(d.x, d.y), rows, "x STRING, y STRING") == ["b", "b", "a", None]


def test_classify_category(values):
    rows = [("6", "5"), ("9", "1"), ("5", "5"), ("4", "2"), ("4", "8"), ("4", "10"), ("1", "0"), (None, None)]
    got = values(lambda d: D.classify_category(d.x, d.y), rows, "x STRING, y STRING")
    assert got == ["Helicopter", "Helicopter", "Jet", "Turboprop", "Piston", "Electric", "Other", "Other"]


def test_decodes(values):
    assert values(lambda d: D.decode_passthrough(V.ENGINE_TYPE, d.x), ["5", "10", "zz", "", None]) == [
        "Turbo-fan", "Electric", "zz", "", None]
    assert values(lambda d: D.owner_type(d.x), ["7", "6", "", None]) == ["LLC", "Type 6", "—", "—"]
    rows = ["V", "12", "Q", "", None, "E"]
    assert values(lambda d: D.status_label(d.x), rows) == ["Valid", "In process", "Q", "—", "—", "Revoked"]
    assert values(lambda d: D.status_tier(d.x), rows) == ["good", "warn", "neutral", "neutral", "neutral", "bad"]
    assert values(lambda d: D.class_desc(d.x), ["L", "P", "F"]) == ["Non-sched pax/cargo", "Non-sched all-cargo", None]


def test_pad_code_cuts(values):
    assert values(lambda d: D.pad_code(d.x), ["6", "1234", None]) == ["006", "123", None]


def test_city_of(values):
    assert values(lambda d: D.city_of(d.x), ["Teterboro, NJ", "Nice", "", None]) == ["Teterboro", "Nice", "", None]


def test_title_case(values):
    rows = ["NETJETS AVIATION LLC", "O'HARE", "café", "caféa", "abc-def 3m", "us steel iii", "llcs", None, ""]
    assert values(lambda d: D.title_case(d.x), rows) == [
        "Netjets Aviation LLC", "O'Hare", "Café", "CaféA", "Abc-Def 3m", "US Steel III", "Llcs", None, ""]


def test_clean_type(values):
    rows = ["large_airport", "seaplane_base", "closed", "", None, "x_airport_airport"]
    assert values(lambda d: D.clean_type(d.x), rows) == ["Large", "Seaplane Base", "Closed", "", "", "X Airport"]


def test_parse_seats(values):
    assert values(lambda d: D.parse_seats(d.x), ["012", "0", "", "abc", " 7x", "-3", None]) == [12, None, None, None, 7, -3, None]


def test_format_interval(values):
    rows = [604800, 86400, 5400, 45, 3600, None, 1209600]
    assert values(lambda d: D.format_interval(d.x), rows, "x BIGINT") == ["1w", "1d", "90m", "45s", "1h", "—", "2w"]


def test_age_text(values):
    rows = ["2026-01-01 00:00:00", "2026-01-01 11:59:30.5", "2026-01-01 11:00:01", "2025-12-30 11:59:59", None]
    got = values(lambda d: D.age_text(d.x.cast("timestamp"), F.lit("2026-01-01 12:00:00")), rows)
    assert got == ["12h ago", "29s ago", "59m ago", "2d ago", "never"]


def test_distinct_codes(values):
    def build(d):
        return D.distinct_codes([d.ident, d.local, d.gps], [d.iata, d.icao])
    got = values(build, [("KTEB", "TEB", "KTEB", "TEB", "KTEB"), ("X1", "", "X2", None, ""), ("A", "A", None, None, None)],
                 "ident STRING, local STRING, gps STRING, iata STRING, icao STRING")
    assert got == [[], ["X1", "X2"], ["A", "A"]]


def test_numbers(values):
    assert values(lambda d: D.whole_number(d.x), [-2.5, 2.5, 2.4, -0.5, None], "x DOUBLE") == [-2, 3, 2, 0, None]
    assert values(lambda d: D.format_count(d.x), [1234567, 0, None], "x BIGINT") == ["1,234,567", "0", "—"]
    assert values(lambda d: D.ratio(d.x, d.y), [(7.0, 2.0), (1.0, 0.0), (None, 1.0)], "x DOUBLE, y DOUBLE") == [3.5, None, None]
    assert [float(v) for v in values(lambda d: D.round_measure(d.x), ["2.50", "-2.50", "2.49"])] == [3.0, -3.0, 2.0]
    assert values(lambda d: D.coord_text(d.x, d.y), [(1.0, -2.12345), (None, 1.0)], "x DOUBLE, y DOUBLE") == [
        "1.0000, -2.1235", "—"]


def test_recent_periods_lag(values):
    got = values(lambda d: D.recent_periods(d.x.cast("date"), 3), ["2026-03-15"])[0]
    assert [(p.year, p.month) for p in got] == [(2025, 11), (2025, 10), (2025, 9)]


def test_latest_cycle(values):
    page = "NASR_Subscription/2026-01-22 NASR_Subscription/2026-02-19 x/2026-02-01 NASR_Subscription/2026-01-22"
    def at(day):
        return values(lambda d: D.latest_cycle(d.x, F.lit(day).cast("date")), [page, "nothing"])
    assert at("2026-02-01") == ["2026-01-22", None]
    assert at("2026-03-01") == ["2026-02-19", None]
    assert at("2025-01-01") == ["2026-02-19", None]


def test_contains_pattern(values):
    rows = ["a%b", "axb", "A\\B", "ab", "100%", None]
    assert values(lambda d: X.contains(d.x, "a%b"), rows) == [True, True, True, True, False, None]
    assert values(lambda d: X.contains(d.x, "a\\%b"), rows) == [True, False, False, False, False, None]
    # A backslash before an ordinary character has no effect.
    assert values(lambda d: X.contains(d.x, "a\\b"), rows) == [False, False, False, True, False, None]
    assert values(lambda d: X.contains(d.x, "0\\"), rows)[4] is True


def test_decode_b64url(values):
    rows = ["w6k_", "w6k", "aGk=", "aGk", "/w==", "_2hp", "", None, "%%%"]
    assert values(lambda d: X.decode_b64url(d.x), rows) == ["é?", "é", "hi", "hi", "", "hi", "", None, ""]


def test_headers_last_wins(values):
    ddl = "x ARRAY<STRUCT<name: STRING, value: STRING>>"
    rows = [([("From", "a"), ("FROM", "b"), ("To", "c")],), ([],), (None,)]
    assert values(lambda d: X.header_value(d.x, "from"), rows, ddl) == ["b", None, None]
    assert values(lambda d: X.header_map(d.x), rows, ddl) == [{"from": "b", "to": "c"}, {}, None]


ADDRESSES = ["a@b.org", " a@b.org ", "Jane Doe <a@b.org>", '"Doe, Jane" <a@b.org>', "<a@b.org>", "John Q. Public <j@x>",
             "a@b.org (Jane)", "a@b.org, c@d.org", '"A \\"B\\" C" <a@b>', "", "Jane", "undisclosed-recipients:;",
             "Jané <a@b.org>", "=?utf-8?q?Jane?= <a@b.org>", '"a"<a@b.org>', "X  Y <a@b.org>", "Jane <a@b.org> ",
             "Jane<a@b.org>", "a b@c", '"quoted.local"@b.org', "Jane (work) <a@b.org>", "<>", "Jane <>", "first.last@b.co.uk"]


@pytest.mark.parametrize("header", ADDRESSES)
def test_parse_address_is_the_mail_grammar(values, header):
    got = values(lambda d: M.parse_address(d.x), [header])[0]
    assert (got.name, got.addr) == email.utils.parseaddr(header)


def test_epoch_ms(values):
    got = values(lambda d: X.epoch_ms_ts(d.x).cast("string"), ["1704067200123", "", None])
    assert got == ["2024-01-01 00:00:00.123", None, None]


CLOUDS = "x ARRAY<STRUCT<cover: STRING, base: INT>>"


def test_clouds(values):
    rows = [([("FEW", 800), ("BKN", 2500), ("OVC", 1200)],), ([("SCT", 900)],), ([],), (None,), ([("OVX", None)],)]
    assert values(lambda d: W.ceiling(d.x), rows, CLOUDS) == [1200, None, None, None, None]
    assert values(lambda d: W.cloud_text(d.x), rows, CLOUDS) == ["FEW 800, BKN 2,500, OVC 1,200", "SCT 900", "Clear", "Clear",
                                                                 "OVX"]


def test_wind(values):
    ddl = "x STRING, y INT, z INT"
    rows = [("0", 5, None), ("0", 0, None), ("270", 12, 22), (None, 5, None), ("VRB", 4, None), ("90", None, 0)]
    assert values(lambda d: W.wind_text(d.x, d.y, d.z), rows, ddl) == [
        "VRB @ 5 kt", "0° @ 0 kt", "270° @ 12 kt G22", "—", "VRB° @ 4 kt", "90° @ 0 kt"]
    assert values(lambda d: W.forecast_wind_text(d.x, d.y, d.z), rows[2:4], ddl) == ["270° @ 12ktG22", "—"]


def test_weather_labels(values):
    assert values(lambda d: W.zulu(d.x), [1704465000], "x BIGINT") == ["05 14:30Z"]
    assert values(lambda d: W.altimeter_inhg(d.x), [1013.25, None], "x DOUBLE") == [29.92, None]
    assert values(lambda d: W.change_label(d.x, d.y), [("TEMPO", 40), ("BECMG", None), ("", 30), (None, None)],
                  "x STRING, y INT") == ["TEMPO 40%", "BECMG", "FROM", "FROM"]


def test_first_photo(values):
    thumb = "STRUCT<src: STRING>"
    ddl = f"x ARRAY<STRUCT<id: STRING, link: STRING, photographer: STRING, thumbnail: {thumb}, thumbnail_large: {thumb}>>"
    rows = [([("1", "l", "p", ("s",), ("big",)), ("2", "l", "p", ("s",), None)],), ([("1", "l", "p", ("s",), None)],),
            ([("1", "l", "p", ("s",), ("",))],), ([],), (None,)]
    got = values(lambda d: W.first_photo(d.x), rows, ddl)
    assert [(g.has_photo, g.thumbnail_url) for g in got] == [(True, "big"), (True, "s"), (True, "s"), (False, None), (False, None)]
