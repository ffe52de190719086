"""Code tables, word lists, patterns and limits that results depend on.

These are data, kept in their natural order; nothing here is logic.
"""

# Aircraft type code -> label (code list of the public aircraft reference file).
AIRCRAFT_TYPE = {
    "1": "Glider", "2": "Balloon", "3": "Blimp/Dirigible", "4": "Fixed wing single-engine",
    "5": "Fixed wing multi-engine", "6": "Rotorcraft", "7": "Weight-shift-control",
    "8": "Powered parachute", "9": "Gyroplane", "H": "Hybrid lift", "O": "Other",
}
# Engine type code -> label.
ENGINE_TYPE = {
    "0": "None", "1": "Reciprocating", "2": "Turbo-prop", "3": "Turbo-shaft", "4": "Turbo-jet",
    "5": "Turbo-fan", "6": "Ramjet", "7": "2-cycle", "8": "4-cycle", "9": "Unknown",
    "10": "Electric", "11": "Rotary",
}
# Registrant type code -> label.
OWNER_TYPE = {
    "1": "Individual", "2": "Partnership", "3": "Corporation", "4": "Co-owned", "5": "Government",
    "7": "LLC", "8": "Non-citizen corp", "9": "Non-citizen co-owned",
}
# Registration status code -> (label, severity tier).
REGISTRATION_STATUS = {
    "V": ("Valid", "good"), "T": ("Valid (trustee)", "good"), "R": ("Registration pending", "warn"),
    "M": ("Valid / pending", "warn"), "N": ("Non-citizen review", "warn"), "A": ("Triennial mailed", "warn"),
    "S": ("Triennial mailed", "warn"), "E": ("Revoked", "bad"), "W": ("Deregistered", "bad"),
    "D": ("Expired dealer", "bad"), "X": ("Enforcement letter", "bad"), "Z": ("Reserved", "neutral"),
}
# Engine codes of each category, and the aircraft type codes that override them.
ROTOR_TYPES = ["6", "9"]
JET_ENGINES = ["4", "5"]
TURBOPROP_ENGINES = ["2", "3"]
PISTON_ENGINES = ["1", "7", "8"]
ELECTRIC_ENGINES = ["10"]
# Traffic service classes counted as charter, and their labels.
CHARTER_CLASSES = {"L": "Non-sched pax/cargo", "P": "Non-sched all-cargo"}
# Airport types left out of a search that names no type.
NOT_LANDPLANE = ["seaplane_base", "heliport", "balloonport", "closed"]
# Cell texts read as yes / no.
YES = ["yes", "1", "true"]
NO = ["no", "0", "false"]
# Cell texts a data-frame reader takes for a missing value.
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
            "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Words that stay upper-case in a title-cased name.
UPPER_WORDS = ["llc", "inc", "llp", "lllp", "lp", "pc", "pa", "usa", "us", "ii", "iii", "iv"]
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Cloud covers that make a ceiling.
CEILING_COVERS = ["BKN", "OVC", "OVX"]
HPA_PER_INHG = 33.8639
EDGE_EPSILON = 1e-12
# Characters a text strip removes at both ends: the Unicode white space set and the four separators.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Limits.
LOG_MESSAGE_CHARS = 8000
RUN_ERROR_CHARS = 8000
JOB_ERROR_CHARS = 2000
HAZARD_TEXT_CHARS = 400
JET_RUNWAY_FT = 4000
PILOT_REPORTS_SHOWN = 8
PILOT_REPORT_RADIUS = 150.0
PUBLISH_LAG_MONTHS = 4
EXTRACT_MAX_AGE_HOURS = 6.0
WEATHER_MAX_AGE_SECONDS = 300
DASH = "—"
# Published cycle dates in a subscription page.
CYCLE_PATTERN = r"NASR_Subscription/(\d{4}-\d{2}-\d{2})"
TAG_PATTERN = "<[^>]+>"
# Charter certificate regulation part when the list has no column for it.
DEFAULT_PART = "135"
# Fixed-width airport base record: field -> (1-based start, length), and its record tag.
AIRPORT_RECORD_TAG = "APT"
AIRPORT_RECORD = {
    "location_id": (28, 4), "site_number": (4, 11), "state": (51, 20), "city": (94, 40),
    "facility_name": (134, 50), "owner_name": (188, 35), "owner_phone": (340, 16),
    "manager_name": (356, 35), "manager_phone": (508, 16), "based_single": (1005, 3),
    "based_multi": (1008, 3), "based_jet": (1011, 3), "based_heli": (1014, 3), "based_glider": (1017, 3),
    "based_military": (1020, 3), "based_ultralight": (1023, 3),
}
BASED_COUNTS = ["based_single", "based_multi", "based_jet", "based_heli", "based_glider", "based_military",
                "based_ultralight"]
# Traffic file header -> table column.
TRAFFIC_COLUMNS = {
    "UNIQUE_CARRIER": "unique_carrier", "AIRLINE_ID": "airline_id", "UNIQUE_CARRIER_NAME": "carrier_name",
    "ORIGIN": "origin", "ORIGIN_CITY_NAME": "origin_city", "ORIGIN_STATE_ABR": "origin_state", "DEST": "dest",
    "DEST_CITY_NAME": "dest_city", "DEST_STATE_ABR": "dest_state", "AIRCRAFT_GROUP": "aircraft_group",
    "AIRCRAFT_TYPE": "aircraft_type", "AIRCRAFT_CONFIG": "aircraft_config", "DEPARTURES_PERFORMED": "departures",
    "SEATS": "seats", "PASSENGERS": "passengers", "FREIGHT": "freight", "MAIL": "mail", "DISTANCE": "distance",
    "YEAR": "year", "MONTH": "month", "CLASS": "class",
}
# Column -> words its header must hold; alternatives are tried in order.
REGISTRY_HEADER = {
    "n_number": [("n-number",)], "serial_number": [("serial",)], "mfr_mdl_code": [("mfr", "mdl", "code")],
    "year_mfr": [("year", "mfr")], "registrant_type": [("type", "registrant")], "registrant_name": [("name",)],
    "city": [("city",)], "state": [("state",)], "status_code": [("status",)],
    "mode_s_code_octal": [("mode", "code")], "mode_s_hex": [("mode", "hex")],
}
REFERENCE_HEADER = {
    "code": [("code",)], "manufacturer": [("mfr",)], "model": [("model",)], "type_code": [("type", "acft")],
    "engine_code": [("type", "eng")], "num_engines": [("no-eng",), ("eng",)], "num_seats": [("seat",)],
}
CERTIFICATE_HEADER = {
    "operator_name": [("certificate", "holder")], "certificate_designator": [("designator",)],
    "fsdo": [("district",), ("fsdo",)], "n_number": [("registration",), ("n-number",)],
    "serial_number": [("serial",)], "make_model_series": [("make",)],
}
CERTIFICATE_PART_HEADER = ("cfr",)
# English stop words of the public Snowball list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now"
).split()
