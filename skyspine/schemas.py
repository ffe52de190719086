"""Target schemas of the stored tables, their keys, and the shapes of nested landed documents."""

from __future__ import annotations

from pyspark.sql import types as T

# Table, column and key names of the data model.
TABLE_DDL = {
    "operators": "certificate_designator STRING, operator_name STRING, part STRING, fsdo STRING",
    "part135_aircraft": "n_number STRING, certificate_designator STRING, serial_number STRING, "
                        "make_model_series STRING",
    "faa_registry": "n_number STRING, serial_number STRING, mfr_mdl_code STRING, year_mfr STRING, "
                    "registrant_type STRING, registrant_name STRING, city STRING, state STRING, "
                    "status_code STRING, mode_s_code_octal STRING, mode_s_hex STRING",
    "aircraft_ref": "code STRING, manufacturer STRING, model STRING, aircraft_type STRING, "
                    "engine_type STRING, category STRING, num_engines STRING, num_seats STRING",
    "t100_segment": "year INT, month INT, unique_carrier STRING, airline_id STRING, carrier_name STRING, "
                    "origin STRING, origin_city STRING, origin_state STRING, dest STRING, dest_city STRING, "
                    "dest_state STRING, aircraft_group STRING, aircraft_type STRING, aircraft_config STRING, "
                    "departures DECIMAL(18,2), seats DECIMAL(18,2), passengers DECIMAL(18,2), "
                    "freight DECIMAL(18,2), mail DECIMAL(18,2), distance DECIMAL(18,2), class STRING",
    "aircraft_type_ref": "code STRING, description STRING",
    "airports": "ident STRING, type STRING, name STRING, latitude_deg DOUBLE, longitude_deg DOUBLE, "
                "elevation_ft INT, continent STRING, iso_country STRING, iso_region STRING, "
                "municipality STRING, scheduled_service BOOLEAN, icao_code STRING, iata_code STRING, "
                "gps_code STRING, local_code STRING, home_link STRING, wikipedia_link STRING",
    "runways": "id BIGINT, airport_ident STRING, length_ft INT, width_ft INT, surface STRING, "
               "lighted BOOLEAN, closed BOOLEAN, le_ident STRING, he_ident STRING",
    "faa_airport_detail": "location_id STRING, site_number STRING, facility_name STRING, city STRING, "
                          "state STRING, owner_name STRING, owner_phone STRING, manager_name STRING, "
                          "manager_phone STRING, based_single INT, based_multi INT, based_jet INT, "
                          "based_heli INT, based_glider INT, based_military INT, based_ultralight INT, "
                          "based_total INT",
    "aircraft_photos": "n_number STRING, has_photo BOOLEAN, photo_id STRING, thumbnail_url STRING, "
                       "page_link STRING, photographer STRING, local_path STRING, fetched_at TIMESTAMP",
    "emails": "id STRING, thread_id STRING, mailbox STRING, from_addr STRING, from_name STRING, "
              "to_addrs STRING, subject STRING, snippet STRING, body STRING, labels ARRAY<STRING>, "
              "internal_ts TIMESTAMP",
    "services": "name STRING, display_name STRING, description STRING, category STRING, "
                "interval_seconds INT, enabled BOOLEAN, status STRING, last_run_at TIMESTAMP, "
                "last_finished_at TIMESTAMP, last_duration_ms INT, last_error STRING, last_result STRING, "
                "next_run_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
    "service_runs": "id BIGINT, service STRING, started_at TIMESTAMP, finished_at TIMESTAMP, "
                    "status STRING, duration_ms INT, trigger STRING, error STRING, result STRING",
    "service_logs": "id BIGINT, ts TIMESTAMP, service STRING, run_id BIGINT, level STRING, message STRING",
    "notifications": "id BIGINT, ts TIMESTAMP, level STRING, source STRING, title STRING, body STRING, "
                     "read BOOLEAN",
}

KEYS = {
    "operators": ["certificate_designator"],
    "part135_aircraft": ["n_number", "certificate_designator"],
    "faa_registry": ["n_number"],
    "aircraft_ref": ["code"],
    "t100_segment": ["year", "month", "unique_carrier", "origin", "dest", "aircraft_type",
                     "aircraft_config", "class"],
    "aircraft_type_ref": ["code"],
    "airports": ["ident"],
    "runways": ["id"],
    "faa_airport_detail": ["location_id"],
    "aircraft_photos": ["n_number"],
    "emails": ["id"],
    "services": ["name"],
    "service_runs": ["id"],
    "service_logs": ["id"],
    "notifications": ["id"],
}

# Columns an upsert may overwrite on a key match; all others keep their stored value.
UPDATE_COLUMNS = {
    "t100_segment": ["departures", "seats", "passengers", "freight", "mail", "distance", "carrier_name"],
    "emails": ["labels", "snippet"],
    "emails_domain_wide": ["mailbox", "labels", "snippet"],
    "aircraft_photos": ["has_photo", "photo_id", "thumbnail_url", "page_link", "photographer",
                        "local_path", "fetched_at"],
    "services": ["display_name", "description", "category", "updated_at"],
}

# Tables whose blank cells become NULL on load; all others keep the empty string.
BLANK_AS_NULL = {"faa_registry", "aircraft_ref", "t100_segment", "aircraft_type_ref", "airports",
                 "runways", "faa_airport_detail"}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLE_DDL[name])


def column_names(name: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in TABLE_DDL[name].replace("(18,2)", "").split(",")]


# Landed documents.
CLOUDS = "ARRAY<STRUCT<cover: STRING, base: INT>>"
METAR_DDL = ("icaoId STRING, name STRING, obsTime BIGINT, fltCat STRING, altim DOUBLE, wdir STRING, "
             f"wspd INT, wgst INT, visib STRING, temp DOUBLE, dewp DOUBLE, clouds {CLOUDS}, rawOb STRING")
TAF_DDL = ("icaoId STRING, issueTime STRING, rawTAF STRING, fcsts ARRAY<STRUCT<timeFrom: BIGINT, "
           "timeTo: BIGINT, fcstChange: STRING, probability: INT, wdir: STRING, wspd: INT, wgst: INT, "
           f"visib: STRING, wxString: STRING, clouds: {CLOUDS}>>")
HAZARD_DDL = ("coords ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>, hazard STRING, severity STRING, "
              "validTimeTo BIGINT, altitudeLow1 INT, altitudeHi1 INT, rawAirSigmet STRING, rawSigmet STRING")
PIREP_DDL = "lat DOUBLE, lon DOUBLE, obsTime BIGINT, acType STRING, fltLvl STRING, rawOb STRING"
THUMB = "STRUCT<src: STRING>"
PHOTO_DDL = ("photos ARRAY<STRUCT<id: STRING, link: STRING, photographer: STRING, "
             f"thumbnail: {THUMB}, thumbnail_large: {THUMB}>>")
ACCOUNT_PAGE_DDL = "users ARRAY<STRUCT<primaryEmail: STRING, suspended: BOOLEAN>>, nextPageToken STRING"
