"""The registered queries over the test tables, each beside its SQL twin."""

from __future__ import annotations

import importlib

from skyspine.workload.registry import QUERIES, SQL

FAMILIES = ["fleet", "routes", "airports", "cleaning", "jobs", "loads", "weather", "mail"]


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"skyspine.workload.{family}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)
