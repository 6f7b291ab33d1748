"""Named queries and the SQL that says the same."""

from importlib import import_module

MODULES = ("problems", "catalogue", "graphs")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").QUERIES
    return out


def oracle_sql() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").SQL
    return out
