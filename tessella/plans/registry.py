"""All registered queries. Each plan module has QUERIES and SQL, keyed alike."""

from __future__ import annotations

from importlib import import_module

MODULES = ("evaluation", "algebra", "rollouts", "texts", "intake", "corpora", "functions", "mathematics", "records", "eventtime", "estimates", "growth", "plugins")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tessella.plans.{name}"), attribute)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
