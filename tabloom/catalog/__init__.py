"""Registered queries: each name maps to a Spark job over the given tables and,
where SQL can say the same, to the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "relational", "cohorts", "encoders", "tables", "fidelity", "privacy", "runs",
    "generators", "synthesis", "files", "streams",
)


def load_all():
    """Import every catalog module and return (queries, oracle_sql)."""
    from . import base

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(base.QUERIES), dict(base.ORACLES)
