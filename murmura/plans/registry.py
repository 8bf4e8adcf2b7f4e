"""All queries of the library by name."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a callable of (spark, sf_dir), with the SQL that checks it."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    from murmura.plans import analytics, files, formulas, models, selections  # noqa: F401  their queries register themselves


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
