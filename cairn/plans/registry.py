"""Names, queries and SQL of the conditions engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import INPUTS, Tables, sql_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under its name, with the SQL of the same rows.

    Inputs are named in the SQL by a dollar sign: ``$daily``.
    """

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = re.sub(r"\$(\w+)", lambda m: sql_of(m[1]) if m[1] in INPUTS else m[0], sql).strip()
        return f

    return register


def _load() -> None:
    from . import conditions, evidence, feeds, forecasts, gazetteer, landing, layers, lists, official, places, rules, sequences, shapes, snowfall, texts, verdicts, watches  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each place at each date, fused from all kinds of evidence."""
    return queries()["fused_status"](spark, sf_dir)
