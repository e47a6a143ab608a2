"""Named queries over the given tables, each with the SQL another engine answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans.bindings import Tables, oracle_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Blanks for RE2, as marginalia.functions.text.BLANK has them for Java.
BL = "\\t\\n\\x0B\\f\\r \\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"


def trimmed_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[{BL}]+', ''), '[{BL}]+$', '')"


def query(name: str, inputs: str = "", ctes: str = "", sql: str = ""):
    """Register ``fn(tables)`` as a query; ``sql`` may read the derived ``inputs`` and the extra ``ctes``."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            parts = [p for p in (oracle_ctes(inputs.split()) if inputs else "", ctes) if p.strip()]
            ORACLES[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from marginalia.plans import queries_catalog, queries_notes, queries_pages, queries_runs  # noqa: F401
