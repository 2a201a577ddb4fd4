"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, detection, records, relations, sessions, signals, streams

ENTRIES = {**detection.ENTRIES, **relations.ENTRIES, **sessions.ENTRIES, **checks.ENTRIES, **streams.ENTRIES, **records.ENTRIES, **signals.ENTRIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry[0] for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry[1] for name, entry in ENTRIES.items() if entry[1]}
