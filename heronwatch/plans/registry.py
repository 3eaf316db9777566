"""Every registered query with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, early_warning, files, intake, listening, people, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**people.QUERIES, **early_warning.QUERIES, **audits.QUERIES, **intake.QUERIES, **listening.QUERIES, **files.QUERIES, **vectors.QUERIES}
SQL: dict[str, str] = {**people.SQL, **early_warning.SQL, **audits.SQL, **intake.SQL, **listening.SQL, **files.SQL, **vectors.SQL}
