"""Registered queries, each with DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reportmill.catalogue import made, natural, rendered, replayed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**natural.QUERIES, **rendered.QUERIES, **made.QUERIES, **replayed.QUERIES}
SQL: dict[str, str] = {**natural.SQL, **rendered.SQL, **made.SQL, **replayed.SQL}
