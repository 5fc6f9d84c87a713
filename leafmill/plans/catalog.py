"""The catalog of queries on the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import files, runs, tables, texts

FLAGSHIP = "greedy_pack_1200"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**texts.QUERIES, **tables.QUERIES, **files.QUERIES, **runs.QUERIES}
ORACLES: dict[str, str] = {**texts.ORACLES, **tables.ORACLES, **files.ORACLES, **runs.ORACLES}
