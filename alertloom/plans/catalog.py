"""Registered queries and their oracles, by name: ``fn(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertloom.plans import curation, labelling, reports, rules, scoring

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**reports.QUERIES, **rules.QUERIES, **labelling.QUERIES, **scoring.QUERIES, **curation.QUERIES}
ORACLES: dict[str, str] = {**reports.ORACLES, **rules.ORACLES, **labelling.ORACLES, **scoring.ORACLES, **curation.ORACLES}
