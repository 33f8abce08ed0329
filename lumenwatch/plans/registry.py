"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import behaviour, context, detection, enrich, ingest, published, reports, run, stream, tenants

MODULES = [behaviour, detection, context, enrich, ingest, published, reports, run, stream, tenants]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.behaviour_findings(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for module in MODULES for f in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
