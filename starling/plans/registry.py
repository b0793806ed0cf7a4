"""Imports every query module so that the catalog is complete, then exposes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starling.plans import catalog
from starling.plans import queries_eval  # noqa: F401  (registers queries)
from starling.plans import queries_decode  # noqa: F401
from starling.plans import queries_prep  # noqa: F401
from starling.plans import queries_stats  # noqa: F401
from starling.plans import queries_select  # noqa: F401
from starling.plans import queries_learn  # noqa: F401


def queries():
    return dict(catalog.QUERIES)


def oracle_sql():
    return dict(catalog.ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["leaderboard"](spark, sf_dir)
