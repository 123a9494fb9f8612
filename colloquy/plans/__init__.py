"""Declared plans, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..dialect import DUCK, SPARK
from ..domain import statement, with_relations
from . import analytics, library, search


def catalog() -> dict[str, Callable]:
    return {**library.PLANS, **search.PLANS, **analytics.PLANS}


def run(spark: SparkSession, source: str | dict[str, DataFrame], name: str, **parameters) -> DataFrame:
    """A plan over the driver's tables (a folder), or over relations that are handed in by name."""
    return statement(spark, source, catalog()[name](SPARK, **parameters))


def oracle(name: str, **parameters) -> str:
    """The same plan for an ANSI engine, in one statement."""
    return with_relations(DUCK, catalog()[name](DUCK, **parameters))
