"""The registry of the grid engine's queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog, conversion, images, records, scaling, sql, texts

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of colours that share cells, packed into four palettes per image."""
    return images.phase_a_palettes(spark, sf_dir)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: partial(lambda spark, sf_dir, n: sql.run(spark, sf_dir, n), n=name) for name in sql.QUERIES}
    return out | images.QUERIES | {name: partial(lambda spark, sf_dir, n: catalog.run(spark, sf_dir, n), n=name) for name in catalog.SQL} | catalog.QUERIES | conversion.QUERIES | scaling.QUERIES | records.QUERIES | texts.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: sql.oracle(name) for name in sql.QUERIES} | images.ORACLE | {name: q[1] for name, q in catalog.SQL.items()} | conversion.ORACLE | scaling.ORACLE | records.ORACLE | texts.ORACLE
