"""Positions in one order of a whole table, without a task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import cut


def numbered(df: DataFrame, by: list[str | Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place, from 1, in the order of ``by``: ranges of that order are dealt to tasks
    and sorted there, and a row's place is its place in its range after the rows of all ranges before.

    The order must be total for places to be the same in each run; rows that are equal in ``by`` stand
    in one range, in any order. Only the ranges' row counts pass through the driver."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that ranges don't change between the count and what reads it
    at = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(f"{name}_at", F.monotonically_increasing_id()))
    part = F.shiftright(f"{name}_at", 33)
    counts = dict(at.groupBy(part.alias("part")).count().collect())
    before = dict(zip(range(n), accumulate((counts.get(i, 0) for i in range(n)), initial=0), strict=False))
    starts = spark.createDataFrame([(i, before[i]) for i in sorted(counts)], f"{name}_part long, {name}_before long")
    place = F.col(f"{name}_before") + F.col(f"{name}_at").bitwiseAND((1 << 33) - 1) + 1
    return at.withColumn(f"{name}_part", part).join(F.broadcast(starts), f"{name}_part").withColumn(name, place).drop(f"{name}_part", f"{name}_at", f"{name}_before")
