"""What the operators on vectors share: scaling to integers, Arrow columns as matrices, exact products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side

#: Integers below this are exact in doubles, and so are sums and products that stay below it.
BIG = 2.0**53
MOST, LEAST = 2**63 - 1, -(2**63)


def scaled(rows: DataFrame, scale: float, keep: list[str]) -> DataFrame:
    """``keep``, vec_id (long) and ``v``: each component x of ``embedding`` as floor(scale * x), in doubles.

    Vectors null or empty, or with a component that is null or whose scaled value isn't finite, are
    left out. All other columns are ignored."""
    cols = [F.col(c) for c in keep if c != "vec_id"]
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), *cols, F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(f"size(v) > 0 and forall(v, x -> x is not null and abs(x * {float(scale)}D) < double('infinity'))")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.get_field_index("v")
            v = b.column(at)
            whole = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False))
            edge = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.ListArray.from_arrays(edge, pa.array(whole))], b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def whole(x: np.ndarray) -> np.ndarray:
    """The same integers without bound."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row i of ``a`` with row i of ``b``, exact; beyond 64 bits, the nearest number of 64 bits."""
    if not len(a) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < BIG:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([max(LEAST, min(MOST, int(s))) for s in (whole(a) * whole(b)).sum(1)], np.int64)


def grid(asked: DataFrame, rows: DataFrame, keys: list[str], kernel, schema: str, block: int, size: int) -> DataFrame:
    """``kernel`` on every group of about ``block`` rows of ``asked`` with every group of about ``size`` of
    ``rows`` of equal ``keys``, all groups side by side. Group numbers come from the rows' numbers in
    their files (both are written tables), so repeated or hot values spread as others do."""
    n = materialize(rows.groupBy(keys).agg(F.count("*").alias("n")).join(asked.groupBy(keys).agg(F.count("*").alias("m")), keys))
    n = small_side(n.select(*keys, F.ceil(F.col("n") / size).alias("n"), F.ceil(F.col("m") / block).alias("m")))
    at = F.monotonically_increasing_id()
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = asked.withColumn("at", at).join(n, keys).withColumn("a", F.pmod("at", "m")).withColumn("b", all_of("n")).drop("n", "m", "at")
    right = rows.withColumn("at", at).join(n, keys).withColumn("b", F.pmod("at", "n")).withColumn("a", all_of("m")).drop("n", "m", "at")
    by = [*keys, "a", "b"]
    left = left.toDF(*left.columns)  # columns of its own, as both may come from one table
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(kernel, schema)


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each ``by``, of at most k rows a group of the grid, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
