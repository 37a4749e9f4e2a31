"""Exact nearest neighbours among colours as equi-joins on cubes instead of all pairs.

Colours fall into cubes of a side. An entry is copied to the 27 cubes around its own, so a colour
meets the entries of its block of 3 x 3 x 3 cubes in one equi-join. Whatever lies outside that block is
at least the side plus the distance to the colour's own cube's nearest face away: where the nearest
entry met is closer, it is the answer. What is left, few colours far from all entries, goes on to
cubes of twice the side, until one block holds everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import written

#: Entries that a colour should meet in its first block, about.
MEET = 3
#: Most entries that go to every task, in lists by cube (27 places for each).
FEW = 8192


def first_side(entries: int, span: int) -> int:
    """The power of two for which a block of cubes holds about ``MEET`` of so many entries spread evenly."""
    side = span / 3 * (MEET / max(entries, 1)) ** (1 / 3)
    return 1 << max(0, min(round(math.log2(max(side, 1))), max(span - 1, 1).bit_length()))


def _cube(c: str, side: int) -> Column:
    return F.floor(F.col(c) / side).cast("int")


def nearest(points: DataFrame, entries: DataFrame, key: str, ids: list[str], span: int = 256, side: int | None = None, distinct: bool = False) -> DataFrame:
    """The nearest of ``entries(key, slot, r, g, b)`` of each of ``points(key, *ids, r, g, b)``, of integers from 0
    to ``span`` - 1, ties to the lowest slot: key, ids, r, g, b, slot, d2, and met, how many entries were looked at.

    Points of a key without entries are left out, as in a join; repeated points each give a row if
    their ids differ (``distinct`` says that none are repeated, so none are looked for). ``side`` of the first
    cubes follows from the most entries of a key by default. Up to ``FEW`` entries are sent to where the
    points are, as lists by cube, so points move no more; more of them meet the points in a shuffle."""
    held = entries.groupBy(key).agg(F.count("*").alias("n"))
    most, total = held.agg(F.max("n"), F.sum("n")).head()
    few = (total or 0) <= FEW
    side = first_side(most or 1, span) if side is None else side
    keys = held.select(key)
    left = points.select(key, *ids, "r", "g", "b").join(F.broadcast(keys) if few else keys, key, "left_semi")
    if not distinct and few:
        left = left.distinct()
    left = left.withColumn("before", F.lit(0).cast("long"))
    out = None
    while True:
        last = 2 * side >= span  # the block of any cube holds all colours
        around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        e = entries.select(key, "slot", *[F.col(c).alias(f"e{c}") for c in "rgb"], *[_cube(c, side).alias(f"c{c}") for c in "rgb"])
        for c in "rgb":
            e = e.withColumn("step", around).withColumn(f"c{c}", F.col(f"c{c}") + F.col("step")).drop("step")
        p = left.select("*", *[_cube(c, side).alias(f"c{c}") for c in "rgb"])
        cube = [key, "cr", "cg", "cb"]
        if few:
            lists = e.groupBy(*cube).agg(F.collect_list(F.struct("slot", "er", "eg", "eb")).alias("list"))
            gap = lambda x: sum((F.col(c) - x[f"e{c}"]) * (F.col(c) - x[f"e{c}"]) for c in "rgb")
            best = F.array_min(F.transform("list", lambda x: F.struct(gap(x).alias("d2"), x["slot"].alias("slot"))))
            found = p.join(F.broadcast(lists), cube, "left").select(key, *ids, "r", "g", "b", "before", best.alias("best"), F.coalesce(F.size("list"), F.lit(0)).alias("n"))
        else:
            d2 = sum((F.col(c) - F.col(f"e{c}")) * (F.col(c) - F.col(f"e{c}")) for c in "rgb")
            pair = F.when(F.col("slot").isNotNull(), F.struct(d2.alias("d2"), F.col("slot")))
            found = p.join(e, cube, "left").groupBy(key, *ids, "r", "g", "b", "before").agg(F.min(pair).alias("best"), F.count("slot").alias("n"))
        face = [F.least(F.col(c) % side + 1, side - F.col(c) % side) for c in "rgb"]
        bound = F.least(*face) + side
        sure = F.lit(True) if last else F.coalesce(F.col("best.d2") < bound * bound, F.lit(False))
        met = F.col("before") + F.greatest("n", F.lit(0))
        found = written(found.select(key, *ids, "r", "g", "b", "best", sure.alias("sure"), met.alias("before")))
        done = found.filter("sure").select(key, *ids, "r", "g", "b", F.col("best.slot").alias("slot"), F.col("best.d2").alias("d2"), F.col("before").alias("met"))
        out = done if out is None else out.unionByName(done)
        left = found.filter(~F.col("sure")).select(key, *ids, "r", "g", "b", "before")
        if last or not left.head(1):
            return out
        side *= 2
