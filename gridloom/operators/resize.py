"""Resampling of images of any sizes as two weighted joins, one along each axis.

Each image's size says which part of it is taken, what size that gets and where it stands
(``geometry``); each pair of an input and an output size that occurs has one table of weights
(``taps``), and pixels meet it by pair and position. An output line or column is a weighted sum of
input ones within a filter's support, widened when shrinking. Weights are rounded to 22 bits and
results to whole values after each axis, so results are exact integers. ``nearest`` picks the pixel
at an output's middle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22


def _sinc(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(math.pi * x) / (math.pi * x))


def _cubic(x: Column) -> Column:
    x = F.abs(x)
    return F.when(x < 1, 1.5 * x * x * x - 2.5 * x * x + 1).when(x < 2, -0.5 * (x * x * x - 5 * x * x + 8 * x - 4)).otherwise(0.0)


def _hamming(x: Column) -> Column:
    return F.when(F.abs(x) < 1, _sinc(x) * (0.54 + 0.46 * F.cos(math.pi * x))).otherwise(0.0)


#: Filters: half width and shape.
FILTERS: dict[str, tuple[float, Callable[[Column], Column]]] = {
    "box": (0.5, lambda x: F.when((x > -0.5) & (x <= 0.5), 1.0).otherwise(0.0)),
    "bilinear": (1.0, lambda x: F.greatest(F.lit(0.0), 1 - F.abs(x))),
    "hamming": (1.0, _hamming),
    "bicubic": (2.0, _cubic),
    "lanczos": (3.0, lambda x: F.when(F.abs(x) < 3, _sinc(x) * _sinc(x / 3)).otherwise(0.0)),
}


def taps(pairs: DataFrame, name: str) -> DataFrame:
    """Weights of all resamplings of ``pairs(size, to)``: size, to, o, i, w, where output o gets w / 2^22 of
    input i. One row makes its own weights, so nothing is shuffled."""
    t = pairs.withColumn("scale", F.col("size").cast("double") / F.col("to")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("to") - 1)))
    middle = (F.col("o") + 0.5) * F.col("scale")
    if name == "nearest":
        return t.select("size", "to", "o", F.least(F.col("size") - 1, F.floor(middle)).cast("int").alias("i"), F.lit(1 << BITS).cast("long").alias("w"))
    half, shape = FILTERS[name]
    t = t.withColumn("wide", F.greatest(F.col("scale"), F.lit(1.0))).withColumn("middle", middle)
    edge = lambda sign: F.floor(F.col("middle") + sign * half * F.col("wide") + 0.5).cast("int")
    t = t.withColumn("lo", F.greatest(F.lit(0), edge(-1))).withColumn("hi", F.least(F.col("size"), edge(1)))
    t = t.withColumn("v", F.transform(F.sequence(F.col("lo"), F.col("hi") - 1), lambda i: shape((i - F.col("middle") + 0.5) / F.col("wide")).cast("double")))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    t = t.withColumn("total", F.when(total == 0, 1.0).otherwise(total)).select("size", "to", "o", "lo", "total", F.posexplode("v").alias("k", "v"))
    w = F.signum("v") * F.floor(F.abs(F.col("v") / F.col("total")) * (1 << BITS) + 0.5)
    return t.select("size", "to", "o", (F.col("lo") + F.col("k")).alias("i"), w.cast("long").alias("w")).filter("w <> 0")


def geometry(sizes: DataFrame, to: tuple[int, int], fit: str = "stretch", aspect: float = 4 / 3) -> DataFrame:
    """Beside ``sizes(width, height)``: the part taken (x0, y0, w, h), the size it gets (iw, ih), and where
    it stands in the target (ox, oy). ``cover`` cuts the middle out, ``fit`` leaves room at two sides;
    roundings are half to even."""
    width, height, (tw, th) = F.col("width"), F.col("height"), to
    whole = lambda c: F.rint(c).cast("int")
    own = width.cast("double") / height
    w, h, iw, ih = width, height, F.lit(tw), F.lit(th)
    if fit == "cover":
        w = F.when(own > aspect, whole(height * F.lit(float(aspect)))).otherwise(width)
        h = F.when(own > aspect, height).otherwise(whole(width / F.lit(float(aspect))))
    elif fit == "fit":
        pixel = F.lit(aspect * th / tw)  # a target pixel's own width over height
        tall = whole(F.lit(tw) * pixel / own) > th
        within = lambda c, most: F.greatest(F.lit(1), F.least(F.lit(most), c))
        iw = within(F.when(tall, whole(F.lit(th) * own / pixel)).otherwise(F.lit(tw)), tw)
        ih = within(F.when(tall, F.lit(th)).otherwise(whole(F.lit(tw) * pixel / own)), th)
    g = sizes.withColumns({"w": F.greatest(F.lit(1), w), "h": F.greatest(F.lit(1), h), "iw": iw, "ih": ih})
    half = lambda c: F.floor(c / 2).cast("int")
    return g.withColumns({"x0": half(F.col("width") - F.col("w")), "y0": half(F.col("height") - F.col("h")), "ox": half(tw - F.col("iw")), "oy": half(th - F.col("ih"))})


def sizes_of(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def resize(px: DataFrame, to: tuple[int, int], name: str = "lanczos", fit: str = "stretch", aspect: float = 4 / 3) -> DataFrame:
    """Pixels px(image_id, y, x, r, g, b) of images of any sizes, at the size ``to``: with transparent,
    true of the padding that ``fit`` leaves, which is black. Values are 0 to 255."""
    plan = geometry(sizes_of(px), to, fit, aspect)
    p = px.select("image_id", "y", "x", "r", "g", "b").join(plan, "image_id")
    p = p.withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).filter("x >= 0 and x < w and y >= 0 and y < h")
    sums = [F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(F.sum(F.col(c) * F.col("weight")) + (1 << BITS - 1), BITS))).cast("int").alias(c) for c in "rgb"]
    keep = ["image_id", "w", "h", "iw", "ih", "ox", "oy"]
    for axis, size, inner, other in (("x", "w", "iw", "y"), ("y", "h", "ih", "x")):
        t = taps(plan.select(F.col(size).alias("size"), F.col(inner).alias("to")).distinct(), name)
        t = t.select(F.col("size").alias(size), F.col("to").alias(inner), F.col("i").alias(axis), "o", F.col("w").alias("weight"))
        p = p.join(t, [size, inner, axis]).groupBy(*keep, F.col("o").alias("at"), other).agg(*sums).withColumnRenamed("at", axis)
    p = p.select("image_id", (F.col("y") + F.col("oy")).cast("int").alias("y"), (F.col("x") + F.col("ox")).cast("int").alias("x"), "r", "g", "b", F.lit(False).alias("transparent"))
    if fit != "fit":
        return p
    spots = plan.filter((F.col("iw") < to[0]) | (F.col("ih") < to[1])).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(to[1] - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(to[0] - 1))))
    spots = spots.filter("y < oy or y >= oy + ih or x < ox or x >= ox + iw")
    return p.unionByName(spots.select("image_id", "y", "x", *[F.lit(0).alias(c) for c in "rgb"], F.lit(True).alias("transparent")))
