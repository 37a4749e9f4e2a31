"""Weighted median cut of all images' colours at once, as windows over the boxes of a level.

Cutting best first takes the widest box each time, the one made first among equals. A part is never
wider than the box it came from, so boxes are cut in the order of their widths, and which k - 1 are
cut can be told from the tree of all cuts: its k - 1 first nodes by width, then by what decides who
was made first, the same order of the boxes they came from, and the lower part before the upper. So
a level's boxes are all cut in one window, those that already k - 1 nodes come before aren't cut
further, and the final order says at which box each colour's path ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import cut


def median_cut(colours: DataFrame, k: int) -> DataFrame:
    """(image_id, cid, entry, r, g, b): each colour of ``colours(image_id, cid, r, g, b, n)`` with one of at most
    ``k`` entries of its image and that entry's mean colour, rounded half to even.

    A box is cut along its widest channel (the first of equals), where the running count in that
    channel's order reaches half; n counts at least 1."""
    rows = colours.select("image_id", "cid", "r", "g", "b", F.greatest(F.lit(1), "n").cast("long").alias("n"))
    rows = rows.select("*", F.lit("").alias("path"), F.row_number().over(Window.partitionBy("image_id").orderBy("cid")).alias("place"), F.array().cast("array<int>").alias("above"))
    first, splits, ended = None, None, []
    while True:
        level = cut(_level(rows))
        first = first if first is not None else level
        splits = cut(_splits(level, splits, k))
        ended.append(level.join(splits, ["image_id", "path"], "left_anti").select("image_id", "cid", "path"))
        on = level.join(splits.select("image_id", "path"), ["image_id", "path"])
        rows = on.select("image_id", "cid", "r", "g", "b", "n", F.concat("path", "side").alias("path"), "place", F.col("widths").alias("above"))
        if not rows.head(1):
            break
    paths = reduce(DataFrame.unionByName, ended)  # of every colour, as far as it was followed
    boxes = _boxes(splits, first)
    at = paths.withColumn("box", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))))
    at = at.join(boxes, ["image_id", "box"]).select("image_id", "cid", "entry").join(colours.select("image_id", "cid", "r", "g", "b", F.greatest(F.lit(1), "n").alias("n")), ["image_id", "cid"])
    own = Window.partitionBy("image_id", "entry")
    mean = [F.bround(F.sum(F.col(c) * F.col("n")).over(own) / F.sum("n").over(own), 0).cast("int").alias(c) for c in "rgb"]
    return at.select("image_id", "cid", "entry", *mean)


def _level(rows: DataFrame) -> DataFrame:
    """Rows of the boxes of a level with their box's width, widths up to the root, and the side of its cut."""
    box = Window.partitionBy("image_id", "path")
    wide = [F.max(c).over(box) - F.min(c).over(box) for c in "rgb"]
    rows = rows.withColumns({"wr": wide[0], "wg": wide[1], "wb": wide[2], "size": F.count("*").over(box), "total": F.sum("n").over(box)})
    rows = rows.withColumn("width", F.greatest("wr", "wg", "wb"))
    value = F.when(F.col("wr") == F.col("width"), F.col("r")).when(F.col("wg") == F.col("width"), F.col("g")).otherwise(F.col("b"))
    rows = rows.withColumn("value", value)
    line = box.orderBy("value", "place")
    rows = rows.withColumns({"at": F.row_number().over(line), "run": F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0))})
    lower = (F.col("at") == 1) | ((2 * F.col("run") < F.col("total")) & (F.col("at") < F.col("size")))
    widths = F.concat(F.array("width"), "above").alias("widths")
    return rows.select("image_id", "cid", "r", "g", "b", "n", "path", F.col("at").alias("place"), "width", widths, F.when(lower, "0").otherwise("1").alias("side"))


def _splits(level: DataFrame, before: DataFrame | None, k: int) -> DataFrame:
    """(image_id, path, widths, rank) of the boxes that are cut, as far as this level and those ``before`` it
    tell, in the order of cuts. What has left the first k - 1 doesn't come back: deeper boxes only add."""
    nodes = level.filter("place = 1 and width > 0").select("image_id", "path", "widths")
    nodes = nodes if before is None else nodes.unionByName(before.select("image_id", "path", "widths"))
    # widths from the box up to the root; a root ends its list, before any further width
    first = F.concat(F.transform("widths", lambda w: -w), F.array(F.lit(-(2**31)).cast("int")))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(first, "path"))
    return nodes.withColumn("rank", rank).filter(F.col("rank") < k)


def _boxes(splits: DataFrame, root: DataFrame) -> DataFrame:
    """(image_id, box, entry): parts of cut boxes that aren't cut themselves, in the order they were made."""
    made = splits.select("image_id", F.explode(F.array(*[F.concat("path", F.lit(s)) for s in "01"])).alias("box"), "rank")
    made = made.unionByName(root.filter("place = 1").select("image_id", F.lit("").alias("box"), F.lit(0).alias("rank")))
    made = made.join(splits.select("image_id", F.col("path").alias("box")), ["image_id", "box"], "left_anti")
    entry = F.row_number().over(Window.partitionBy("image_id").orderBy("rank", "box")) - 1
    return made.select("image_id", "box", entry.alias("entry"))
