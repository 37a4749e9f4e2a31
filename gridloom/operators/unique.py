"""Names made unique in order, for all rows of a table at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from .components import cut
from .order import numbered

LENGTH = 8
#: Sizes of blocks of counters that a row jumps over when earlier rows want all of a block.
BLOCKS = (10, 100, 1000)
#: Most rows of one folder whose names begin alike that are named in one task.
SMALL = 50_000
GROUP = ["f", "digits", "prefix"]


def _first(digits: Column) -> Column:
    return F.when(digits == 0, 0).when(digits == 2, 1).otherwise(F.pow(F.lit(10), digits - 1)).cast("long")


def _last(digits: Column) -> Column:
    return F.when(digits == 0, 0).otherwise(F.pow(F.lit(10), digits) - 1).cast("long")


def _wanted(rows: DataFrame) -> DataFrame:
    """Adds ``want``: counters of a group's rows grow with ``at`` and aren't below any row's ``low``.

    That is a place in the group plus a running maximum. Both are worked out in ranges of the order
    and carried over the ranges, so a hot group is as many tasks as it fills ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that ranges don't change between the sums and what reads them
    s = cut(rows.repartitionByRange(n, *GROUP, "at").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part", *GROUP).orderBy("at")
    s = s.withColumn("place", F.row_number().over(here) - 1).withColumn("run", F.max(F.col("low") - F.col("place")).over(here))
    before = Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    t = s.groupBy("part", *GROUP).agg(F.count("*").alias("n"), F.max("run").alias("most"))
    t = t.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("top", F.max(F.col("most") - F.col("before")).over(before))
    s = s.join(t.drop("n", "most"), ["part", *GROUP])
    want = F.col("before") + F.col("place") + F.greatest("top", F.col("run") - F.col("before"))
    return s.select("f", "base", "at", "digits", "prefix", want.alias("want"))


def _held_blocks(held: DataFrame) -> DataFrame:
    """Of held(f, name, h) the blocks of counters (f, digits, prefix, size, block, h) of which every name
    is wanted; h is the last of the rows that want them first."""
    as_counter = []
    for d in range(2, LENGTH):
        tail = F.expr(f"right(name, {d})")
        fits = F.col("name").rlike(f"^.+[0-9]{{{d}}}$") & (tail != "00" if d == 2 else ~tail.startswith("0"))
        as_counter.append(F.when(fits, F.struct(F.lit(d).alias("digits"), F.expr(f"left(name, length(name) - {d})").alias("prefix"), tail.cast("long").alias("c"))))
    c = held.select("f", "h", F.explode(F.array_compact(F.array(*as_counter))).alias("x")).select("f", "h", "x.*")
    c = c.withColumn("size", F.explode(F.array(*[F.lit(x) for x in BLOCKS]))).filter((F.col("size") <= F.pow(F.lit(10), F.col("digits") - 1)) | ((F.col("digits") == 2) & (F.col("size") == 100)))
    b = c.groupBy(*GROUP, "size", F.floor(F.col("c") / F.col("size")).alias("block")).agg(F.count("*").alias("n"), F.max("h").alias("h"))
    full = F.col("size") - F.when((F.col("digits") == 2) & (F.col("block") == 0), 1).otherwise(0)
    return b.filter(F.col("n") == full).drop("n")


def _row_by_row(pdf: pd.DataFrame) -> pd.DataFrame:
    taken: set[str] = set()
    last: dict[str, int] = {}
    pdf = pdf.sort_values("at")
    out: list[str] = []
    for short in pdf["base"]:
        out.append(N.unique_name(short, taken, last))
        taken.add(out[-1])
    return pdf[["at"]].assign(name=out)


def unique_names(df: DataFrame, folder: list[str], short: str, by: list[str | Column], name: str = "unique_name", small: int = SMALL) -> DataFrame:
    """``df`` with ``name``: in the order of ``by`` each row takes its ``short`` (1 to 8 characters) if no earlier
    row of its folder has it, else the first free one of 01, 02, ... 99, 100, ... over the end of it.

    No name changes its first character, so rows of a folder whose names begin alike are apart from all
    others: up to ``small`` of them are named in one task, more of them by ``_in_rounds``. Rows equal in
    ``by`` come in any order; null folders are one folder; a null ``short`` gives a null name and takes
    none; an empty table gives none. More rows than there are names is an error.
    """
    at = numbered(df, by, f"{name}_at")
    f = F.to_json(F.struct(*folder)) if folder else F.lit("")
    s = at.filter(F.col(short).isNotNull()).select(f.alias("f"), F.col(short).alias("base"), F.col(f"{name}_at").alias("at"), F.substring(short, 1, 1).alias("letter"))
    hot = cut(s.groupBy("f", "letter").count().filter(F.col("count") > small))
    named = s.join(hot, ["f", "letter"], "left_anti").groupBy("f", "letter").applyInPandas(_row_by_row, "at long, name string")
    if hot.head(1):
        named = named.unionByName(_in_rounds(s.join(hot, ["f", "letter"], "left_semi").drop("letter")))
    return at.join(named.select(F.col("at").alias(f"{name}_at"), F.col("name").alias(name)), f"{name}_at", "left").drop(f"{name}_at")


def _in_rounds(rows: DataFrame) -> DataFrame:
    """Names (at, name) of rows(f, base, at) without a task that sees all of a group.

    Every row has a list of names and the earlier of two rows goes first, so the row by row result is also
    the one stable matching of rows and names, which rounds over all rows find: each wants the first name
    that isn't known to go to an earlier row, and of those that want one name the earliest keeps it. Rows
    whose names have the same counters behind the same characters want them by place, so that thousands of
    one name take a round for each number of digits. Rounds grow with the longest chain of rows that push each
    other from generated names into others', not with rows; names that end in digits, all close together,
    make long chains. Only whether any row moved passes through the driver.
    """
    s = rows.withColumn("digits", F.lit(0)).withColumn("low", F.lit(0).cast("long"))
    while True:
        w = _wanted(s.withColumn("prefix", F.expr(f"substring(base, 1, {LENGTH} - digits)"))).withColumn("over", F.col("want") > _last(F.col("digits")))
        count = F.col("want").cast("string")
        text = F.when(F.col("digits") == 0, F.col("base")).otherwise(F.concat("prefix", F.when(F.col("digits") == 2, F.lpad(count, 2, "0")).otherwise(count)))
        # rows past a group's last counter want no name yet: each a key of its own, longer than names are
        key = F.when(F.col("over"), F.concat(F.lit("/" * LENGTH), F.col("at").cast("string"))).otherwise(text)
        w = cut(w.withColumn("name", key).withColumn("h", F.min("at").over(Window.partitionBy("f", "name"))))
        late = F.col("h") < F.col("at")
        state = w.agg(F.max(F.col("over") | late).alias("moved"), F.max(F.when(F.col("over"), F.col("digits"))).alias("digits")).head()
        if (state.digits or 0) >= LENGTH - 1:
            raise ValueError(f"no name of {LENGTH} characters is left")
        if not state.moved:
            return w.select("at", "name")
        lost = w.filter(late).withColumn("size", F.explode(F.array(*[F.lit(x) for x in BLOCKS])))
        blocks = _held_blocks(w.filter(~F.col("over") & ~late).select("f", "name", "h")).withColumnRenamed("h", "by_all")
        lost = lost.withColumn("block", F.floor(F.col("want") / F.col("size"))).join(blocks, [*GROUP, "size", "block"]).filter("by_all < at")
        jump = lost.groupBy("at").agg(F.max((F.col("block") + 1) * F.col("size")).alias("jump"))
        more = F.when(F.col("digits") == 0, 2).otherwise(F.col("digits") + 1)
        digits = F.when(F.col("over"), more).otherwise(F.col("digits"))
        low = F.when(F.col("over"), _first(more)).when(late, F.greatest(F.col("want") + 1, "jump")).otherwise(F.col("want"))
        s = w.join(jump, "at", "left").select("f", "base", "at", digits.alias("digits"), low.alias("low"))
