"""Connected components of bipartite (cell, colour) edges, keyed by image."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """Like ``cut``, as packed columns in Parquet files: a fraction of a checkpoint's bytes, which are whole rows."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/gridloom/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; in a session of one process that names none, in its warehouse."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or df.sparkSession.conf.get("spark.sql.warehouse.dir"))
    return df.checkpoint()


def colour_components(cells: DataFrame) -> DataFrame:
    """(image_id, cid, comp) from cells(image_id, y, cx, cid): colours that share a cell,
    directly or through others, get the least cid among them. Labels spread over cells and
    then jump to their label's label, until none changes; an image's colours bound the rounds."""
    edges = cut(cells.select("image_id", "y", "cx", "cid").distinct())
    lab = cut(edges.select("image_id", "cid", F.col("cid").alias("comp"), F.lit(True).alias("moved")).distinct())
    while True:
        low = edges.join(lab.select("image_id", "cid", "comp"), ["image_id", "cid"]).groupBy("image_id", "y", "cx").agg(F.min("comp").alias("low"))
        near = edges.join(low, ["image_id", "y", "cx"]).groupBy("image_id", "cid").agg(F.min("low").alias("near"))
        jump = near.select("image_id", F.col("cid").alias("near"), F.col("near").alias("jump"))
        new = near.join(jump, ["image_id", "near"]).select("image_id", "cid", F.least("near", "jump").alias("new"))
        lab = cut(new.join(lab.select("image_id", "cid", "comp"), ["image_id", "cid"]).select("image_id", "cid", F.col("new").alias("comp"), (F.col("new") != F.col("comp")).alias("moved")))
        if not lab.filter("moved").head(1):
            return lab.select("image_id", "cid", "comp")


def best_fit(sizes: DataFrame, bins: int = 4, cap: int = 255) -> DataFrame:
    """(image_id, comp, size, palette) by best-fit decreasing, as a fold in SQL over each
    image's sorted components; palette is null in images that don't fit."""
    items = sizes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("neg"), "comp"))).alias("items"))
    folded = items.withColumn(
        "f",
        F.expr(f"""aggregate(items, struct(array_repeat(0, {bins}) as fill, cast(array() as array<int>) as got, true as ok),
          (acc, it) -> (
            transform(array(array_max(filter(transform(acc.fill, (v, b) -> struct(v as v, -b as nb)), s -> s.v - it.neg <= {cap}))), best ->
              struct(transform(acc.fill, (v, b) -> if(b = -best.nb, cast(v - it.neg as int), v)) as fill,
                     array_append(acc.got, -best.nb) as got, acc.ok and best is not null as ok))[0]))"""),
    )
    x = folded.select("image_id", "f", F.posexplode("items").alias("i", "it"))
    return x.select("image_id", F.col("it.comp").alias("comp"), (-F.col("it.neg")).cast("int").alias("size"), F.when(F.col("f.ok"), F.get(F.col("f.got"), F.col("i"))).alias("palette"))
