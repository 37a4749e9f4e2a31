"""Grids of pixels as rows (image_id, y, x, r, g, b, transparent)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an image in the grid view of a vector table, its pixels per row and pixels per cell.
HEIGHT, WIDTH, CELL = 40, 21, 8


def vector_grid(spark: SparkSession, sf_dir: str, levels: int = 64, height: int = HEIGHT) -> DataFrame:
    """Grid view of ``embeddings``: ``height`` vectors an image, three components a pixel, quantised.

    The first four lines of an image count as padding (transparent).
    """
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    e = e.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))

    def channel(k: int):
        v = F.get(F.col("embedding"), 3 * F.col("x") + k).cast("double")
        return F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.floor((v + 0.55) * levels / 1.1).cast("int")))

    return e.select(
        F.expr(f"cast(vec_id div {height} as int)").alias("image_id"),
        F.expr(f"cast(vec_id % {height} as int)").alias("y"),
        "x",
        *[channel(k).alias(c) for k, c in enumerate("rgb")],
        F.expr(f"vec_id % {height} < 4").alias("transparent"),
    )


def vector_grid_sql(levels: int = 64, height: int = HEIGHT) -> str:
    """The same view for an SQL engine with 1-based arrays."""
    ch = ", ".join(
        f"least({levels - 1}, greatest(0, cast(floor((cast(embedding[3*x+{k}] as double)+cast(0.55 as double))*{levels}/cast(1.1 as double)) as int))) as {c}" for k, c in ((1, "r"), (2, "g"), (3, "b"))
    )
    return f"select cast(vec_id // {height} as int) as image_id, cast(vec_id % {height} as int) as y, cast(x as int) as x, {ch}, vec_id % {height} < 4 as transparent from embeddings, range(0, {WIDTH}) t(x)"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded image files as pixel rows; Spark stores channels as B, G, R bytes row by row."""
    i = spark.read.format("image").load(path).select("image.*").withColumn("image_id", F.xxhash64("origin"))
    i = i.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))

    def at(k: int):
        byte = F.substring("data", (F.col("p") * F.col("nChannels") + F.when(F.col("nChannels") >= 3, k).otherwise(0) + 1).cast("int"), 1)
        return F.conv(F.hex(byte), 16, 10).cast("int")

    return i.select("image_id", "origin", F.expr("cast(p div width as int)").alias("y"), F.expr("cast(p % width as int)").alias("x"), at(2).alias("r"), at(1).alias("g"), at(0).alias("b"), F.lit(False).alias("transparent"))


def read_palettes(spark: SparkSession, path: str) -> DataFrame:
    """.pal files of RGB triples: (file, slot, r, g, b)."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pal").option("recursiveFileLookup", "true").load(path)
    return palette_slots(f.select(F.col("path").alias("file"), "content"), "content", "file")


def palette_slots(df: DataFrame, content: str, *keys: str) -> DataFrame:
    p = df.select(*keys, content, F.explode(F.sequence(F.lit(0), F.expr(f"cast(octet_length({content}) div 3 as int) - 1"))).alias("slot"))
    byte = lambda k: F.conv(F.hex(F.substring(content, F.col("slot") * 3 + k, 1)), 16, 10).cast("int")
    return p.select(*keys, "slot", byte(1).alias("r"), byte(2).alias("g"), byte(3).alias("b"))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """.v1k files cut at their fixed offsets: palettes 3072, map 9600, raw 76800 bytes; others are rejected."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").endswith(".v1k"))
    f = f.select("path", "content", (F.octet_length("content") == 89472).alias("valid")).orderBy(F.lower("path"))
    return f.select("path", "valid", F.substring("content", 1, 3072).alias("pal"), F.substring("content", 3073, 9600).alias("map"), F.substring("content", 12673, 76800).alias("raw"))


def read_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON settings, presets and queues: missing fields are null, unknown ones ignored."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """``name = description`` lines; # starts a comment; a line without = is an error row."""
    t = spark.read.text(path).withColumn("value", F.btrim("value")).filter("value <> '' and not startswith(value, '#')")
    ok = F.contains("value", F.lit("="))
    return t.select(F.when(ok, F.btrim(F.split_part("value", F.lit("="), F.lit(1)))).alias("name"), F.when(ok, F.btrim(F.regexp_replace("value", "^[^=]*=", ""))).alias("description"), F.when(~ok, F.col("value")).alias("problem"))
