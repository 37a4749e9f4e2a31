"""What the training-data operators share: shared folders, size checks, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest table, in bytes of its Parquet files, that an operator broadcasts.
BROADCAST_BYTES = 16 << 20
#: Most rows of a batch that goes to Python.
BATCH_ROWS = 250


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow hand over few rows at a time, so that long texts fit the workers.

    The setting counts for plans made later in this session; a lower one of the caller's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors reach.

    Without that setting there is no folder that all executors are known to share: an error
    but for a session that is one process (``local``), whose warehouse serves.
    """
    bounded_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/gridloom/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there,
    and lost executors take nothing with them."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete the files of materialized tables that no later step reads."""
    for df in frames:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/gridloom/" in f:
                jvm = df.sparkSession._jvm
                p = jvm.org.apache.hadoop.fs.Path(f)
                p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def bytes_of(df: DataFrame) -> int:
    """Bytes of a materialized table: of its files, asked of the file system, and if these are within
    ``BROADCAST_BYTES``, about those of its rows in memory, which packed files don't tell."""
    spark, total = df.sparkSession, 0
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    if total > BROADCAST_BYTES:
        return total
    rows = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("text"), F.count("*").alias("n")).head()
    return max(total, (rows.text or 0) + 64 * rows.n)


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a materialized table within ``limit``; beyond it the
    join stays a shuffle join, which AQE splits where a key is hot."""
    return F.broadcast(df) if bytes_of(df) <= limit else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the like, that no column of ``df`` has, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def crc32_of_id(c: str) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary"))


def least_by_hash(rows: DataFrame, group: str, k: int) -> DataFrame:
    """The distinct rows of ``rows(group, doc_id, h)`` with a ``rank`` of 1 to k in their group by hash
    of doc_id, then doc_id, then h.

    Counts by the hash's upper 10 bits, added up before the shuffle, tell up to which of these ranges
    a group reaches k; then 20 bits tell it of the rows up to there. So what goes to a group's task
    are 1024 counts, then some k counts or rows and a millionth of the group, not each partition's k.
    An empty table gives no rows; repeated rows count once.
    """
    key = F.xxhash64("doc_id")
    near = materialize(rows.select(group, "doc_id", "h").distinct())
    below = F.sum("n").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    for bits in (10, 20):
        ranged = near.withColumn("range", F.shiftright(key, 64 - bits))
        cut = ranged.groupBy(group, "range").agg(F.count("*").alias("n")).withColumn("below", F.coalesce(below, F.lit(0)))
        cut = materialize(cut.filter(F.col("below") < k).groupBy(group).agg(F.max("range").alias("cut")))
        near = ranged.join(small_side(cut), group).filter(F.col("range") <= F.col("cut")).select(group, "doc_id", "h")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key, "doc_id", "h"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)``: rows (node, comp), comp the least node.

    Alternating large-star and small-star on edges (hi, lo): first each edge takes the
    least node below its lower end, then each node's lower neighbours link to their least.
    Both keep components and never add edges, and rounds grow with a power of the logarithm
    of the nodes at most, whatever the diameter; they end when no edge moves. Every round is
    written to the shared folder, and least nodes apart, so that joins by a hot node can be split.
    An empty edge table gives an empty result; repeated edges and loops do no harm.
    """
    e = materialize(
        edges.filter("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct().withColumn("moved", F.lit(True))
    )
    while e.filter("moved").head(1):
        low = materialize(e.groupBy("hi").agg(F.min("lo").alias("least")))
        up = small_side(low.withColumnRenamed("hi", "lo"))
        large = materialize(e.join(up, "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo"), F.col("least").isNotNull().alias("moved")))
        drop(e, low)
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("least")))
        linked = large.join(small_side(low), "hi").select(
            F.when(F.col("lo") == F.col("least"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
            F.col("least").alias("lo"),
            (F.col("moved") | (F.col("lo") != F.col("least"))).alias("moved"),
        )
        e = materialize(linked.groupBy("hi", "lo").agg(F.max("moved").alias("moved")))
        drop(large, low)
    out = materialize(e.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(e.select("lo", "lo").distinct()))
    drop(e)
    return out
