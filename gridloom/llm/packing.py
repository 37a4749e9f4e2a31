"""Operator 4: packing by concatenate and cut.

All documents' ids, each followed by the end id, form one sequence that is cut every
``length`` ids. Pass one encodes each partition and writes ids with their offset in the
partition. Pass two adds up the partitions' totals; their prefix sums give every document
its global offset, and fixed windows follow by arithmetic. A window over the border of two
partitions or documents has a piece from each (its boundary records), so only the last
sequence is padded and no data moves for cutting. With ``by``, a column's values (languages) each have
sequences of their own, one value's after the other's, and each one's last is padded.

Cases: a null or empty text is the end id alone; repeated rows are documents of their own;
a null doc_id stays null; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, read, small_side
from .token_ids import default_tokenizer, encoder


def _encode(path: str, end: int, grouped: bool = False):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, part = encoder(path), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        for big in it:
            for b in W.pieces(big, "text", 1 << 21):
                ids = [x + tail for x in enc.encode([x or "" for x in b.column("text").to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                group = b.column("grp").to_pylist() if grouped else [None] * len(n)
                off = np.zeros(len(n), np.int64)
                for g in dict.fromkeys(group):
                    own = np.array([x == g for x in group])
                    off[own] = seen.get(g, 0) + np.cumsum(n[own]) - n[own]
                    seen[g] = seen.get(g, 0) + int(n[own].sum())
                cols = [b.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(off), pa.array(n), pa.array(ids, pa.binary())]
                names = ["doc_id", "part", "off", "n", "ids"]
                yield pa.RecordBatch.from_arrays([*cols, b.column("grp")] if grouped else cols, [*names, "grp"] if grouped else names)

    return run


def encoded(docs: DataFrame, end: int, tokenizer: str | None = None, by: str | None = None) -> DataFrame:
    """Per document: doc_id, part, off (ids before it in its partition, of its own ``by``), n, ids, and grp, its ``by``, if given."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(by).cast("string").alias("grp")] if by else []))
    kind = "doc_id long, part int, off long, n long, ids binary" + (", grp string" if by else "")
    return materialize(d.mapInArrow(_encode(tokenizer or default_tokenizer(), end, bool(by)), kind), "lz4")


def with_offsets(ids: DataFrame) -> DataFrame:
    """Adds ``begin``, the count of all ids before, by prefix sums over partition totals."""
    total = ids.groupBy("part").agg(F.sum("n").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = materialize(total.select("part", before.alias("base")))  # a row per partition
    return ids.join(small_side(base), "part").withColumn("begin", F.col("base") + F.col("off"))


def with_offsets_by(ids: DataFrame, length: int) -> DataFrame:
    """``with_offsets`` where each value of grp begins at a multiple of ``length``."""
    total = materialize(ids.groupBy("grp", "part").agg(F.sum("n").alias("t")))  # a row per partition and value
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = total.groupBy("grp").agg((F.ceil(F.sum("t") / length) * length).alias("room"))
    first = whole.select("grp", F.coalesce(F.sum("room").over(earlier(Window.orderBy("grp"))), F.lit(0)).alias("first"))
    inner = F.coalesce(F.sum("t").over(earlier(Window.partitionBy("grp").orderBy("part"))), F.lit(0))
    t, f = total.select("grp", "part", inner.alias("inner")).alias("t"), first.alias("f")
    base = t.join(f, F.col("t.grp").eqNullSafe(F.col("f.grp"))).select("t.grp", "part", (F.col("first") + F.col("inner")).alias("base"))
    base = small_side(materialize(base)).toDF("g", "p", "base")
    return ids.join(base, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g"))).withColumn("begin", F.col("base") + F.col("off"))


def pack(docs: DataFrame, length: int = 2048, end: int = 1, tokenizer: str | None = None, by: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, LE uint32)."""
    x = encoded(docs, end, tokenizer, by)
    x = (with_offsets_by(x, length) if by else with_offsets(x)).select("doc_id", "n", "begin", "ids")
    first, last = F.floor(F.col("begin") / length), F.floor((F.col("begin") + F.col("n") - 1) / length)
    x = x.withColumn("seq", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("begin"), F.col("seq") * length)
    hi = F.least(F.col("begin") + F.col("n"), (F.col("seq") + 1) * length)
    x = x.withColumn("lo", lo).withColumn("hi", hi)
    return x.select(
        "doc_id",
        (F.col("lo") - F.col("begin")).alias("start"),
        (F.col("hi") - F.col("lo")).alias("length"),
        F.col("n").alias("doc_tokens"),
        F.col("seq").cast("long").alias("sequence_id"),
        (F.col("lo") - F.col("seq") * length).alias("offset"),
        F.substring("ids", (4 * (F.col("lo") - F.col("begin")) + 1).cast("int"), (4 * (F.col("hi") - F.col("lo"))).cast("int")).alias("ids"),
    )


def sequences(pieces: DataFrame, length: int = 2048, pad: int = 0) -> DataFrame:
    """Whole sequences of ``length`` ids: sequence_id, ids, n_tokens; at most ``length`` pieces each."""
    s = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    padding = F.unhex(F.repeat(F.lit(np.array([pad], "<u4").tobytes().hex()), (length - F.col("n_tokens")).cast("int")))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return s.select("sequence_id", "n_tokens", F.concat(joined, padding).alias("ids"))


def piece_rows(docs: DataFrame, by: str | None = None) -> DataFrame:
    p = pack(docs, by=by)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_rows(read(spark, sf_dir, "documents"))
