"""Operator 7: token ids in binary files by an adaptive context-mixing range coder.

A segment lists its ids met twice or more, often met ones first, and codes an id as its rank in
that list. Ids are cut into blocks of ``BLOCK``, each coded from a reset model and kept with
a CRC-32 of its ids, so a block can be read with the list alone and damage is found. For each id, order 2
(the two ids before) and order 1 name the id that last followed, with a confidence; whether
they are right is coded first. Of any other id the bin of its rank (four bins an octave) goes bit by
bit down a tree of adaptive chances of order 0, mixed with those of order 1 in the first bit; its place in
the bin is plain bits. Rank 0 says that the id isn't listed, and its own bin follows. Chances of two contexts are
mixed in the logistic domain under weights that follow which did better, and a binary range
coder of 32 bits codes each decision. Ids must lie below 2^17.

The coder is integer Java (``id_coder``), as an id takes some 8 decisions and Python's would
take microseconds each; ``jvm`` compiles it. Python runs the tokenizer alone.

A segment is a byte string: magic, counts, ids' offset in its partition, a checksum, the index
of documents (doc_id, length), then the table of blocks (bytes, checksum), the list of ids and the blocks' code.
Segments hold whole documents. They are rows of Parquet files, as executors have no other shared
writer; ``read_segments`` and ``read_ids`` need nothing but those bytes.

Cases: null and empty texts have the end id alone; null doc_ids come first and stay null;
rows with equal doc_id are in the order of their text; an empty table gives no rows; extra
columns are ignored; a damaged segment is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import id_coder, jvm
from . import words as W
from .common import materialize, read
from .packing import with_offsets
from .token_ids import default_tokenizer, encoder

BLOCK = 65536
#: Ids of a segment, about; a longer document is a segment by itself.
SEGMENT = 16 * BLOCK
MAGIC = b"GLTI3\0\0\0"
NULL_ID = -(2**63)


def head(doc_ids: list[int | None], lengths: list[int], base: int) -> bytes:
    """What comes before the code in a segment."""
    index = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes()
    return MAGIC + struct.pack("<QQI", len(doc_ids), base, zlib.crc32(index)) + index


def _segments(path: str, end: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, part, base, no = encoder(path), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal base, no, total
            lengths = [len(x) // 4 for x in held]
            row = [[part], [no], [head(docs, lengths, base)], [b"".join(held)]]
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "segment", "head", "ids"])
            base, no, total = base + sum(lengths), no + 1, 0
            docs.clear()
            held.clear()
            return out

        for big in it:
            for b in W.pieces(big, "text", 1 << 21):
                coded = enc.encode([x or "" for x in b.column("text").to_pylist()])
                for d, ids in zip(b.column("doc_id").to_pylist(), coded, strict=True):
                    if held and total + len(ids) // 4 >= SEGMENT:
                        yield close()
                    docs.append(d)
                    held.append(ids + tail)
                    total += len(ids) // 4 + 1
        if held:
            yield close()

    return run


def write_ids(docs: DataFrame, end: int = 2, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """Segments (part, segment, data) of all documents in ascending doc_id, written."""
    java = jvm.register(docs.sparkSession, id_coder.SOURCE, id_coder.FUNCTIONS)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    x = d.mapInArrow(_segments(tokenizer or default_tokenizer(), end), "part int, segment int, head binary, ids binary")
    code = F.call_function(java["gridloom_encode_ids"], "ids", F.lit(block))
    return materialize(x.select("part", "segment", F.concat("head", code).alias("data")), "uncompressed")


def read_segments(files: DataFrame) -> DataFrame:
    """Per document, from segments: doc_id, start, n_tokens, ids_crc32."""
    java = jvm.register(files.sparkSession, id_coder.SOURCE, id_coder.FUNCTIONS)
    x = files.select("part", F.call_function(java["gridloom_read_docs"], "data").alias("v"))
    row = F.transform(F.sequence(F.lit(0), F.size("v") - 1, F.lit(4)), lambda i: F.struct(*[F.get("v", i + k).alias(n) for k, n in enumerate(("doc_id", "off", "n", "crc"))]))
    x = x.select("part", F.inline(row))  # a segment has a document at least; a filter here would decode twice
    x = with_offsets(materialize(x))
    return x.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.col("begin").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def read_ids(files: DataFrame) -> DataFrame:
    """Per segment: part, segment, ids (binary, little-endian unsigned 32-bit)."""
    java = jvm.register(files.sparkSession, id_coder.SOURCE, id_coder.FUNCTIONS)
    return files.select("part", "segment", F.call_function(java["gridloom_read_ids"], "data").alias("ids"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_segments(write_ids(read(spark, sf_dir, "documents")))
