"""Operator 1: n-gram Jaccard join of documents by MinHash banding.

Words are those of ``words``; a document's set holds the hashes (64 bits) of its
runs of ``n`` words, or one hash of all its words if it has fewer. Two documents
link if the Jaccard similarity of their sets is at least ``threshold``.

1. One pass computes a digest of the set and the band hashes. Documents of equal
   digest are one class, of which only a representative goes on.
2. Classes that share a band hash meet in a candidate component. A component of
   up to ``whole`` classes is compared as such, a larger one bucket by bucket, a
   pair only in its first common bucket. Either is cut into blocks of about
   ``block`` classes and ``block_bytes`` of sets, and each comparison takes two
   blocks, so no group lands in one task and a worker holds two blocks.
3. Pairs that share a band are verified on full sets. A task returns counts of
   links by class and a spanning forest of the links, never the pairs.
4. Components of the forests are the groups.

Rows for band b of r: P(meet) = 1 - (1 - J^r)^b, with b chosen for ``recall`` at
the threshold.

Cases: null, empty and wordless texts have no set and are groups of their own; a
repeated row counts as a copy; null ids keep their row, and a group of null ids
only has a null class_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import components, drop, fresh, materialize, read, small_side

U = np.uint64
NO_ID = -(2**63)


def bands_for(threshold: float, rows: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts with word hashes ``h``, and each text's first."""
    count = np.diff(at)
    keep = np.maximum(count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(keep)])
    if len(h) == 0:
        return np.zeros(0, np.uint64), out_at
    odd = W.mix(np.arange(1, n + 1, dtype=np.uint64)) | U(1)
    g = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        g += h[k : k + len(g)] * odd[k]
    out = np.empty(out_at[-1], np.uint64)
    src = np.arange(len(out)) - np.repeat(out_at[:-1] - at[:-1], keep)
    full = np.repeat(count >= n, keep)
    out[full] = g[src[full]]
    for i in np.flatnonzero((count > 0) & (count < n)):
        out[out_at[i]] = (h[at[i] : at[i + 1]] * odd[: count[i]]).sum(dtype=np.uint64) + U(count[i])
    return W.mix(out), out_at


def _signature(n: int, bands: int, rows: int):
    a = (W.mix(np.arange(1, bands * rows + 1, dtype=np.uint64) + U(7777)) >> U(32)).astype(np.uint32) | np.uint32(1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for part in W.pieces(big, "text", 1 << 20):
                g, at = shingles(*W.words(part.column("text")), n)
                have = np.flatnonzero(np.diff(at) > 0)
                d = np.zeros((len(have), 2), np.uint64)
                b = np.zeros((len(have), bands), np.uint64)
                if len(have):
                    first, x = at[:-1][have], (g >> U(32)).astype(np.uint32)
                    d[:, 0] = np.add.reduceat(g, first)
                    d[:, 1] = np.add.reduceat(W.mix(g ^ U(0x5BF0_3635)), first)
                    tmp = np.empty_like(x)
                    for k in range(bands * rows):
                        np.multiply(x, a[k], out=tmp)
                        b[:, k // rows] = W.mix(b[:, k // rows] * U(31) + np.minimum.reduceat(tmp, first) + U(k + 1))
                digest, band = np.full(part.num_rows, None, object), np.full(part.num_rows, None, object)
                digest[have] = [r.tobytes() for r in d]
                band[have] = [r.tobytes() for r in b]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(digest, pa.binary()), pa.array(band, pa.binary())], ["doc_id", "h", "digest", "bands"])

    return run


def _sets(n: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for part in W.pieces(big, "text", 1 << 20):
                g, at = shingles(*W.words(part.column("text")), n)
                out, same = [], []
                for i, want in enumerate(part.column("digest").to_pylist()):
                    x = g[at[i] : at[i + 1]]
                    d = np.array([x.sum(dtype=np.uint64), W.mix(x ^ U(0x5BF0_3635)).sum(dtype=np.uint64)], np.uint64)
                    if d.tobytes() == want:
                        same.append(i)
                        out.append(np.unique(x).tobytes())
                part = part.take(pa.array(same, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(out, pa.large_binary()).cast(pa.binary())], ["digest", "grams"])

    return run


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def compare(left: list[np.ndarray], right: list[np.ndarray] | None, lb: np.ndarray, rb: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with similarity of at least ``threshold`` among candidates: pairs
    that share any band, or with ``band`` >= 0 those that share it and none before.
    With no ``right``, pairs i < j within ``left``."""
    inner = right is None
    right = left if inner else right
    n, m = len(left), len(right)
    ls, rs = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    if band < 0:
        cand = np.zeros((n, m), bool)
        for k in range(lb.shape[1]):
            cand |= lb[:, k, None] == rb[None, :, k]
    else:
        cand = lb[:, band, None] == rb[None, :, band]
        for k in range(band):
            if not cand.any():
                break
            cand &= lb[:, k, None] != rb[None, :, k]
    if inner:
        cand &= np.arange(n)[:, None] < np.arange(m)[None, :]
    cand &= (np.minimum(ls[:, None], rs[None, :]) >= threshold * np.maximum(ls[:, None], rs[None, :]) - 1e-9)
    i, j = np.nonzero(cand)
    if not len(i):
        return i, j
    universe, inv, df = np.unique(np.concatenate(left if inner else left + right), return_inverse=True, return_counts=True)
    common = df > 1
    width = int(common.sum())
    by_pair, by_product = len(i) * (20e-6 + 60e-9 * (ls.mean() + rs.mean())), n * m * width / 1.5e10 + (ls.sum() + rs.sum()) * 5e-8
    if by_pair <= by_product:
        inter = np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], float)
    else:
        code = np.where(common, np.cumsum(common) - 1, -1)[inv]
        lrow, lcol = np.repeat(np.arange(n), ls), code[: ls.sum()]
        rrow, rcol = (lrow, lcol) if inner else (np.repeat(np.arange(m), rs), code[ls.sum() :])
        total = np.zeros((n, m), np.float32)
        for lo in range(0, width, 2048):
            hi = min(width, lo + 2048)

            def dense(row: np.ndarray, col: np.ndarray, size: int, lo: int = lo, hi: int = hi) -> np.ndarray:
                keep = (col >= lo) & (col < hi)
                x = np.zeros((size, hi - lo), np.float32)
                x[row[keep], col[keep] - lo] = 1
                return x

            x = dense(lrow, lcol, n)
            total += x @ (x if inner else dense(rrow, rcol, m)).T
        inter = total[i, j].astype(float)
    ok = inter >= threshold * (ls[i] + rs[j] - inter) - 1e-9
    return i[ok], j[ok]


def _verify(threshold: float):
    def group(rows: list[tuple]) -> list[tuple]:
        band, a, b = rows[0][1:4]
        side = [[r for r in rows if r[4] == a], [r for r in rows if r[4] == b] if a != b else []]
        both = side[0] + side[1]
        if len(both) < 2 or a != b and not (side[0] and side[1]):
            return []
        sets = [[np.frombuffer(r[7], np.uint64) for r in s] for s in side]
        hs = [np.array([np.frombuffer(r[8], np.uint64) for r in s]) for s in side]
        i, j = compare(sets[0], sets[1] if a != b else None, hs[0], hs[1] if a != b else hs[0], band, threshold)
        j = j + (len(side[0]) if a != b else 0)
        copies = np.array([r[6] for r in both], np.int64)
        links = np.bincount(i, copies[j], len(both)) + np.bincount(j, copies[i], len(both))
        forest, out = _Forest(len(both)), []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(x, y):
                out.append((both[x][5], both[y][5], 0))
        return out + [(both[x][5], None, int(links[x])) for x in np.flatnonzero(links)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[], [], []]
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["src", "dst", "links"])
            done.clear()
            return out

        for x in it:
            for r in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if held and held[-1][:4] != r[:4]:
                    done += group(held)
                    held = []
                held.append(r)
            if len(done) > 5000:
                yield batch()
        if held:
            done += group(held)
        yield batch()

    return run


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, rows: int = 6, block: int = 512, whole: int = 32768, block_bytes: int = 8 << 20) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, class_id (least doc_id of its group),
    copy_id (least doc_id of equal sets), n_links (other documents it links to) and
    n_group. See the module's text for method and cases."""
    return grouped(docs, n, threshold, recall, rows, block, whole, block_bytes).drop("h", "comp")


def grouped(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, rows: int = 6, block: int = 512, whole: int = 32768, block_bytes: int = 8 << 20) -> DataFrame:
    """``near_duplicates`` with h, a hash of the row's text, and comp, its group (null without a set)."""
    count = bands_for(threshold, rows, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    sig = materialize(docs.mapInArrow(_signature(n, count, rows), "doc_id long, h long, digest binary, bands binary"))
    one = (
        sig.filter("digest is not null")
        .groupBy("digest")
        .agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("rep"), F.count("*").alias("copies"), F.min("bands").alias("bands"))
    )
    one = materialize(one)
    part = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct(k.alias("band"), F.substring("bands", k * 8 + 1, 8).alias("hash")))
    buckets = one.select("digest", F.explode(part).alias("b")).select("digest", "b.band", "b.hash")
    heads = buckets.groupBy("band", "hash").agg(F.min("digest").alias("head"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(buckets.join(heads, ["band", "hash"]))
    comp = components(shared.filter("digest <> head").select(F.col("head").alias("src"), F.col("digest").alias("dst")).distinct())
    size = comp.groupBy("comp").agg(F.count("*").alias("n"))
    member = comp.withColumnRenamed("node", "digest").join(size, "comp")
    member = materialize(member.join(one, "digest"))
    want = member.select(F.col("rep"), "digest")
    want = materialize(want)
    grams = (
        docs.withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID)))
        .join(small_side(want), "rep")
        .select("digest", "text")
        .mapInArrow(_sets(n), "digest binary, grams binary")
        .dropDuplicates(["digest"])
    )
    grams = materialize(member.join(grams, "digest"), "lz4")
    cols = ["key", "band", "blocks", "digest", "copies", "grams", "bands"]
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("grams")) / block_bytes)).cast("int").alias("blocks")
    small = grams.filter(F.col("n") <= whole).select(F.col("comp").alias("key"), F.lit(-1).alias("band"), "digest", "copies", "grams", "bands")
    in_large = grams.filter(F.col("n") > whole)
    large = shared.drop("n").join(in_large, "digest").select(F.col("hash").alias("key"), "band", "digest", "copies", "grams", "bands")
    by_comp = materialize(small.groupBy("key").agg(blocks))
    by_bucket = shared.drop("n").join(in_large.select("digest", "grams"), "digest").groupBy(F.col("hash").alias("key"), "band").agg(blocks)
    small, large = small.join(small_side(by_comp), "key"), large.join(materialize(by_bucket), ["key", "band"])
    nb = F.col("blocks")
    mine = F.pmod(F.xxhash64("digest"), F.col("nb")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("a"), F.greatest(k, F.col("mine")).alias("b")))
    tasks = (
        small.unionByName(large)
        .select(*cols)
        .withColumn("nb", nb)
        .withColumn("mine", mine)
        .withColumn("p", F.explode(pair))
        .select("key", "band", F.col("p.a").alias("a"), F.col("p.b").alias("b"), "mine", "digest", "copies", "grams", "bands")
        .repartition("key", "band", "a", "b")
        .sortWithinPartitions("key", "band", "a", "b")
    )
    found = materialize(tasks.mapInArrow(_verify(threshold), "src binary, dst binary, links long"))
    groups = components(found.filter("dst is not null").select("src", "dst"))
    links = found.filter("dst is null").groupBy(F.col("src").alias("digest")).agg(F.sum("links").alias("links"))
    info = (
        one.select("digest", F.nullif(F.col("rep"), F.lit(NO_ID)).alias("copy_id"), "copies")
        .join(groups.withColumnRenamed("node", "digest"), "digest", "left")
        .join(links, "digest", "left")
        .withColumn("comp", F.coalesce("comp", "digest"))
    )
    info = materialize(info)
    heads = info.groupBy("comp").agg(F.min("copy_id").alias("class_id"), F.sum("copies").alias("n_group"))
    info = info.join(heads, "comp").select("digest", "comp", "class_id", "copy_id", "n_group", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    drop(shared, member, want, grams)
    return sig.select("doc_id", "h", "digest").join(info, "digest", "left").select(
        "doc_id", "h", "comp",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_group", F.lit(1)).cast("long").alias("n_group"),
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """A row with the least doc_id of each group, with all columns of ``docs``, whatever their names.

    Of rows with equal doc_id and text one stays, any of them if other columns differ; texts under one
    doc_id are told apart. Rows without a set (wordless texts) and rows without an id all stay.
    """
    mine = fresh(docs, "_text_key")
    key = ["doc_id", mine]
    g = grouped(docs).withColumnRenamed("h", mine).filter("doc_id is not null")
    heads = g.filter("comp is not null and doc_id = class_id").groupBy("comp").agg(F.min(F.struct(*key)).alias("k")).select("k.*").distinct()
    bare = g.filter("comp is null").select(*key).distinct()
    own = docs.withColumn(mine, F.xxhash64(F.col("text").cast("string")))
    kept = own.join(heads, key, "left_semi").dropDuplicates(key)
    return kept.unionByName(own.join(bare, key, "left_semi")).unionByName(own.filter("doc_id is null")).select(*docs.columns)
