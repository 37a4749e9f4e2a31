"""Operator 11: hard negatives by product quantisation with stored residual norms.

A vector is cut into parts of ``WIDTH`` components, and each part is coded by the nearest entry of that
part's codebook (Lloyd's iterations on a sample of some ``SAMPLE`` vectors of each length, the documented
bound; every row is coded). Beside the codes stands the norm r of what they leave. For an anchor a

    | <a, x> - sum over parts of table[part][code] |  <=  |a| r

where the table holds the products of the anchor's parts with all entries. So a row can be among the
first k only if table score + |a| r reaches the kth of all table score - |a| r, and may lie in a window
only if these two enclose a part of it. What is left is scored by exact integer products, which
alone decide. No row that belongs to the result is lost, however bad the codebooks are.

Work is dealt in a grid: ``ANCHORS`` anchors meet ``ROWS`` rows in one group, and each group returns at
most k rows an anchor (and positive), ranked again over all groups. Positives meet the rows of their own
label only, in grids by label; a hot label has more groups, not larger ones.

Cases: rows with a null id, label or vector, an empty vector, or a component that is null or not finite
(scaled in doubles) take no part; rows that repeat an id count once, as the least of (label, vector);
vectors of different lengths aren't compared; an anchor without positives, and a positive without
negatives, give no rows; a positive with a negative score has an empty window; a score beyond 64 bits is
the nearest number of 64 bits; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize, read
from .vectors import LEAST, MOST, dots, grid, matrix, ranked, scaled

#: Components of a part, entries of its codebook, vectors that codebooks are fitted on.
WIDTH, ENTRIES, SAMPLE = 2, 256, 4096
#: Anchors and rows of a group of the grid.
ANCHORS, ROWS = 1024, 4096


def fit(x: np.ndarray, rounds: int = 8) -> list[np.ndarray]:
    """A codebook for each part, by Lloyd's iterations on all rows of ``x``."""
    x, rng, books = np.clip(x, -1e100, 1e100), np.random.default_rng(11), []
    for lo in range(0, x.shape[1], WIDTH):
        part = np.unique(x[:, lo : lo + WIDTH], axis=0)
        book = part[np.sort(rng.choice(len(part), min(ENTRIES, len(part)), replace=False))]
        for _ in range(rounds if len(part) > ENTRIES else 0):
            code = nearest(part, book)
            n = np.bincount(code, minlength=len(book))
            mean = np.stack([np.bincount(code, part[:, j], len(book)) for j in range(part.shape[1])], 1) / np.maximum(n, 1)[:, None]
            book = np.where(n[:, None] > 0, mean, book)
        books.append(book)
    return books


def nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1) - 2 * (part @ book.T)).argmin(1)


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all parts, and the norms of the residuals, rounded up."""
    codes = np.stack([nearest(x[:, WIDTH * i : WIDTH * i + WIDTH], b) for i, b in enumerate(books)], 1).astype(np.uint8)
    rest = x - np.concatenate([b[codes[:, i]] for i, b in enumerate(books)], 1)
    return codes, np.sqrt((rest**2).sum(1)) * (1 + 1e-12)


def bounds(a: np.ndarray, books: list[np.ndarray], codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all anchors ``a`` with all coded rows, within 64 bits."""
    score = np.zeros((len(a), len(codes)))
    size = score.copy()  # what rounding is relative to
    for i, b in enumerate(books):
        table = a[:, WIDTH * i : WIDTH * i + WIDTH] @ b.T
        score += table[:, codes[:, i]]
        size += np.abs(table).max(1)[:, None]
    half = np.sqrt((a**2).sum(1))[:, None] * rest + 1e-9 * size + 1e-6
    half += 1e-9 * half
    known = np.isfinite(score) & np.isfinite(half)
    low, high = np.where(known, score - half, -np.inf), np.where(known, score + half, np.inf)
    return np.clip(low, LEAST, MOST), np.clip(high, LEAST, MOST)


def least_kept(low: np.ndarray, k: int) -> np.ndarray:
    """The kth largest of each row, the least number where there are fewer."""
    return -np.partition(-low, k - 1, axis=1)[:, k - 1] if low.shape[1] >= k else np.full(len(low), float(LEAST))


def _first(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each row, ties to the smaller id."""
    by = np.lexsort((ids, ~score, row))  # ~ reverses the order of all 64-bit integers
    start = np.flatnonzero(np.concatenate([[True], row[by][1:] != row[by][:-1]])) if len(by) else by
    return by[np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by)))) < k]


def _columns(anchors: pa.Table, rows: pa.Table, books: dict):
    d = rows.column("d")[0].as_py()
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    ids = [t.column("vec_id").to_numpy() for t in (anchors, rows)]
    return *ids, matrix(anchors.column("v"), d), matrix(rows.column("v"), d), books[d], code, rows.column("rest").to_numpy()


def positives_of(books, k: int):
    """Of a grid's group: the first k other rows of each anchor."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = pa.table({"anchor_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not anchors.num_rows or not rows.num_rows:
            return out
        with np.errstate(all="ignore"):
            ids, others, a, x, book, code, rest = _columns(anchors, rows, books.value)
            low, high = bounds(a, book, code, rest)
            self = ids[:, None] == others
            low[self] = -np.inf
            i, j = np.nonzero((high >= least_kept(low, k)[:, None]) & ~self)
            score = dots(a[i], x[j])
        at = _first(i, score, others[j], k)
        return pa.table([ids[i[at]], others[j[at]], score[at]], schema=out.schema)

    return run


def negatives_of(books, k: int, low_pct: int, high_pct: int):
    """Of a grid's group: the first k rows of each anchor's and positive's window, of other labels."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score", "vec_id", "score"]
        parts = [pa.table({n: pa.array([], pa.int64()) for n in names})]
        if not anchors.num_rows or not rows.num_rows:
            return parts[0]
        with np.errstate(all="ignore"):
            ids, others, a, x, book, code, rest = _columns(anchors, rows, books.value)
            low, high = bounds(a, book, code, rest)
            kinds = [t.column("label").to_numpy() for t in (anchors, rows)]
            open_ = kinds[0][:, None] != kinds[1]
            pos, scores = (anchors.column(c).to_pylist() for c in ("positives", "scores"))
            # The window of a score p, in whole numbers: ceil(low_pct p / 100) to floor(high_pct p / 100).
            window = [[(-(-low_pct * p // 100), high_pct * p // 100) for p in s] for s in scores]
            want, each = np.zeros(open_.shape, bool), []
            for n in range(max(map(len, pos))):
                has = np.array([i for i, w in enumerate(window) if len(w) > n and w[n][0] <= w[n][1]], np.int64)
                least, most = (np.array([window[i][n][e] for i in has], float)[:, None] for e in (0, 1))
                l, h, o = low[has], high[has], open_[has]
                sure = np.where(o & (l >= least) & (h <= most), l, -np.inf)
                want[has] |= o & (h >= least) & (l <= most) & (h >= least_kept(sure, k)[:, None])
                each.append((n, has))
            i, j = np.nonzero(want)
            score = dots(a[i], x[j])
        edge = np.searchsorted(i, np.arange(len(ids) + 1))
        for n, has in each:
            for r in has:
                s = score[edge[r] : edge[r + 1]]
                least, most = window[r][n]
                at = np.flatnonzero((s >= max(least, LEAST)) & (s <= min(most, MOST))) + edge[r]
                at = at[_first(i[at], score[at], others[j[at]], k)]
                if len(at):
                    whose = [np.full(len(at), v) for v in (ids[r], pos[r][n], scores[r][n])]
                    parts.append(pa.table([*whose, others[j[at]], score[at]], names=names))
        return pa.concat_tables(parts)

    return run


def index(rows: DataFrame, scale: float) -> tuple[DataFrame, dict]:
    """All usable rows with codes and residual norms, written; and the codebooks of each vector length."""
    spark = rows.sparkSession
    base = scaled(rows.filter("vec_id is not null and label is not null"), scale, ["vec_id", "label"])
    base = base.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("least")).select("vec_id", "least.*", F.size("least.v").alias("d"))
    base = materialize(base)
    books = {}
    for r in base.groupBy("d").count().collect():  # a row for each length of vector
        near = base.filter(F.col("d") == r.d)
        if r["count"] > SAMPLE:
            near = near.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(SAMPLE / r["count"] * (1 << 30)))
        x = np.array([v.v for v in near.select("v").collect()], float).reshape(-1, r.d)
        books[r.d] = fit(x if len(x) else np.zeros((1, r.d)))
    shared = spark.sparkContext.broadcast(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size = b.column("d").to_numpy()
            for d in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == d)))
                with np.errstate(all="ignore"):
                    codes, rest = encode(matrix(part.column("v"), int(d)), shared.value[int(d)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)], [*b.schema.names, "code", "rest"])

    coded = materialize(base.mapInArrow(run, f"vec_id long, label {dict(base.dtypes)['label']}, v array<double>, d int, code binary, rest double"))
    drop(base)
    return coded, shared


def hard_negatives(rows: DataFrame, anchors: str, scale: float = 256.0, k_positives: int = 5, k: int = 5, low_pct: int = 80, high_pct: int = 100) -> DataFrame:
    """Hard negatives of the rows of ``rows(vec_id, label, embedding)`` that meet the SQL condition ``anchors``:
    for each of an anchor's first ``k_positives`` rows of its label, the first ``k`` rows of other labels
    with scores of ``low_pct`` to ``high_pct`` percent of the positive's."""
    coded, books = index(rows, scale)
    asked = coded.filter(anchors).drop("code", "rest")
    found = grid(asked.select("vec_id", "label", "d", "v"), coded, ["d", "label"], positives_of(books, k_positives), "anchor_id long, vec_id long, score long", ANCHORS, ROWS)
    pos = ranked(found, ["anchor_id"], k_positives).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    pos = pos.select(F.col("anchor_id").alias("vec_id"), F.col("p.vec_id").alias("positives"), F.col("p.score").alias("scores"))
    asked = materialize(asked.join(pos, "vec_id"))
    found = grid(asked, coded, ["d"], negatives_of(books, k, low_pct, high_pct), "anchor_id long, positive_id long, positive_score long, vec_id long, score long", ANCHORS, ROWS)
    out = ranked(found, ["anchor_id", "positive_id"], k)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, "vec_id % 100 = 0")


ORACLE_SQL = {
    "op11_hard_negatives": """
with v as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
                  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
           from embeddings where vec_id is not null and label is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same,
             cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
      from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
p as (select anchor_id, vec_id as positive_id, score as positive_score
      from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as r from s where same) where r <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score,
             cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank
      from p join s on s.anchor_id = p.anchor_id and not s.same
        and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""
}
