"""Operator 9: exact top-k inner products by dual-tree cover-tree search.

Queries and candidates are each indexed by cover trees. A node is a point (its centre) and a
level i; all its points lie within 2^i of the centre. Its children are chosen among these
points, the node's own centre first (nesting), more than 2^(i-1) apart (separation), and each
point goes to its nearest child, within 2^(i-1) (covering). A node of a few points (``LEAF``, of
queries ``FEW``) or of equal points is a leaf. For nodes with centres q, p and true radii a, b

    <q', p'>  <=  <q, p> + a |p| + b |q| + a b

holds for all points below; a node pair goes when that is less than the worst kth score of the
query group so far (equal bounds stay, ties count). A node's children are bounded together,
and its leaves are met as one block. Where vectors are spread evenly over many dimensions no
bound is tight and the search meets all pairs of leaves; clustered vectors are pruned.

Work is dealt in a grid: ``block`` queries meet about ``TREE`` candidates in one group, all groups side
by side and none through the driver; each returns k rows a query, merged by a rank. Scores are
exact: in doubles while these hold them, else in unbounded integers.

Cases: vectors null, empty, or with components that are null or, 1024-fold, not finite and rows with a null id
take no part; vectors of another length than a query's aren't compared with it; a query's
own row is any row with its id; repeated rows each count as a candidate, and a repeated
query id is one query, with its least vector; a score beyond 64 bits is the nearest number of
64 bits; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .vectors import BIG, LEAST, MOST, grid, matrix, ranked, scaled, whole

LEAF, FEW = 32, 4
#: Rows of a tree, at most.
TREE = 16384


class Tree:
    """A cover tree in arrays. Points of node i are order[lo[i]:hi[i]], its centre is point
    centre[i], its level level[i], its children kids[i], and radius[i] covers its points."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.order, self.sq = x, np.arange(len(x)), (x**2).sum(1)
        self.centre: list[int] = []
        self.level: list[int] = []
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.kids: list[np.ndarray] = []
        radius: list[float] = []
        d = self._far(np.arange(len(x)), 0) if len(x) else np.zeros(0)
        stack = [(0, len(x), 0, -1, d)]
        while stack:
            lo, hi, c, parent, d = stack.pop()
            me, far = len(self.centre), float(d.max()) if len(d) else 0.0
            i = int(np.ceil(np.log2(far))) if 0 < far < np.inf else -1
            self.centre.append(c)
            self.level.append(i)
            radius.append(far * (1 + 1e-9) + 1e-9)
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append(np.zeros(0, np.int64))
            if parent >= 0:
                self.kids[parent] = np.append(self.kids[parent], me)
            if hi - lo > leaf and 0 < far < np.inf:  # squares beyond doubles leave a leaf of all
                stack += [(a, b, k, me, near) for a, b, k, near in self._split(lo, hi, c, 2.0 ** (i - 1))]
        self.radius = np.array(radius)
        self.c = x[self.centre] if len(x) else x
        self.norm = np.sqrt((self.c**2).sum(1))
        self.leaf = np.array([not len(k) for k in self.kids])

    def _far(self, ids: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(((self.x[ids] - self.x[c]) ** 2).sum(1))

    def _split(self, lo: int, hi: int, c: int, r: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Choose centres over r apart among order[lo:hi], c first, until all are covered; points are
        then dealt to the nearest. Uncovered points are tried in blocks, so most work is products."""
        ids = self.order[lo:hi].copy()
        x, sq = self.x[ids], self.sq[ids]
        best, near = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
        chosen: list[int] = []
        left = np.concatenate([np.flatnonzero(ids == c), np.flatnonzero(ids != c)])
        while len(left):
            block = left[: 1 if not chosen else 256]
            d2 = ((x[block][:, None] - x[block][None]) ** 2).sum(2) if len(block) > 1 else np.zeros((1, 1))
            free, new = np.ones(len(block), bool), []
            for j in range(len(block)):
                if free[j]:
                    new.append(block[j])
                    free &= d2[j] > r * r
            d2 = sq[:, None] - 2 * (x @ x[new].T) + sq[new][None]
            at = d2.argmin(1)
            low = np.maximum(d2[np.arange(len(ids)), at], 0)
            closer = low < best
            near[closer], best[closer] = len(chosen) + at[closer], low[closer]
            chosen += [int(v) for v in new]
            near[chosen], best[chosen] = np.arange(len(chosen)), 0
            left = left[best[left] > r * r]
        by = np.argsort(near, kind="stable")
        self.order[lo:hi] = ids[by]
        edge = lo + np.concatenate([[0], np.cumsum(np.bincount(near, minlength=len(chosen)))])
        for k, a, b in zip(chosen, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield a, b, int(ids[k]), self._far(self.order[a:b], int(ids[k]))


class Best:
    """The k best (score, then least id) of each query. With ``exact``, scores are Python integers."""

    def __init__(self, ids: np.ndarray, k: int, exact: bool = False) -> None:
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf, object if exact else float)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        score = np.where(self.ids[rows, None] == vec[None, :], -np.inf, score)
        hot = np.flatnonzero((score >= self.score[rows, -1:]).any(1))
        if not len(hot):
            return
        s = np.concatenate([self.score[rows[hot]], score[hot]], 1)
        v = np.concatenate([self.vec[rows[hot]], np.broadcast_to(vec, (len(hot), len(vec)))], 1)
        if s.dtype == object:
            o = np.array([sorted(range(s.shape[1]), key=lambda j: (-a[j], b[j]))[: self.k] for a, b in zip(s, v, strict=True)])
        else:
            o = np.lexsort((v, -s), axis=1)[:, : self.k]
        self.score[rows[hot]], self.vec[rows[hot]] = np.take_along_axis(s, o, 1), np.take_along_axis(v, o, 1)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products; where doubles don't hold them, as integers without bound, cut to 64 bits."""
    if not len(q) or not len(p) or np.abs(q).max() * np.abs(p).max() * q.shape[1] < BIG:
        return q @ p.T
    s = whole(q) @ whole(p).T
    return np.array([max(LEAST, min(MOST, v)) for v in s.ravel()], object).reshape(s.shape)


def search(q: Tree, p: Tree, ids: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with the points of ``p``; returns the point pairs met."""
    if not len(q.x) or not len(p.x):
        return 0
    stack, met = [(0, np.zeros(1, np.int64))], 0
    while stack:
        a, nodes = stack.pop()
        rows = q.order[q.lo[a] : q.hi[a]]
        worst = float(best.score[rows, -1].min())
        up = p.c[nodes] @ q.c[a] + q.radius[a] * p.norm[nodes] + p.radius[nodes] * (q.norm[a] + q.radius[a])
        up = np.where(np.isnan(up) | (np.abs(p.c[nodes]).max(1) * np.abs(q.c[a]).max() > 1e290), np.inf, up)  # nothing is known beyond doubles
        up = np.maximum(up, float(LEAST))  # as scores are
        keep = up + 1e-6 + 1e-9 * np.abs(up) >= worst
        nodes, up = nodes[keep], up[keep]
        if not len(nodes):
            continue
        if len(q.kids[a]) and (q.radius[a] > p.radius[nodes].max() or p.leaf[nodes].all()):
            stack += [(int(b), nodes) for b in q.kids[a]]
            continue
        by = np.argsort(-up, kind="stable")  # the best first
        nodes, up = nodes[by], up[by] + 1e-6 + 1e-9 * np.abs(up[by])
        at_leaf = up[p.leaf[nodes]]
        leaves, inner = nodes[p.leaf[nodes]], nodes[~p.leaf[nodes]]
        if len(inner):
            stack.append((a, np.concatenate([p.kids[b] for b in inner])))
        if len(leaves) and len(q.kids[a]):
            stack += [(int(b), leaves) for b in q.kids[a]]
            continue
        held, n = [], 0
        for i, b in enumerate(leaves):
            held.append(p.order[p.lo[b] : p.hi[b]])
            n += len(held[-1])
            if n >= 256 or i + 1 == len(leaves):
                at = np.concatenate(held)
                met += len(rows) * len(at)
                best.add(rows, products(q.x[rows], p.x[at]), ids[at])
                held, n = [], 0
                if i + 1 < len(leaves) and at_leaf[i + 1] < float(best.score[rows, -1].min()):
                    break
    return met


def _meet(k: int):
    """Of a grid's group: the k best candidates of each query, by trees of both."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})]
        if not asked.num_rows or not rows.num_rows:
            return parts[0]
        d = rows.column("d")[0].as_py()
        q, x = matrix(asked.column("v"), d), matrix(rows.column("v"), d)
        mine, ids = asked.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        with np.errstate(all="ignore"):
            big = np.abs(x).max(1) * np.abs(q).max() * d >= BIG
            for exact, at in ((False, ~big), (True, big)):
                if at.any():
                    best = Best(mine, k, exact)
                    search(Tree(q, FEW), Tree(x[at]), ids[at], best)
                    i, j = np.nonzero(best.score != -np.inf)
                    score = [int(v) for v in best.score[i, j]]
                    parts.append(pa.table([mine[i], best.vec[i, j], pa.array(score, pa.int64())], names=parts[0].column_names))
        return pa.concat_tables(parts)

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 8192, tree: int = TREE) -> DataFrame:
    """Per query the k best rows of ``vectors(vec_id, embedding)``: query_id, rank, vec_id, score."""
    rows = materialize(scaled(vectors.filter("vec_id is not null"), 1024.0, ["vec_id"]).withColumn("d", F.size("v")))
    asked = scaled(queries.filter("vec_id is not null"), 1024.0, ["vec_id"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked.withColumn("d", F.size("v")))
    found = grid(asked, rows, ["d"], _meet(k), "query_id long, vec_id long, score long", block, tree)
    return ranked(found, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(v, v.filter("vec_id % 100 = 0"))


ORACLE_SQL = {
    "op9_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
           from embeddings where vec_id is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id,
             cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
      from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""
}
