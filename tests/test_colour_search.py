"""Nearest colours by cubes and median cut by levels, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kernels as K
from gridloom.operators.mediancut import median_cut
from gridloom.operators.nearest import first_side, nearest


def table(spark, x, image=0, extra=""):
    return spark.createDataFrame([(image, i, *map(int, v)) for i, v in enumerate(x)], f"image_id int, {extra or 'cid'} int, r int, g int, b int")


def test_nearest_of_many_by_brute_force(spark):
    """10^5 colours against 10^3: equal to all pairs, and under a tenth of them met."""
    rng = np.random.default_rng(0)
    x, e = rng.integers(0, 256, (100_000, 3)), rng.integers(0, 256, (1000, 3))
    e[500:510] = e[0]  # repeated entries: the lowest slot
    got = nearest(table(spark, x), table(spark, e, extra="slot"), "image_id", ["cid"]).toPandas().sort_values("cid")
    near = K.nearest(x, e)
    assert len(got) == len(x) and (got.slot.to_numpy() == near).all()
    assert (got.d2.to_numpy() == ((x - e[near]) ** 2).sum(1)).all()
    assert got.met.sum() < 0.1 * len(x) * len(e)


@pytest.mark.parametrize("side", [1, 4, 64, 256, None])
def test_nearest_of_clustered_sparse_and_missing_entries(spark, side):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 256, (200, 3)), [[0, 0, 0], [255, 255, 255], [0, 0, 0]]])
    for entries in ([[255, 255, 255]], rng.integers(0, 9, (40, 3)), [[10, 10, 10], [10, 10, 14], [10, 14, 10]]):
        e = np.array(entries)
        points = table(spark, x).unionByName(table(spark, x[:5], image=1))  # image 1 has no entries
        got = nearest(points, table(spark, e, extra="slot"), "image_id", ["cid"], side=side).toPandas().sort_values("cid")
        assert got.slot.tolist() == K.nearest(x, e).tolist() and set(got.image_id) == {0}
    assert nearest(table(spark, x), table(spark, e, extra="slot").limit(0), "image_id", ["cid"]).count() == 0
    assert nearest(table(spark, x).limit(0), table(spark, e, extra="slot"), "image_id", ["cid"]).count() == 0


def test_first_side():
    assert [first_side(n, 256) for n in (1, 32, 1000, 10**6, 10**9)] == [128, 32, 16, 1, 1]


@pytest.mark.parametrize("k", [1, 2, 7, 40, 500])
def test_median_cut_by_the_kernel(spark, k):
    """Random, clustered, tied and lopsided colours of several images in one table."""
    rng = np.random.default_rng(k)
    source = [rng.integers(0, 64, (300, 3)), rng.integers(0, 4, (60, 3)), np.stack([np.arange(50)] * 3, 1), 2 ** rng.integers(0, 8, (40, 3)), np.array([[7, 7, 7]]), np.array([[0, 0, 0], [0, 0, 1]])]
    rows, want = [], {}
    for i, x in enumerate(source):
        x = np.unique(x, axis=0)
        n = rng.choice([1, 1, 2, 50, 10**6], len(x)) if i % 2 else rng.integers(1, 9, len(x))
        rows += [(i, c, *map(int, v), int(m)) for c, (v, m) in enumerate(zip(x, n, strict=True))]
        pal, of = K.median_cut(x, n, k)
        want |= {(i, c): (int(e), *map(int, pal[e])) for c, e in enumerate(of)}
    d = spark.createDataFrame(rows, "image_id long, cid int, r int, g int, b int, n long")
    got = {(r.image_id, r.cid): (r.entry, r.r, r.g, r.b) for r in median_cut(d, k).collect()}
    assert got == want
    assert median_cut(d.limit(0), k).count() == 0


def test_few_entries_go_to_the_points(spark, monkeypatch):
    """Points aren't shuffled then, and the results are those of the shuffle."""
    from gridloom.operators import nearest as N

    rng = np.random.default_rng(3)
    x, e = rng.integers(0, 256, (300, 3)), rng.integers(0, 256, (50, 3))
    plans, plain = [], N.written
    monkeypatch.setattr(N, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    find = lambda: sorted(map(tuple, nearest(table(spark, x), table(spark, e, extra="slot"), "image_id", ["cid"], distinct=True).collect()))
    few = find()
    assert plans and not any("Exchange hashpartitioning" in line and "cid#" in line for p in plans for line in p.splitlines())
    monkeypatch.setattr(N, "FEW", 0)
    assert few == find() and len(few) == 300
