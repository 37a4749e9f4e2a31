"""Ordered dithers over an image's own palette."""

import numpy as np
import pytest

from gridloom.operators import kernels as K
from gridloom.plans import images


@pytest.mark.parametrize("method", ["bayer4", "blue"])
def test_ordered_dither_by_definition(spark, method):
    rgb = np.random.default_rng(0).integers(0, 64, (20, 70, 3))
    px = [(0, y, x, *map(int, rgb[y, x])) for y in range(20) for x in range(70)]
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in images.dither(spark.createDataFrame(px, "image_id int, y int, x int, r int, g int, b int"), method).collect()}
    c, n = np.unique(rgb.reshape(-1, 3), axis=0, return_counts=True)
    pal = np.unique(K.median_cut(c, n, 32)[0], axis=0)
    gap = np.mean([sorted(np.sqrt(((p - pal) ** 2).sum(1)))[1] for p in pal])
    m = K.blue_noise(64) if method == "blue" else K.bayer(4)
    for y in range(20):
        for x in range(70):
            v = rgb[y, x] + 1.5 * gap * ((m[y % len(m), x % len(m)] + 0.5) / m.size - 0.5)
            assert got[y, x] == tuple(pal[((v - pal) ** 2).sum(1).argmin()])


def test_blue_mask_is_whole():
    assert sorted(K.blue_noise().ravel()) == list(range(64 * 64))


def test_sql_dither_by_definition(spark):
    """The SQL dithers against plain sums: the 32 opaque colours of most pixels, 1.5 mean gaps as amplitude."""
    from gridloom.plans import sql
    from gridloom.sources.grids import vector_grid

    sf = "/root/testdata/sf0.001"
    px = vector_grid(spark, sf, 64).filter("image_id = 3").toPandas()
    rgb = px[["r", "g", "b"]].to_numpy()
    c, of = np.unique(rgb, axis=0, return_inverse=True)
    n = np.bincount(of.reshape(-1), ~px.transparent, len(c))
    ids = np.array(sorted(sorted(range(len(c)), key=lambda i: (-n[i], -i))[:32]))
    pal = c[ids]
    gap = np.mean([sorted(np.sqrt(((p - pal) ** 2).sum(1)))[1] for p in pal])
    got = {r.image_id: r.amplitude for r in sql.run(spark, sf, "second_nearest").collect()}
    assert got[3] == pytest.approx(gap, abs=1e-6)
    near = {r.cid: r.near_cid for r in sql.run(spark, sf, "nearest_palette").filter("image_id = 3").collect()}
    assert near == {i: ids[((c[i] - pal) ** 2).sum(1).argmin()] for i in range(len(c))}
    amp = np.floor(384 * gap + 0.5) / 256
    for side in (2, 4):
        m = K.bayer(side)
        got = {(r.y, r.x): r.near_cid for r in sql.run(spark, sf, f"ordered_dither_bayer{side}").filter("image_id = 3").collect()}
        for y, x, v in zip(px.y, px.x, rgb, strict=True):
            t = v + amp * ((m[y % side, x % side] + 0.5) / m.size - 0.5)
            assert got[y, x] == ids[((t - pal) ** 2).sum(1).argmin()]
