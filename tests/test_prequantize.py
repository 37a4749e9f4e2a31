"""Images of more colours than all palettes hold."""

import duckdb
import numpy as np
import pytest

from gridloom.operators import kernels as K
from gridloom.plans import images

DIR = "/root/testdata/sf0.001"


def test_many_colours_are_cut_before_packing(spark):
    got = images.quantized_pack(spark, DIR)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    cur = con.execute(images.ORACLE["quantized_pack"])
    cols = [d[0] for d in cur.description]
    rows = sorted(tuple(r) for r in got.select(*cols).collect())
    assert sorted(cols) == sorted(got.columns) and rows == sorted(cur.fetchall())
    assert any(r.prequantized for r in got.collect())
    assert any(r.prequantized for r in images.stats(spark, DIR, 200).collect())


@pytest.mark.parametrize("method", ["none", "floyd", "blue"])
def test_prequantize(spark, method):
    rgb = np.random.default_rng(0).integers(0, 64, (48, 24, 3))
    px = [(i, y, x, *map(int, rgb[y, x]), False) for i, h in ((0, 48), (1, 40)) for y in range(h) for x in range(24)]
    grid = spark.createDataFrame(px, "image_id int, y int, x int, r int, g int, b int, transparent boolean")
    got = {tuple(r[:3]): tuple(r[3:6]) for r in images.prequantize(grid, method).collect()}
    want = {tuple(r[:3]): r[3:6] for r in px}
    assert len(got) == len(px) and all(got[k] == v for k, v in want.items() if k[0] == 1)
    c, of, n = np.unique(rgb.reshape(-1, 3), axis=0, return_inverse=True, return_counts=True)
    pal, entry = K.median_cut(c, n, 1020)
    used = {v for k, v in got.items() if k[0] == 0}
    assert len(c) > 1020 >= len(used) and used <= set(map(tuple, pal.tolist()))
    if method == "none":
        assert all(got[0, y, x] == tuple(pal[entry[of.reshape(48, 24)[y, x]]]) for y in range(48) for x in range(24))
