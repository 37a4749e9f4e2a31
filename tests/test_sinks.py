import numpy as np
import pytest

from gridloom.queries import queries
from gridloom.sources import sinks
from gridloom.sources.grids import vector_grid

DIR = "/root/testdata/sf0.001"


def test_png_round_trip_and_damage():
    rgb = np.random.default_rng(0).integers(0, 256, (7, 5, 3), np.uint8)
    raw = sinks.png(rgb)
    assert (sinks.read_png(raw) == rgb).all()
    with pytest.raises(ValueError, match="damaged"):
        sinks.read_png(raw[:20] + b"\1" + raw[21:])
    with pytest.raises(ValueError, match="no PNG"):
        sinks.read_png(b"")


def test_previews_show_the_grid(spark):
    px = vector_grid(spark, DIR, 64)
    rows = {r.image_id: r for r in queries()["preview_pngs"](spark, DIR).collect()}
    pixels = px.collect()
    assert set(rows) == {p.image_id for p in pixels}
    seen = {i: sinks.read_png(r.png) for i, r in rows.items()}
    assert all(tuple(seen[p.image_id][p.y, p.x]) == tuple(np.rint(np.array([p.r, p.g, p.b]) * 255 / 63)) for p in pixels)


def test_swatch_sheets(spark):
    rows = queries()["swatch_pngs"](spark, DIR).collect()
    assert rows and {(r.width, r.height) for r in rows} == {(256 * 12, 4 * 12)}
    for r in rows:
        sheet = sinks.read_png(r.png)
        cells = sheet.reshape(4, 12, 256, 12, 3)
        assert (cells == cells[:, :1, :, :1]).all() and not cells[:, :, 0].any()
    assert sinks.previews(vector_grid(spark, DIR, 64).limit(0)).count() == 0
