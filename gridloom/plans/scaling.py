"""Resampling queries over the vector grid, with SQL that works weights out by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resize import BITS, resize
from ..sources.grids import HEIGHT, WIDTH, vector_grid, vector_grid_sql

TO = (14, 24)
#: Lines of an image in the three grids of ``resize_mixed``.
MIXED = (40, 25, 60)


def _scaled(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All images of the grid, levels as bytes, at 14 x 24; the last one may be smaller than the others."""
        return resize(vector_grid(spark, sf_dir, 256), TO, name).drop("transparent")

    return query


def resize_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of three sizes (grids of 40, 25 and 60 lines) in one table, at 14 x 24 with room at two sides."""
    grids = [vector_grid(spark, sf_dir, 256, h).withColumn("image_id", F.col("image_id") * 3 + k) for k, h in enumerate(MIXED)]
    return resize(grids[0].unionByName(grids[1]).unionByName(grids[2]), TO, "bilinear", "fit", 1.0)


#: The filters' shapes at a distance {d}, in SQL.
_SINC = "case when {d} = 0 then 1.0e0 else sin(pi() * {d}) / (pi() * {d}) end"
_SHAPES = {
    "box": "case when {d} > -0.5e0 and {d} <= 0.5e0 then 1.0e0 else 0.0e0 end",
    "bilinear": "case when abs({d}) < 1 then 1.0e0 - abs({d}) else 0.0e0 end",
    "hamming": f"case when abs({{d}}) < 1 then {_SINC} * (0.54e0 + 0.46e0 * cos(pi() * {{d}})) else 0.0e0 end",
    "bicubic": "case when abs({d}) < 1 then 1.0e0 - 2.5e0 * abs({d}) * abs({d}) + 1.5e0 * abs({d}) * abs({d}) * abs({d}) when abs({d}) < 2 then 2.0e0 - 4.0e0 * abs({d}) + 2.5e0 * abs({d}) * abs({d}) - 0.5e0 * abs({d}) * abs({d}) * abs({d}) else 0.0e0 end",
    "lanczos": f"case when abs({{d}}) < 3 then {_SINC} * {_SINC.replace('{d}', '({d} / 3)')} else 0.0e0 end",
}
_HALF = {"box": 0.5, "bilinear": 1.0, "hamming": 1.0, "bicubic": 2.0, "lanczos": 3.0}


def _taps(name: str, size: int, to: int) -> str:
    """SQL of (o, i, w): each output's weights, normalised and rounded."""
    scale, half = size / to, _HALF[name]
    wide = max(scale, 1.0)
    return f"""select o, i, cast(case when v < 0 then -floor(-v / sum(v) over (partition by o) * {1 << BITS} + 0.5e0) else floor(v / sum(v) over (partition by o) * {1 << BITS} + 0.5e0) end as bigint) as w from
        (select o, i, {_SHAPES[name].replace("{d}", "d")} as v from (select o, i, (i - (o + 0.5e0) * {scale!r}e0 + 0.5e0) / {wide!r}e0 as d
        from range(0, {to}) a(o), range(0, {size}) b(i) where i >= greatest(0, cast(trunc((o + 0.5e0) * {scale!r}e0 - {half * wide!r}e0 + 0.5e0) as int)) and i < least({size}, cast(trunc((o + 0.5e0) * {scale!r}e0 + {half * wide!r}e0 + 0.5e0) as int))) s) t"""


def _sum(c: str) -> str:
    return f"cast(greatest(0, least(255, (cast(sum({c} * w) as bigint) + {1 << BITS - 1}) >> {BITS})) as int) as {c}"


def _oracle(name: str) -> str:
    (w, h) = TO
    px = f"px as ({vector_grid_sql(256)}), size as (select image_id, max(y) + 1 as height from px group by image_id)"
    return f"with {px}, {_resampled(name, [(k, h) for k in range(1, HEIGHT + 1)], WIDTH, w)}"


def _resampled(name: str, heights: list[tuple[int, int]], width: int, to: int) -> str:
    """SQL of px resampled from ``width`` to ``to`` and from each height to its own; size(image_id, height) says which."""
    h = TO[1]
    if name == "nearest":
        return f"out as (select p.image_id, cast(oy as int) as y, cast(ox as int) as x, r, g, b from px p join size s on p.image_id = s.image_id, range(0, {to}) a(ox), range(0, {h}) b(oy) where x = cast(trunc((ox + 0.5e0) * {width / to!r}e0) as int) and y = cast(trunc((oy + 0.5e0) * (height * 1.0e0 / {h})) as int)) select * from out"
    rgb = ", ".join(_sum(c) for c in "rgb")
    ty = " union all ".join(f"select {n} as height, {k} as inner_h, o, i, w from ({_taps(name, n, k)}) t{n}" for n, k in heights)
    return f"""tx as ({_taps(name, width, to)}), ty as ({ty}),
        across as (select image_id, y, o as x, {rgb} from px join tx on px.x = tx.i group by image_id, y, o),
        out as (select a.image_id, cast(o as int) as y, cast(x as int) as x, {rgb} from across a join size s on a.image_id = s.image_id join ty on a.y = ty.i and s.height = ty.height group by a.image_id, o, x) select * from out"""


def _oracle_mixed() -> str:
    """Heights of up to 60 lines each get the size that fits 14 x 24 square pixels' shape; the rest is padding."""
    w, h = TO
    from math import floor

    even = lambda v: floor(v) if v - floor(v) < 0.5 or v - floor(v) == 0.5 and floor(v) % 2 == 0 else floor(v) + 1
    pixel, inner = 1.0 * h / w, []
    for n in range(1, max(MIXED) + 1):
        tall = even(w * pixel / (WIDTH / n))
        inner.append((n, h, max(1, min(w, even(h * (WIDTH / n) / pixel)))) if tall > h else (n, max(1, min(h, tall)), w))
    rgb = ", ".join(_sum(c) for c in "rgb")
    grids = " union all ".join(f"select image_id * 3 + {k} as image_id, y, x, r, g, b from ({vector_grid_sql(256, n)}) g{k}" for k, n in enumerate(MIXED))
    tx = " union all ".join(f"select {k} as n, o, i, w from ({_taps('bilinear', WIDTH, k)}) x{k}" for k in sorted({c for _, _, c in inner}))
    ty = " union all ".join(f"select {n} as height, o, i, w from ({_taps('bilinear', n, k)}) y{n}" for n, k, _ in inner)
    sizes = " union all ".join(f"select {n} as height, {k} as ih, {c} as iw" for n, k, c in inner)
    return f"""with px as ({grids}), s as (select z.image_id, t.* from (select image_id, max(y) + 1 as height from px group by image_id) z join ({sizes}) t on z.height = t.height), tx as ({tx}), ty as ({ty}),
        across as (select p.image_id, y, o as x, {rgb} from px p join s on p.image_id = s.image_id join tx on p.x = tx.i and s.iw = tx.n group by p.image_id, y, o),
        small as (select a.image_id, o + (({h} - ih) // 2) as y, x + (({w} - iw) // 2) as x, {rgb} from across a join s on a.image_id = s.image_id join ty on a.y = ty.i and s.height = ty.height group by a.image_id, o, x, ih, iw)
        select s.image_id, cast(oy as int) as y, cast(ox as int) as x, coalesce(r, 0) as r, coalesce(g, 0) as g, coalesce(b, 0) as b, r is null as transparent
        from s join range(0, {h}) v(oy) on true join range(0, {w}) u(ox) on true left join small m on m.image_id = s.image_id and m.y = oy and m.x = ox"""


QUERIES = {f"resize_{n}": _scaled(n) for n in ("nearest", "box", "bilinear", "hamming", "bicubic", "lanczos")} | {"resize_mixed": resize_mixed}
ORACLE = {f"resize_{n}": _oracle(n) for n in ("nearest", "box", "bilinear", "hamming", "bicubic", "lanczos")} | {"resize_mixed": _oracle_mixed()}
