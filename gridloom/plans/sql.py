"""Set-oriented operators as SQL over a grid ``px``, in the dialect that Spark and other
engines share. Every table is keyed by image_id, so windows and joins run image by image.
``{cell}`` stands for the pixels of a cell, ``{top}`` for a channel's highest level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.grids import vector_grid, vector_grid_sql

#: Named steps that queries build on.
STEPS = {
    "colours": """select image_id, r, g, b, cast(dense_rank() over (partition by image_id order by r, g, b) - 1 as int) as cid, n, n_opaque
      from (select image_id, r, g, b, count(*) as n, count(case when not transparent then 1 end) as n_opaque from {px} group by image_id, r, g, b) h""",
    "idpx": "select p.image_id, p.y, p.x, p.r, p.g, p.b, p.transparent, c.cid, cast(floor(p.x / {cell}) as int) as cx from {px} p join colours c on p.image_id = c.image_id and p.r = c.r and p.g = c.g and p.b = c.b",
    "cells": "select image_id, y, cx, cid, count(*) as n from idpx where not transparent group by image_id, y, cx, cid",
    # a fixed assignment of cells to palettes, for operators that take one
    "cell_map": "select image_id, y, cx, cast((y + cx) % 4 as int) as palette from (select distinct image_id, y, cx from idpx) t",
    "entries": "select distinct m.image_id, m.palette, c.cid from cells c join cell_map m on c.image_id = m.image_id and c.y = m.y and c.cx = m.cx",
    "slots": "select image_id, palette, cid, cast(row_number() over (partition by image_id, palette order by cid) as int) as slot from entries",
    "linear": """select image_id, cid, r, g, b,
        case when r * 1.0e0 / {top} <= 0.04045e0 then r * 1.0e0 / {top} / 12.92e0 else power((r * 1.0e0 / {top} + 0.055e0) / 1.055e0, 2.4e0) end as lr,
        case when g * 1.0e0 / {top} <= 0.04045e0 then g * 1.0e0 / {top} / 12.92e0 else power((g * 1.0e0 / {top} + 0.055e0) / 1.055e0, 2.4e0) end as lg,
        case when b * 1.0e0 / {top} <= 0.04045e0 then b * 1.0e0 / {top} / 12.92e0 else power((b * 1.0e0 / {top} + 0.055e0) / 1.055e0, 2.4e0) end as lb from colours""",
    "lms": """select image_id, cid, r, g, b, cbrt(0.4122214708e0 * lr + 0.5363325363e0 * lg + 0.0514459929e0 * lb) as l,
        cbrt(0.2119034982e0 * lr + 0.6806995451e0 * lg + 0.1073969566e0 * lb) as m,
        cbrt(0.0883024619e0 * lr + 0.2817188376e0 * lg + 0.6299787005e0 * lb) as s from linear""",
    "oklab": """select image_id, cid, r, g, b, 0.2104542553e0 * l + 0.7936177850e0 * m - 0.0040720468e0 * s as ok_l,
        1.9779984951e0 * l - 2.4285922050e0 * m + 0.4505937099e0 * s as ok_a, 0.0259040371e0 * l + 0.7827717662e0 * m - 0.8086757660e0 * s as ok_b from lms""",
    # the 32 opaque colours of most pixels, numbered by id, and their mean distance to the nearest other one
    "palette": """select image_id, cid, r, g, b, row_number() over (partition by image_id order by cid) - 1 as slot from
        (select *, row_number() over (partition by image_id order by n_opaque desc, cid desc) as rk from colours) t where rk <= 32""",
    "gaps": """select image_id, avg(sqrt(d2)) as gap from (select a.image_id, a.cid, min((a.r - p.r) * (a.r - p.r) + (a.g - p.g) * (a.g - p.g) + (a.b - p.b) * (a.b - p.b)) as d2
        from palette a join palette p on a.image_id = p.image_id and a.cid <> p.cid group by a.image_id, a.cid) t group by image_id""",
    # an ordered dither's amplitude, 1.5 gaps, in 256ths of a level
    "amplitudes": "select p.image_id, cast(floor(384 * coalesce(max(g.gap), 0) + 0.5e0) as bigint) as amp from palette p left join gaps g on p.image_id = g.image_id group by p.image_id",
    # a palette's shades spread over the 80 pixels from a line's centre outwards, brightest first, widths rounded half to even
    "shades": "select image_id, cid, luma, row_number() over (partition by image_id order by luma desc, cid) as i, count(*) over (partition by image_id) as n from (select image_id, cid, 299 * r + 587 * g + 114 * b as luma from palette) t",
    "bounds": """select image_id, cid, luma, q0 - case when (160 * (i - 1) + n) % (2 * n) = 0 and q0 % 2 = 1 then 1 else 0 end as lo, q1 - case when (160 * i + n) % (2 * n) = 0 and q1 % 2 = 1 then 1 else 0 end as hi
        from (select *, floor((160 * (i - 1) + n) / (2 * n)) as q0, floor((160 * i + n) / (2 * n)) as q1 from shades) t""",
    "ramp": "select image_id, cast(79 - d as int) as x, cid, luma from bounds join range(0, 80) t(d) on d >= lo and d < hi union all select image_id, cast(80 + d as int), cid, luma from bounds join range(0, 80) t(d) on d >= lo and d < hi",
    # an output whose pixels differ from the ideal in a fixed pattern
    "pairs": """select image_id, y, x, cx, transparent, r, g, b, case when (x + 2 * y) % 11 = 0 then least({top}, r + 3) else r end as r2, g as g2,
        case when (x + y) % 13 = 0 then greatest(0, b - 2) else b end as b2 from idpx""",
    "jumps": """select image_id, y, x, (abs(r - pr) + abs(g - pg) + abs(b - pb)) / 3.0e0 as ref, (abs(r2 - pr2) + abs(g2 - pg2) + abs(b2 - pb2)) / 3.0e0 as got
        from (select *, lag(r) over w as pr, lag(g) over w as pg, lag(b) over w as pb, lag(r2) over w as pr2, lag(g2) over w as pg2, lag(b2) over w as pb2,
                lag(transparent) over w as pt from pairs window w as (partition by image_id, y order by x)) t where x > 0 and not transparent and not pt""",
    "columns": "select image_id, x, x % {cell} = 0 as on_grid, avg(ref) as ref, avg(got) as got from jumps group by image_id, x",
}

#: name -> (levels, last step); results keep to integers and rounded doubles.
QUERIES = {
    "grid_pixels": (16, "select image_id, y, x, r, g, b, transparent from {px}"),
    "grid_histogram": (64, "select image_id, r, g, b, count(*) as n from {px} group by image_id, r, g, b"),
    "source_colours": (64, "select image_id, count(*) as pixels, count(distinct (r * 256 + g) * 256 + b) as source_colours, count(distinct case when not transparent then (r * 256 + g) * 256 + b end) as opaque_colours from {px} group by image_id"),
    "master_colours": (64, "select image_id, cid, r, g, b, n, n_opaque from colours"),
    "cell_dictionary": (64, "select image_id, y, cx, cid, n from cells"),
    "cell_sizes": (64, "select image_id, y, cx, count(*) as n_colours, cast(sum(n) as bigint) as n_pixels from cells group by image_id, y, cx"),
    "opaque_filter": (64, "select image_id, count(*) as opaque_pixels from {px} where not transparent group by image_id"),
    "quantize_gate": (32, "select image_id, count(*) as n_colours, count(*) > 4 * 255 as prequantized, least(cast(count(*) as int), 4 * 255) as target from colours group by image_id"),
    "colour_oklab": (64, "select image_id, cid, round(ok_l, 6) as ok_l, round(ok_a, 6) as ok_a, round(ok_b, 6) as ok_b from oklab"),
    "colour_distance": (64, "select a.image_id, a.cid, round(sqrt(power(a.ok_l - b.ok_l, 2) + power(a.ok_a - b.ok_a, 2) + power(a.ok_b - b.ok_b, 2)), 6) as dist from oklab a join oklab b on a.image_id = b.image_id and b.cid = a.cid + 1"),
    "brightness_order": (64, "select image_id, cid, cast(row_number() over (partition by image_id order by 299 * r + 587 * g + 114 * b desc, cid) as int) as shade from colours"),
    "cell_plurality": (64, """select image_id, y, cx, cast(65535 - max(key) % 65536 as int) as palette from
        (select image_id, y, cx, cast(sum(n) as bigint) * 65536 + 65535 - p as key from (select image_id, y, cx, cid % 4 as p, n from cells) v group by image_id, y, cx, p) k group by image_id, y, cx"""),
    "palette_demand": (64, "select m.image_id, m.palette, c.cid, cast(sum(c.n) as bigint) as demand from cells c join cell_map m on c.image_id = m.image_id and c.y = m.y and c.cx = m.cx group by m.image_id, m.palette, c.cid"),
    "top_cap_colours": (16, "select image_id, cid, n_opaque, rk from (select image_id, cid, n_opaque, cast(row_number() over (partition by image_id order by n_opaque desc, cid desc) as int) as rk from colours) t where rk <= 32"),
    "dropped_colours": (16, "select a.image_id, a.cid from colours a left join (select image_id, cid from (select image_id, cid, row_number() over (partition by image_id order by n_opaque desc, cid desc) as rk from colours) t where rk <= 32) k on a.image_id = k.image_id and a.cid = k.cid where k.cid is null"),
    "kept_pixels": (16, "select image_id, count(*) as n from idpx p where exists (select 1 from entries e where e.image_id = p.image_id and e.cid = p.cid and e.palette = 0) group by image_id"),
    "palette_union": (64, "select image_id, count(*) as k_floor from (select image_id, cid from entries where palette = 0 union select image_id, cid from entries where palette = 1) u group by image_id"),
    "palette_difference": (64, "select image_id, cid from entries where palette = 0 except select image_id, cid from entries where palette = 1"),
    "nearest_palette": (64, """select n.image_id, n.cid, e.cid as near_cid, cast(floor(n.near / 32) as bigint) as d2 from (select a.image_id, a.cid,
        min(((a.r - p.r) * (a.r - p.r) + (a.g - p.g) * (a.g - p.g) + (a.b - p.b) * (a.b - p.b)) * 32 + p.slot) as near from colours a join palette p on a.image_id = p.image_id group by a.image_id, a.cid) n
        join palette e on e.image_id = n.image_id and e.slot = n.near % 32"""),
    "second_nearest": (64, "select image_id, round(gap, 6) as amplitude from gaps"),
    "median_split": (64, """select image_id, min(cid) as first_upper, count(*) as n_upper from (select image_id, cid, sum(n) over (partition by image_id order by cid rows between unbounded preceding and current row) as run,
        sum(n) over (partition by image_id) as total from colours) t where 2 * run >= total group by image_id"""),
    "box_means": (64, "select image_id, cast(floor(cid / 32) as int) as box, count(*) as n_colours, round(sum(r * n) * 1.0e0 / sum(n), 6) as mean_r, round(sum(g * n) * 1.0e0 / sum(n), 6) as mean_g from colours group by image_id, cast(floor(cid / 32) as int)"),
    "pack_emit": (64, "select p.image_id, p.y, p.x, m.palette, case when p.transparent then 0 else s.slot end as slot, m.palette * 16 as map_byte from idpx p join cell_map m on p.image_id = m.image_id and p.y = m.y and p.cx = m.cx left join slots s on s.image_id = p.image_id and s.palette = m.palette and s.cid = p.cid"),
    "palette_entries": (64, "select s.image_id, s.palette, s.slot, c.r, c.g, c.b from slots s join colours c on s.image_id = c.image_id and s.cid = c.cid"),
    "reconstruct_roundtrip": (64, """select e.image_id, count(*) as pixels, cast(sum(case when c.r = e.r and c.g = e.g and c.b = e.b then 1 else 0 end) as bigint) as same from
        (select p.*, m.palette, s.slot from idpx p join cell_map m on p.image_id = m.image_id and p.y = m.y and p.cx = m.cx join slots s on s.image_id = p.image_id and s.palette = m.palette and s.cid = p.cid where not p.transparent) e
        join slots s on s.image_id = e.image_id and s.palette = e.palette and s.slot = e.slot join colours c on c.image_id = s.image_id and c.cid = s.cid group by e.image_id"""),
    "palette_duplication": (64, "select image_id, palette, count(*) as colours, cast(sum(case when k = 1 then 1 else 0 end) as bigint) as unique_to_palette from (select image_id, palette, cid, count(*) over (partition by image_id, cid) as k from entries) t group by image_id, palette"),
    "distinct_in_palettes": (64, "select image_id, count(*) - count(distinct cid) as duplicated_across_palettes, count(distinct cid) as distinct_in_all_palettes from entries group by image_id"),
    "neighbour_disagreement": (64, "select a.image_id, a.y, a.cx, cast(sum(case when a.palette <> b.palette then 1 else 0 end) as bigint) as differing from cell_map a join (select image_id, y + dy as y, cx + dx as cx, palette from cell_map, (select 0 as dy, 1 as dx union all select 0, -1 union all select 1, 0 union all select -1, 0) s) b on a.image_id = b.image_id and a.y = b.y and a.cx = b.cx group by a.image_id, a.y, a.cx"),
    "quality_pixels": (64, "select image_id, count(*) as compared_pixels, cast(sum(case when r = r2 and g = g2 and b = b2 then 1 else 0 end) as bigint) as identical_pixels, cast(sum(case when r = r2 and g = g2 and b = b2 then 0 else 1 end) as bigint) as recoloured_pixels from pairs where not transparent group by image_id"),
    "quality_psnr": (64, """select image_id, round(sqrt(mse), 6) as rgb_rmse, case when mse > 0 then round(20 * log10({top}) - 10 * log10(mse), 6) end as psnr_db from
        (select image_id, sum((r - r2) * (r - r2) + (g - g2) * (g - g2) + (b - b2) * (b - b2)) / (3.0e0 * count(*)) as mse from pairs where not transparent group by image_id) t"""),
    "quality_cells": (64, "select image_id, count(*) as cells_compared, cast(sum(bad) as bigint) as cells_damaged, round(100.0e0 * sum(bad) / count(*), 6) as cells_damaged_pct from (select image_id, y, cx, max(case when r = r2 and g = g2 and b = b2 then 0 else 1 end) as bad from pairs where not transparent group by image_id, y, cx) t group by image_id"),
    "quality_oklab": (64, """select p.image_id, round(avg(sqrt(power(a.ok_l - b.ok_l, 2) + power(a.ok_a - b.ok_a, 2) + power(a.ok_b - b.ok_b, 2))), 6) as mean_oklab_error,
        round(max(sqrt(power(a.ok_l - b.ok_l, 2) + power(a.ok_a - b.ok_a, 2) + power(a.ok_b - b.ok_b, 2))), 6) as max_oklab_error
        from idpx p join oklab a on p.image_id = a.image_id and p.cid = a.cid join oklab b on p.image_id = b.image_id and b.cid = case when (p.x + p.y) % 5 = 0 then greatest(p.cid - 1, 0) else p.cid end where not p.transparent group by p.image_id"""),
    "adjacent_jumps": (64, "select image_id, y, x, round(ref, 6) as ref, round(got, 6) as got from jumps"),
    "quality_seams": (64, """select image_id, round(case when ref_on <> 0 and ref_off <> 0 and got_off <> 0 then (got_on / got_off) / (ref_on / ref_off) end, 6) as seam_index from
        (select image_id, avg(case when on_grid then ref end) as ref_on, avg(case when not on_grid then ref end) as ref_off, avg(case when on_grid then got end) as got_on, avg(case when not on_grid then got end) as got_off from columns group by image_id) t"""),
    "mask_dilate": (64, "select image_id, y, x, max(case when q.r > 40 then 1 else 0 end) as on_mask from (select p.image_id, p.y, p.x, n.r from {px} p join (select image_id, y + dy as y, x + dx as x, r from {px}, (select 0 as dy, 0 as dx union all select 0, 1 union all select 0, -1 union all select 1, 0 union all select -1, 0) s) n on n.image_id = p.image_id and n.y = p.y and n.x = p.x) q group by image_id, y, x"),
    "mask_shift": (64, "select p.image_id, p.y, p.x, coalesce(q.r > 40, false) as on_mask from {px} p left join {px} q on q.image_id = p.image_id and q.y = p.y - 1 and q.x = p.x - 2"),
    "mask_spans": (64, """select image_id, y, min(x) as x0, max(x) as x1 from (select image_id, y, x, x - row_number() over (partition by image_id, y order by x) as island from {px} where r > 30) t group by image_id, y, island"""),
    "map_codec": (64, "select image_id, y, cx, palette * 16 as encoded, cast(floor(palette * 16 / 16) as int) as decoded from cell_map"),
}


def _tiles(n: int) -> str:
    from ..operators.kernels import bayer

    return " union all ".join(f"select {y} as ty, {x} as tx, {int(v)} as rank" for y, row in enumerate(bayer(n)) for x, v in enumerate(row))


for _n in (2, 4, 8):
    _u = 2 * _n * _n
    STEPS[f"tile{_n}"] = _tiles(_n)
    # a colour at one place of the tile always gets the same entry, so it is looked up once
    STEPS[f"shades{_n}"] = f"""select distinct p.image_id, p.cid, p.r, p.g, p.b, t.ty, t.tx, a.amp * (2 * t.rank + 1 - {_n * _n}) as shift
        from idpx p join tile{_n} t on t.ty = p.y % {_n} and t.tx = p.x % {_n} join amplitudes a on a.image_id = p.image_id"""
    _d = " + ".join(f"(({c} - e.{c[2]}) * {256 * _u} + s.shift) * (({c} - e.{c[2]}) * {256 * _u} + s.shift)" for c in ("s.r", "s.g", "s.b"))
    STEPS[f"chosen{_n}"] = f"select s.image_id, s.cid, s.ty, s.tx, min(({_d}) * 32 + e.slot) % 32 as slot from shades{_n} s join palette e on e.image_id = s.image_id group by s.image_id, s.cid, s.ty, s.tx"
    QUERIES[f"ordered_dither_bayer{_n}"] = (64, f"""select p.image_id, p.y, p.x, cast(e.cid as bigint) as near_cid from idpx p
        join chosen{_n} c on c.image_id = p.image_id and c.cid = p.cid and c.ty = p.y % {_n} and c.tx = p.x % {_n} join palette e on e.image_id = c.image_id and e.slot = c.slot""")  # fmt: skip


del QUERIES["brightness_order"]
QUERIES["shades_by_luma"] = (64, "select image_id, cid, luma, cast(row_number() over (partition by image_id order by luma desc, cid) as int) as shade from (select image_id, cid, 299 * r + 587 * g + 114 * b as luma from colours) t")
QUERIES["separator_ramp"] = (64, "select image_id, x, cid from ramp")
# a character covers two pixels and takes the brighter one's colour, of which it reaches the first 128
QUERIES["rule_pens"] = (64, """select image_id, cast(floor(x / 2) as int) as place, cid % 128 as pen from
    (select *, row_number() over (partition by image_id, floor(x / 2) order by luma desc, cid desc) as rk from ramp) t where rk = 1""")
# the same of bytes a channel
for _n in ("colour_oklab", "colour_distance", "quality_psnr", "quality_oklab"):
    QUERIES[f"{_n}_bytes"] = (256, QUERIES[_n][1])
# a label in 21 columns, a colon and a value that begins with a capital
QUERIES["report_rows"] = (64, """select image_id, line_no, rpad(label, 21, ' ') || ': ' || upper(substr(value, 1, 1)) || substr(value, 2) as line from
    (select image_id, 1 as line_no, 'Dimensions' as label, cast(max(x) + 1 as varchar(20)) || ' x ' || cast(max(y) + 1 as varchar(20)) || '  (' || cast(count(*) as varchar(20)) || ' px)' as value from {px} group by image_id
     union all select image_id, 2, 'Resampled', 'none (native ' || cast(max(x) + 1 as varchar(20)) || 'x' || cast(max(y) + 1 as varchar(20)) || ')' from {px} group by image_id
     union all select image_id, 3, 'Transparent px', cast(count(*) as varchar(20)) || ' letterbox/pillarbox -> index 0' from {px} where transparent group by image_id
     union all select image_id, 4, 'Master colours', cast(count(*) as varchar(20)) from colours group by image_id
     union all select image_id, 5, 'Identical pixels', cast(sum(case when r = r2 and g = g2 and b = b2 then 1 else 0 end) as varchar(20)) || ' / ' || cast(count(*) as varchar(20)) from pairs where not transparent group by image_id) t""")  # fmt: skip


def with_steps(body: str) -> str:
    """``body`` behind the steps it needs, in order."""
    import re

    need: list[str] = []

    def visit(text: str) -> None:
        for name in STEPS:
            if re.search(rf"\b(from|join)\s+{name}\b", text) and name not in need:
                visit(STEPS[name])
                need.append(name)

    visit(body)
    return ("with " + ", ".join(f"{n} as ({STEPS[n]})" for n in need) + " " if need else "") + body


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    levels, body = QUERIES[name]
    return spark.sql(sized(with_steps(body), levels, 8), px=vector_grid(spark, sf_dir, levels))


def sized(text: str, levels: int = 64, cell: int = 8) -> str:
    return text.replace("{top}", str(levels - 1)).replace("{cell}", str(cell))


def step(spark: SparkSession, grid: DataFrame, name: str, levels: int = 64, cell: int = 8) -> DataFrame:
    """A named step over any grid."""
    return spark.sql(sized(with_steps(f"select * from {name}"), levels, cell), px=grid)


def oracle(name: str) -> str:
    levels, body = QUERIES[name]
    sql = sized(with_steps(body), levels, 8).replace("{px}", "px")
    head = f"with px as ({vector_grid_sql(levels)})"
    return f"{head}, {sql.removeprefix('with ')}" if sql.startswith("with ") else f"{head} {sql}"
