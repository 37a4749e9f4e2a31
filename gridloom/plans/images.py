"""Whole-image operators: relational steps where order doesn't matter, one image per task
(grouped pandas) where it does. Their SQL checks hold what any right result must satisfy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import kernels as K
from ..operators.mediancut import median_cut as cut_colours
from ..operators.nearest import nearest
from ..sources import sinks
from ..sources.grids import HEIGHT, vector_grid, vector_grid_sql
from . import sql

NP, CAP = 4, 255


def _components(spark: SparkSession, sf_dir: str, levels: int = 64) -> DataFrame:
    return C.colour_components(sql.step(spark, vector_grid(spark, sf_dir, levels), "cells"))


def cooccurrence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir)


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).groupBy("image_id", "comp").agg(F.count("*").alias("n_colours"))


def phase_a_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = component_sizes(spark, sf_dir).select("image_id", "comp", F.col("n_colours").cast("int").alias("size"))
    return C.best_fit(sizes, NP, CAP)


def phase_a_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phase_a_packing(spark, sf_dir).filter("palette is not null")
    return p.groupBy("image_id", "palette").agg(F.count("*").alias("components"), F.sum("size").alias("colours"))


def phase_a_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = phase_a_packing(spark, sf_dir)
    fill = p.groupBy("image_id", "palette").agg(F.sum("size").alias("s"))
    return fill.groupBy("image_id").agg(F.sum("s").alias("colours"), (F.max("s") <= CAP).alias("within_cap"))


def _per_image(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy("image_id").applyInPandas(kernel, schema)


def median_cut_map(spark: SparkSession, sf_dir: str, k: int = 32) -> DataFrame:
    """Each colour's palette entry and the entry's mean colour."""
    return cut_colours(sql.step(spark, vector_grid(spark, sf_dir, 64), "colours").select("image_id", "cid", "r", "g", "b", "n"), k)


def median_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per image: colours mapped, palette entries, and entries that aren't their colours' rounded mean."""
    n = sql.step(spark, vector_grid(spark, sf_dir, 64), "colours").select("image_id", "cid", "n", *[F.col(c).alias(f"c{c}") for c in "rgb"])
    m = median_cut_map(spark, sf_dir).join(n, ["image_id", "cid"])
    mean = [F.bround(F.sum(F.col(f"c{c}") * F.col("n")) / F.sum("n"), 0) == F.max(c) for c in "rgb"]
    e = m.groupBy("image_id", "entry").agg(F.count("*").alias("k"), (mean[0] & mean[1] & mean[2]).alias("ok"))
    return e.groupBy("image_id").agg(F.sum("k").alias("mapped_colours"), F.count("*").alias("entries"), F.count_if(~F.col("ok")).alias("wrong_means"))


def nearest_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every colour of the whole grid with the nearest of the 1024 colours of most pixels (ties by colour)."""
    n = C.written(vector_grid(spark, sf_dir, 256).groupBy("r", "g", "b").agg(F.count("*").alias("n"))).withColumn("grid", F.lit(0))
    code = (F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("slot")
    top = C.written(n.orderBy(F.desc("n"), "r", "g", "b").limit(1024).select("grid", code, "r", "g", "b"))
    got = nearest(n.drop("n"), top, "grid", [], distinct=True)
    return got.select("r", "g", "b", F.col("slot").alias("near"), F.col("d2").cast("int").alias("d2"))


def _mask(method: str) -> np.ndarray | None:
    """Ranks of an ordered dither's tile, made once a query: bayer2, bayer4, bayer8 or blue."""
    return K.blue_noise() if method == "blue" else K.bayer(int(method[5:])) if method.startswith("bayer") else None


def _entries(img: np.ndarray, pal: np.ndarray, method: str, strength: float, m: np.ndarray | None) -> np.ndarray:
    """Palette index of each pixel under an error-diffusion kernel, or with the ranks ``m`` of a tile."""
    if m is None:
        return K.diffuse(img, pal, method, strength)
    h, w, _ = img.shape
    gap = np.sqrt(np.sort(((pal[:, None] - pal[None]) ** 2).sum(2), 1)[:, 1:2]).mean() if len(pal) > 1 else 0.0
    t = ((m + 0.5) / m.size - 0.5)[np.arange(h)[:, None] % len(m), np.arange(w)[None] % len(m)]
    return K.nearest((img + 1.5 * strength * gap * t[..., None]).reshape(-1, 3), pal).reshape(h, w)


def prequantize(grid: DataFrame, method: str = "none", strength: float = 1.0, most: int = NP * CAP, target: int | None = None) -> DataFrame:
    """The grid, with images of more than ``most`` colours (padding included) cut to a
    median-cut palette of ``target`` (by default that many) and dithered to it; other images stay as they are."""
    grid = grid.select("image_id", "y", "x", "r", "g", "b", "transparent")
    colours = grid.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    over = C.cut(colours.groupBy("image_id").agg(F.count("*").alias("k")).filter(F.col("k") > most).select("image_id"))
    if not over.head(1):
        return grid
    colours = colours.join(over, "image_id", "left_semi").withColumn("cid", F.row_number().over(Window.partitionBy("image_id").orderBy("r", "g", "b")) - 1)
    found = C.cut(cut_colours(colours, target or most).select("image_id", "cid", "entry", *[F.col(c).alias(f"e{c}") for c in "rgb"]))
    if method == "none":
        to = colours.join(found, ["image_id", "cid"]).select("image_id", "r", "g", "b", "er", "eg", "eb")
        px = grid.join(to, ["image_id", "r", "g", "b"], "left")
        return px.select("image_id", "y", "x", *[F.coalesce(f"e{c}", c).alias(c) for c in "rgb"], "transparent")
    mask = _mask(method)

    def kernel(pdf: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1, 3))
        img[pdf.y, pdf.x] = pdf[["r", "g", "b"]]
        pal = entries.sort_values("entry")[["er", "eg", "eb"]].to_numpy()
        at = _entries(img, pal, method, strength, mask)[pdf.y, pdf.x]
        return pdf.assign(r=pal[at, 0], g=pal[at, 1], b=pal[at, 2])

    entries = found.drop("cid").distinct()
    entries = entries.toDF(*entries.columns)  # columns of its own, as both sides come from the grid
    done = grid.join(over, "image_id", "left_semi").groupBy("image_id").cogroup(entries.groupBy("image_id")).applyInPandas(kernel, grid.schema)
    return grid.join(over, "image_id", "left_anti").unionByName(done)


def dither(grid: DataFrame, method: str, k: int = 32, strength: float = 1.0) -> DataFrame:
    """Pixels with palette entries: an error-diffusion kernel, ``blue`` or ``bayer2``, ``bayer4``, ``bayer8``, per image."""
    mask = _mask(method)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h, w = pdf.y.max() + 1, pdf.x.max() + 1
        img = np.zeros((h, w, 3))
        img[pdf.y, pdf.x] = pdf[["r", "g", "b"]]
        c, n = np.unique(pdf[["r", "g", "b"]].to_numpy(), axis=0, return_counts=True)
        pal, _ = K.median_cut(c, n, k)
        pal = np.unique(pal, axis=0)
        at = _entries(img, pal, method, strength, mask)[pdf.y, pdf.x]
        return pdf[["image_id", "y", "x"]].assign(entry=at, r=pal[at, 0], g=pal[at, 1], b=pal[at, 2])

    return _per_image(grid.select("image_id", "y", "x", "r", "g", "b"), kernel, "image_id int, y int, x int, entry int, r int, g int, b int")


def _dithered(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Per image: pixels, those whose colour isn't one of 32 of its palette, and whether the mean colour is kept."""
        grid = vector_grid(spark, sf_dir, 64)
        pal = median_cut_map(spark, sf_dir).select("image_id", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"), F.lit(True).alias("known")).distinct()
        d = dither(grid, method).select("image_id", "y", "x", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))
        x = grid.join(d, ["image_id", "y", "x"], "left").join(pal, ["image_id", "pr", "pg", "pb"], "left")
        drift = [F.abs(F.avg(F.col(c) - F.col(f"p{c}"))) < 1.5 for c in "rgb"]
        return x.groupBy("image_id").agg(F.count("*").alias("pixels"), F.count_if(F.col("known").isNull()).alias("off_palette"), (drift[0] & drift[1] & drift[2]).alias("mean_kept"))

    return query


def pack(grid: DataFrame, strategy: str = "auto", bias: float = 0.5, coherence: float = 1.5, bins: int = NP, cap: int = CAP, levels: int = 64, optimize: bool = True, cell: int = 8, seed: int = 0) -> DataFrame:
    """Cells with palettes: (image_id, y, cx, palette, entries, cids, outs, strategy, components, largest),
    where outs are what the cell's colours cids become, and components those of colours that share cells. A cell is ``cell`` pixels of a line; ``seed`` is that of the
    clusters that fidelity and balanced packing begin with.

    ``auto`` takes lossless packing where components fit, else fidelity for a bias of 0 and
    balanced otherwise. An image of more colours than all palettes hold is one that
    ``prequantize`` hasn't seen, an error.
    """
    cells = sql.step(grid.sparkSession, grid, "cells", levels, cell)
    colours = sql.step(grid.sparkSession, grid, "colours").select("image_id", "cid", "r", "g", "b")
    shape = grid.groupBy("image_id").agg((F.max("y") + 1).alias("height"), F.floor(F.max("x") / cell + 1).cast("int").alias("across"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        img = int(pdf.image_id.iloc[0])
        rgb = pdf.drop_duplicates("cid").sort_values("cid")
        ids = rgb.cid.to_numpy()
        if len(ids) > bins * cap:
            raise ValueError(f"image {img} has {len(ids)} colours, prequantize it first")
        lab = K.oklab(rgb[["r", "g", "b"]].to_numpy() / (levels - 1.0))
        pdf = pdf.sort_values(["y", "cx", "cid"])
        place = pdf[["y", "cx"]].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(1)]))
        c = K.Cells(place[first, 0], place[first, 1], np.append(first, len(pdf)), np.searchsorted(ids, pdf.cid), pdf.n.to_numpy(), len(ids))
        of = _joined(c)
        group_sizes = np.bincount(of)
        bin_of = K.best_fit(group_sizes.tolist(), bins, cap) if strategy == "auto" else None
        if bin_of is not None:
            group = np.array(bin_of)[of]
            where, used = group[c.colour[c.at[:-1]]], "lossless"
            entries, become = [np.flatnonzero(group == b) for b in range(bins)], np.tile(np.arange(len(ids)), (bins, 1))
        else:
            where, entries, become = K.fidelity(c, lab, bins, cap, optimize, seed)
            used = "fidelity"
            if strategy == "balanced" or strategy == "auto" and bias > 0:
                floor = len(np.unique(np.concatenate(entries)))
                where, entries, become = K.balanced(c, lab, (int(pdf.height.iloc[0]), int(pdf.across.iloc[0])), bias, floor, coherence, bins, cap, seed)
                used = "balanced"
        held = [ids[e].tolist() for e in entries]
        out = ids[become[where[c.of], c.colour]]
        parts = lambda x: [p.tolist() for p in np.split(x, c.at[1:-1])]
        return pd.DataFrame({"image_id": img, "y": c.y, "cx": c.cx, "palette": where, "entries": [held[b] for b in where], "cids": parts(ids[c.colour]), "outs": parts(out), "strategy": used, "components": len(group_sizes), "largest": int(group_sizes.max())})

    kind = f"image_id {dict(grid.dtypes)['image_id']}, y int, cx int, palette int, entries array<int>, cids array<int>, outs array<int>, strategy string, components int, largest int"
    return _per_image(cells.join(colours, ["image_id", "cid"]).join(shape, "image_id"), kernel, kind)


def _joined(c: K.Cells) -> np.ndarray:
    """Component of each colour, numbered by least colour: labels fall to the least of their cells' colours
    and on to that one's label until nothing changes."""
    of = np.arange(c.colours)
    while True:
        least = np.minimum.reduceat(of[c.colour], c.at[:-1])
        new = of.copy()
        np.minimum.at(new, c.colour, least[c.of])
        new = np.minimum(new, new[new])
        if (new == of).all():
            return np.unique(of, return_inverse=True)[1]
        of = new


def packed_pixels(grid: DataFrame, packed: DataFrame, cell: int = 8) -> DataFrame:
    """Every opaque pixel with its palette, slot and output colour."""
    spark = grid.sparkSession
    idpx, colours = sql.step(spark, grid, "idpx", cell=cell).filter("not transparent"), sql.step(spark, grid, "colours")
    out = colours.select("image_id", F.col("cid").alias("out_cid"), F.col("r").alias("r2"), F.col("g").alias("g2"), F.col("b").alias("b2"))
    each = packed.select("image_id", "y", "cx", "palette", "entries", F.inline(F.arrays_zip(F.col("cids").alias("cid"), F.col("outs").alias("out_cid"))))
    each = each.withColumn("slot", F.array_position("entries", F.col("out_cid")).cast("int")).drop("entries")
    px = idpx.join(each, ["image_id", "y", "cx", "cid"], "left").join(out, ["image_id", "out_cid"], "left")
    return px.select("image_id", "y", "x", "cx", "palette", "r", "g", "b", "cid", "slot", "out_cid", "r2", "g2", "b2", (F.col("cid") != F.col("out_cid")).alias("recoloured"))


def _packed(strategy: str, levels: int, height: int = HEIGHT):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Per image: pixels, cells, and counts that must be 0: pixels without a slot of their palette, palettes
        over the cap, cells of two palettes, recoloured pixels whose palette has their colour, and those with
        a nearer entry in OKLab than the one they got."""
        return _pack_figures(C.cut(prequantize(vector_grid(spark, sf_dir, levels, height))), strategy, levels)

    return query


def _pack_figures(grid: DataFrame, strategy: str, levels: int) -> DataFrame:
    """What ``_packed`` returns of a grid that is written and within the budget."""
    p = C.cut(pack(grid, strategy, levels=levels))
    px = packed_pixels(grid, p)
    sizes = p.groupBy("image_id").agg(F.count_if(F.size("entries") > CAP).alias("over_cap"))
    lab = sql.step(grid.sparkSession, grid, "oklab", levels).select("image_id", "cid", *[F.col(f"ok_{c}").alias(c) for c in "lab"])
    ask = px.filter("recoloured").select("image_id", "palette", "cid", "out_cid").distinct()
    own = p.select("image_id", "palette", "entries").dropDuplicates(["image_id", "palette"]).select("image_id", "palette", F.explode("entries").alias("e"))
    a, b, e = (lab.select("image_id", F.col("cid").alias(c), F.struct("l", "a", "b").alias(f"lab_{c}")) for c in ("cid", "out_cid", "e"))
    gap = lambda u, v: sum((F.col(f"{u}.{k}") - F.col(f"{v}.{k}")) ** 2 for k in "lab")
    worse = ask.join(own, ["image_id", "palette"]).join(a, ["image_id", "cid"]).join(b, ["image_id", "out_cid"]).join(e, ["image_id", "e"])
    worse = worse.filter((F.col("e") == F.col("cid")) | (gap("lab_cid", "lab_e") < gap("lab_cid", "lab_out_cid") - 1e-12)).groupBy("image_id").agg(F.countDistinct("palette", "cid").alias("not_nearest"))
    q = px.groupBy("image_id").agg(F.count("*").alias("compared_pixels"), F.count_if(F.coalesce(F.col("slot"), F.lit(0)) < 1).alias("without_slot"), F.countDistinct("y", "cx").alias("cells"), (F.countDistinct("y", "cx", "palette") - F.countDistinct("y", "cx")).alias("split_cells"))
    return q.join(sizes, "image_id").join(worse, "image_id", "left").withColumn("not_nearest", F.coalesce("not_nearest", F.lit(0)))


def quantized_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of images of 200 vectors, which exceed all palettes' colours: how many there were, and are."""
    source = vector_grid(spark, sf_dir, 64, 200)
    grid = C.cut(prequantize(source))
    left = grid.groupBy("image_id").agg((F.countDistinct("r", "g", "b") <= NP * CAP).alias("within_budget"))
    had = source.groupBy("image_id").agg(F.countDistinct("r", "g", "b").alias("source_colours"))
    q = _pack_figures(grid, "auto", 64).join(had, "image_id").join(left, "image_id")
    return q.withColumn("prequantized", F.col("source_colours") > NP * CAP)


def stats(spark: SparkSession, sf_dir: str, height: int = HEIGHT) -> DataFrame:
    """One row of figures per image, and its JSON."""
    source = vector_grid(spark, sf_dir, 64, height)
    grid = C.cut(prequantize(source))
    px = packed_pixels(grid, C.cut(pack(grid)))
    s = px.groupBy("image_id").agg(
        F.count("*").alias("compared_pixels"),
        F.count_if("recoloured").alias("recoloured_pixels"),
        F.countDistinct("r2", "g2", "b2").alias("output_colours"),
        F.countDistinct("palette").alias("palettes_used"),
    )
    s = s.join(source.groupBy("image_id").agg(F.countDistinct("r", "g", "b").alias("source_colours")), "image_id")
    s = s.withColumn("prequantized", F.col("source_colours") > NP * CAP)
    s = s.withColumn("lossless", F.col("recoloured_pixels") == 0)
    return s.withColumn("stats_json", F.to_json(F.struct("*")))


def preview_pngs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.previews(vector_grid(spark, sf_dir, 64))


def swatch_pngs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of the palettes of a fixed assignment of cells."""
    px = vector_grid(spark, sf_dir, 64)
    slots = sql.step(spark, px, "slots").join(sql.step(spark, px, "colours"), ["image_id", "cid"])
    return sinks.swatch_sheets(slots)


QUERIES = {
    "preview_pngs": preview_pngs,
    "swatch_pngs": swatch_pngs,
    "cooccurrence_components": cooccurrence_components,
    "component_sizes": component_sizes,
    "phase_a_packing": phase_a_packing,
    "phase_a_invariants": phase_a_invariants,
    "median_cut": median_cut,
    "nearest_colours": nearest_colours,
    **{f"error_diffusion_{k}": _dithered(k) for k in K.DIFFUSION},
    "ordered_dither_blue": _dithered("blue"),
    **{f"palette_dither_bayer{n}": _dithered(f"bayer{n}") for n in (2, 4, 8)},
    "fidelity_pack": _packed("fidelity", 16),
    "balanced_pack": _packed("balanced", 16),
    "auto_pack": _packed("auto", 64),
    "quantized_pack": quantized_pack,
    "conversion_stats": stats,
}

_GRID = f"with recursive px as ({vector_grid_sql(64)})"
#: SQL of colours that share cells, as comps(image_id, cid, comp), over the grid of 64 levels.
COMPONENTS = (
    _GRID
    + ", "
    + ", ".join(f"{n} as ({sql.sized(sql.STEPS[n]).replace('{px}', 'px')})" for n in ("colours", "idpx", "cells"))
    + """, e as (select distinct a.image_id, a.cid as u, b.cid as v from cells a join cells b on a.image_id = b.image_id and a.y = b.y and a.cx = b.cx),
    reach as (select image_id, u, u as v from e union select r.image_id, r.u, e.v from reach r join e on r.image_id = e.image_id and r.v = e.u),
    comps as (select image_id, u as cid, min(v) as comp from reach group by image_id, u) """
)
_DITHER = _GRID.replace("recursive ", "") + " select image_id, count(*) as pixels, cast(0 as bigint) as off_palette, true as mean_kept from px group by image_id"
_INVARIANT = "with px as ({}) select image_id, count(*) as compared_pixels, 0 as without_slot, count(distinct y * 16 + cast(floor(x / 8) as int)) as cells, 0 as split_cells, 0 as over_cap, 0 as not_nearest from px where not transparent group by image_id"
ORACLE = {
    "nearest_colours": f"""with n as (select r, g, b, count(*) as n from ({vector_grid_sql(256)}) px group by r, g, b), top as (select r, g, b from n order by n desc, r, g, b limit 1024)
        select r, g, b, near % 16777216 as near, cast(near // 16777216 as int) as d2 from (select n.r, n.g, n.b,
          min(cast((n.r - t.r) * (n.r - t.r) + (n.g - t.g) * (n.g - t.g) + (n.b - t.b) * (n.b - t.b) as bigint) * 16777216 + t.r * 65536 + t.g * 256 + t.b) as near from n, top t group by n.r, n.g, n.b) q""",
    "cooccurrence_components": COMPONENTS + "select image_id, cid, comp from comps",
    "component_sizes": COMPONENTS + "select image_id, comp, count(*) as n_colours from comps group by image_id, comp",
    "phase_a_invariants": COMPONENTS + "select image_id, count(*) as colours, true as within_cap from comps group by image_id",
    "median_cut": _GRID.replace("recursive ", "") + " select image_id, count(distinct r * 4096 + g * 64 + b) as mapped_colours, least(32, count(distinct r * 4096 + g * 64 + b)) as entries, 0 as wrong_means from px group by image_id",
    **{f"error_diffusion_{k}": _DITHER for k in K.DIFFUSION},
    "ordered_dither_blue": _DITHER,
    **{f"palette_dither_bayer{n}": _DITHER for n in (2, 4, 8)},
    **{f"{k}_pack": _INVARIANT.format(vector_grid_sql(16)) for k in ("fidelity", "balanced")},
    "auto_pack": _INVARIANT.format(vector_grid_sql(64)),
    "quantized_pack": f"""select q.*, source_colours, true as within_budget, source_colours > {NP * CAP} as prequantized from ({_INVARIANT.format(vector_grid_sql(64, 200))}) q
    join (select image_id, count(distinct r * 4096 + g * 64 + b) as source_colours from ({vector_grid_sql(64, 200)}) s group by image_id) c on c.image_id = q.image_id""",
}
