"""What a conversion leaves of each image: device files, figures, report, screen text and preview.

Files and figures are aggregates over pixels and cells; Python only packs an image (``images.pack``),
and turns finished figures into texts and bytes into a picture, a row an image.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import screen as T
from ..functions import settings as S
from ..operators import resize as R
from ..operators.components import cut
from ..sources import sinks
from ..sources.grids import WIDTH, vector_grid, vector_grid_sql
from . import images, sql, texts

#: Bytes of a whole device file's parts: palettes, map, raw.
PARTS = (3072, 9600, 76800)
VERSION = "1"
#: Endings of an image's files, by their names in the record of figures.
ENDS = {"raw": ".raw", "map": ".map", "palettes_combined": ".pal", "preview": "_preview.png", "palettes_png": "_palettes.png", "report": "_report.txt", "nfo": ".nfo", "stats": "_stats.json"}


def _hex(c: str | Column) -> Column:
    return F.lpad(F.hex(c), 2, "0")


def _in_order(place: list[str], text: Column) -> Column:
    """The aggregate of ``text`` joined in the order of ``place``."""
    found = F.array_sort(F.collect_list(F.struct(*place, text.alias("text"))))
    return F.array_join(F.transform(found, lambda v: v["text"]), "")


def output_pixels(grid: DataFrame, packed: DataFrame, cell: int = 8, start: int = 1) -> DataFrame:
    """Every pixel of ``grid`` (bytes a channel) with its cell's palette, its slot and colour there, whether
    that changed it and by how much in OKLab. Transparent ones have slot 0 and its colour, which is
    black where slots of colours ``start`` at 1."""
    spark = grid.sparkSession
    ids, lab = sql.step(spark, grid, "idpx", 256, cell), sql.step(spark, grid, "oklab", 256)
    each = packed.select("image_id", "y", "cx", "palette", "entries", F.inline(F.arrays_zip(F.col("cids").alias("cid"), F.col("outs").alias("out_cid"))))
    each = each.select("image_id", "y", "cx", "cid", "out_cid", (F.array_position("entries", F.col("out_cid")) - 1 + start).cast("int").alias("slot"))
    where = packed.select("image_id", "y", "cx", "palette")
    # a colour's change is looked up once a pair of colours, not once a pixel
    pairs = each.select("image_id", "cid", "out_cid").distinct()
    ends = [lab.select("image_id", F.col("cid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("r", "g", "b", "ok_l", "ok_a", "ok_b")]) for k in ("cid", "out_cid")]
    pairs = pairs.join(ends[0], ["image_id", "cid"]).join(ends[1], ["image_id", "out_cid"])
    gap = F.sqrt(sum((F.col(f"ok_{c}_cid") - F.col(f"ok_{c}_out_cid")) ** 2 for c in "lab"))
    pairs = pairs.select("image_id", "cid", "out_cid", *[F.col(f"{c}_out_cid").alias(f"{c}2") for c in "rgb"], gap.alias("gap"))
    each = each.join(pairs, ["image_id", "cid", "out_cid"])
    px = ids.join(where, ["image_id", "y", "cx"], "left").join(each.withColumn("opaque", F.lit(True)), ["image_id", "y", "cx", "cid"], "left")
    px = px.withColumn("palette", F.coalesce("palette", F.lit(0)))
    zero = [F.lit(0)] * 3
    if not start:
        first = packed.filter(F.size("entries") > 0).select("image_id", "palette", F.get("entries", F.lit(0)).alias("cid")).distinct()
        first = first.join(sql.step(spark, grid, "colours").select("image_id", "cid", *[F.col(c).alias(f"{c}0") for c in "rgb"]), ["image_id", "cid"]).drop("cid")
        px, zero = px.join(first, ["image_id", "palette"], "left"), [F.coalesce(f"{c}0", F.lit(0)) for c in "rgb"]
    seen = lambda c, other: F.when(F.col("transparent"), other).otherwise(F.col(c)).cast("int").alias(c)
    changed = (~F.col("transparent") & (F.col("cid") != F.col("out_cid"))).alias("changed")
    return px.select("image_id", "y", "x", "cx", "transparent", "r", "g", "b", "cid", "palette", seen("slot", F.lit(0)), "out_cid", *[seen(f"{c}2", z) for c, z in zip("rgb", zero, strict=True)], changed, F.when(~F.col("transparent"), F.col("gap")).alias("gap"))


def device_parts(px: DataFrame, packed: DataFrame, colours: DataFrame, bins: int, slots: int, start: int) -> DataFrame:
    """(image_id, raw, map, pal): a slot a pixel, 16 times the palette a cell, and three bytes a slot."""
    by_line = px.groupBy("image_id", "y").agg(_in_order(["x"], _hex("slot")).alias("raw"))
    raw = by_line.groupBy("image_id").agg(F.unhex(_in_order(["y"], F.col("raw"))).alias("raw"))
    cells = px.groupBy("image_id", "y", "cx").agg(F.max("palette").alias("palette"))
    map_ = cells.groupBy("image_id").agg(F.unhex(_in_order(["y", "cx"], _hex((F.col("palette") * 16) % 256))).alias("map"))
    own = packed.select("image_id", "palette", "entries").dropDuplicates(["image_id", "palette"]).select("image_id", "palette", F.posexplode("entries").alias("at", "cid"))
    own = own.join(colours, ["image_id", "cid"]).groupBy("image_id", "palette").agg(_in_order(["at"], F.concat(*map(_hex, "rgb"))).alias("text"))
    one = lambda b: F.coalesce(F.max(F.when(F.col("palette") == b, F.rpad(F.concat(F.lit("000000" * start), "text"), 6 * slots, "0"))), F.lit("000000" * slots))
    pal = own.groupBy("image_id").agg(F.unhex(F.concat(*map(one, range(bins)))).alias("pal"))
    return raw.join(map_, "image_id").join(pal, "image_id", "left").withColumn("pal", F.coalesce("pal", F.unhex(F.lit("000000" * slots * bins))))


def seams(px: DataFrame, cell: int) -> DataFrame:
    """(image_id, seam_index): how much more columns jump at cell borders than elsewhere, in the output
    against the same of the source; means of columns' means over pairs of opaque pixels."""
    line = Window.partitionBy("image_id", "y").orderBy("x")
    both = ~F.col("transparent") & ~F.lag("transparent").over(line) & (F.col("x") - F.lag("x").over(line) == 1)
    jump = lambda cs: sum(F.abs(F.col(c) - F.lag(c).over(line)) for c in cs) / 3.0
    j = px.select("image_id", "x", both.alias("both"), jump(["r", "g", "b"]).alias("ref"), jump(["r2", "g2", "b2"]).alias("got")).filter("both")
    c = j.groupBy("image_id", "x").agg(F.avg("ref").alias("ref"), F.avg("got").alias("got"))
    on = F.col("x") % cell == 0
    m = c.groupBy("image_id").agg(*[F.avg(F.when(w, F.col(v))).alias(f"{v}_{n}") for v in ("ref", "got") for n, w in (("on", on), ("off", ~on))])
    whole = (F.col("ref_on") != 0) & (F.col("ref_off") != 0) & (F.col("got_off") != 0)
    return m.select("image_id", F.when(whole, (F.col("got_on") / F.col("got_off")) / (F.col("ref_on") / F.col("ref_off"))).alias("seam_index"))


def quality(px: DataFrame, cell: int = 8) -> DataFrame:
    """Figures of the output against the source an image, over opaque pixels: pixels are added up by
    cells, and these by image."""
    opaque, se = ~F.col("transparent"), sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in "rgb")
    cells = px.groupBy("image_id", "y", "cx").agg(
        F.count("*").alias("n"), F.count_if(opaque).alias("live"), F.count_if("changed").alias("hurt"), F.sum(F.when(opaque, se)).alias("se"),
        F.sum("gap").alias("gap"), F.max("gap").alias("most"), F.sum(F.when(F.col("changed"), F.col("gap"))).alias("moved"), F.max("x").alias("x"),
    )
    q = cells.groupBy("image_id").agg(
        F.sum("n").alias("pixels"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sum("live").alias("compared"), F.sum("hurt").alias("recoloured"),
        F.sum("se").alias("se"), F.sum("gap").alias("gap"), F.max("most").alias("most"), F.sum("moved").alias("moved"),
        F.count("*").alias("cells"), F.count_if(F.col("live") > 0).alias("live_cells"), F.count_if(F.col("hurt") > 0).alias("hurt_cells"),
    )
    mse = F.col("se") / (3 * F.col("compared"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    acc = F.struct(
        F.col("compared").alias("compared_pixels"), (F.col("compared") - F.col("recoloured")).alias("identical_pixels"),
        F.when(F.col("compared") > 0, 100 * (F.col("compared") - F.col("recoloured")) / F.col("compared")).otherwise(0.0).alias("identical_pct"),
        F.when(F.col("compared") > 0, F.sqrt(mse)).otherwise(0.0).alias("rgb_rmse"), F.when(F.col("se") > 0, 10 * F.log10(F.lit(255.0**2) / mse)).alias("psnr_db"),
        part("gap", "compared").alias("mean_oklab_error"), F.coalesce("most", F.lit(0.0)).alias("max_oklab_error"), F.col("live_cells").alias("cells_compared"),
        F.col("hurt_cells").alias("cells_damaged"), (100 * part("hurt_cells", "live_cells")).alias("cells_damaged_pct"), F.col("seam_index"),
    )
    q = q.join(seams(px, cell), "image_id", "left")
    return q.select("image_id", "pixels", "width", "height", "cells", F.col("recoloured").alias("recoloured_pixels"), (100 * F.col("recoloured") / F.col("pixels")).alias("recoloured_pct"),
        part("moved", "recoloured").alias("mean_oklab_error"), (F.col("pixels") - F.col("compared")).alias("transparent_pixels"), acc.alias("ideal_vs_output"))


def palette_figures(packed: DataFrame, bins: int) -> DataFrame:
    """(image_id, per_palette, distinct and repeated entries) of all palettes."""
    e = packed.select("image_id", "palette", "entries").dropDuplicates(["image_id", "palette"]).select("image_id", "palette", F.explode("entries").alias("cid"))
    e = e.withColumn("sole", F.count("*").over(Window.partitionBy("image_id", "cid")) == 1)
    of = [F.struct(F.count_if(F.col("palette") == b).alias("colours"), F.count_if((F.col("palette") == b) & F.col("sole")).alias("unique_to_palette")) for b in range(bins)]
    q = e.groupBy("image_id").agg(F.array(*of).alias("per_palette"), F.count_distinct("cid").alias("distinct_in_all_palettes"), F.count("*").alias("n"))
    return q.withColumn("duplicated_across_palettes", F.col("n") - F.col("distinct_in_all_palettes")).drop("n")


def names(images_: DataFrame, given: str) -> Column:
    """Names of files: those of a column ``name``; else what settings say, or IMG, with the whole image_id
    behind it unless a given name is a sole image's."""
    if "name" in images_.columns:
        return F.col("name")
    n = F.col("image_id")
    code = F.concat(F.lit(given or "IMG"), F.when(n.between(0, 99999), F.lpad(n.cast("string"), 5, "0")).otherwise(F.hex(n.cast("long"))))
    return F.when(F.col("images") == 1, F.lit(given)).otherwise(code) if given else code


def convert(source: DataFrame, settings: dict | None = None, levels: int = 256) -> DataFrame:
    """Per image of source(image_id, y, x, r, g, b, transparent) its files and figures: image_id, name, raw,
    map, pal, v1k, nfo, preview, swatches, report, stats.

    Images of any size come to ``settings["resize"]``; without it they keep theirs (a mask of ``fit`` takes
    the place of ``transparent`` then). Values of ``levels`` a channel become 0 to 255, pixels that a grid
    lacks are transparent and black. A column ``name`` names an image's files. ``v1k`` is null unless its
    parts have the device's sizes; a report of too many lines is an error of its image.
    """
    s = S.DEFAULTS | {"resize": ""} | (settings or {})
    bins, cap, start, cell = s["palettes"], S.usable(s), int(bool(s["reserve0"])), s["cell"]
    target = min(s["colors"] or bins * cap, bins * cap)
    byte = [F.rint(F.col(c) * (255.0 / (levels - 1))).cast("int").alias(c) for c in "rgb"]
    px = source.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *byte, "transparent")
    named = ["name"] if "name" in source.columns else []
    facts = source.groupBy("image_id", *named).agg(F.count_distinct("r", "g", "b").alias("source_colours"), (F.max("x") + 1).cast("int").alias("source_width"), (F.max("y") + 1).cast("int").alias("source_height"))
    if s["resize"]:
        px = cut(R.resize(px, S.parse_size(s["resize"]), s["filter"], s["fit"], S.parse_aspect(s["display_aspect"])))
    else:
        spots = facts.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("source_height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("source_width") - 1)))
        px = spots.select("image_id", "y", "x").join(px, ["image_id", "y", "x"], "left")
        px = px.select("image_id", "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"], F.coalesce("transparent", F.lit(True)).alias("transparent"))
    before = px.groupBy("image_id").agg(F.count_distinct("r", "g", "b").alias("before"))
    grid = cut(images.prequantize(px, s["dither"], s["dither_strength"], bins * cap, target))
    packed = cut(images.pack(grid, "auto", S.effective_bias(s), s["coherence"], bins, cap, 256, s["optimize"], cell, s["seed"]))
    out = cut(output_pixels(grid, packed, cell, start))
    colours = sql.step(source.sparkSession, grid, "colours")
    totals = colours.groupBy("image_id").agg(F.count("*").alias("master_colours"), F.count_if(F.col("n_opaque") == 0).alias("unseen"))
    shown = out.select("image_id", "r2", "g2", "b2").distinct().groupBy("image_id").agg(F.count("*").alias("output_colours"))
    how = packed.groupBy("image_id").agg(F.max("strategy").alias("kind"), F.max("components").alias("components"), F.max("largest").alias("largest"))
    parts = device_parts(out, packed, colours.select("image_id", "cid", "r", "g", "b"), bins, s["slots"], start)
    facts = facts.withColumn("images", F.count("*").over(Window.partitionBy())) if s["name"] and not named else facts
    frames = [before, quality(out, cell), totals, shown, parts]
    d = reduce(lambda a, b: a.join(b, "image_id"), frames, facts.withColumn("name", names(facts, s["name"])).drop("images"))
    d = d.join(how, "image_id", "left").join(palette_figures(packed, bins), "image_id", "left")
    return _texts(d.withColumn("stats", _record(s, bins, cap)))


def _record(s: dict, bins: int, cap: int) -> Column:
    """The JSON record of an image's figures."""
    bias, name = S.effective_bias(s), F.col("name")
    whole = (F.octet_length("pal") == PARTS[0]) & (F.octet_length("map") == PARTS[1]) & (F.octet_length("raw") == PARTS[2])
    given = F.lit(s["input"]) if s["input"] else name
    said = F.lit(T.description(s["description"], s["input"])) if s["description"].strip() or s["input"] else name
    args = F.struct(*[F.lit(v).alias(k) if k not in ("input", "name") else (given if k == "input" else name).alias(k) for k, v in s.items() if k in S.DEFAULTS])
    kind = F.coalesce("kind", F.lit("lossless"))
    reduced = F.col("before") > bins * cap
    files = F.struct(*[F.concat(name, F.lit(v)).alias(k) for k, v in ENDS.items()], F.when(whole, F.concat(name, F.lit(".v1k"))).alias("v1k"), F.array(*[F.concat(name, F.lit(f"{b}.pal")) for b in range(bins)]).alias("palettes"))
    none = lambda k: F.lit(s[k] if s["resize"] else None).cast("string")
    fields = {
        "input": given, "name": name, "source_name": F.regexp_extract(given, "[^/]*$", 0), "description": said, "convertor_version": F.lit(VERSION), "args": args, "out_dir": F.lit(s["out"]),
        "width": F.col("width"), "height": F.col("height"), "pixels": F.col("pixels"), "source_width": F.col("source_width"), "source_height": F.col("source_height"), "source_colours": F.col("source_colours"),
        "cell_width": F.lit(s["cell"]), "cells_per_line": F.ceil(F.col("width") / s["cell"]), "cells": F.col("cells"), "palettes": F.lit(bins), "slots": F.lit(s["slots"]), "usable_per_palette": F.lit(cap),
        "reserve0": F.lit(bool(s["reserve0"])), "resized": F.lit(bool(s["resize"])), "resize": none("resize"), "filter": none("filter"), "fit": none("fit"), "prequantized": reduced,
        "master_colours": F.col("master_colours"), "output_colours": F.col("output_colours"), "components": F.coalesce("components", F.lit(0)) + F.col("unseen"), "largest_component": F.coalesce("largest", F.lit(1)),
        "transparent_pixels": F.col("transparent_pixels"), "lossless": kind == "lossless", "strategy": F.when(kind == "lossless", kind).otherwise(F.concat(kind, F.lit(f" (bias {bias:.2f})"))),
        "color_bias": F.lit(bias), "coherence": F.lit(float(s["coherence"])), "dither": F.lit(s["dither"]), "dither_strength": F.lit(float(s["dither_strength"])), "dither_applied": reduced & F.lit(s["dither"] != "none"),
        "recoloured_pixels": F.col("recoloured_pixels"), "recoloured_pct": F.col("recoloured_pct"), "mean_oklab_error": F.col("mean_oklab_error"), "ideal_vs_output": F.col("ideal_vs_output"),
        "duplicated_across_palettes": F.coalesce("duplicated_across_palettes", F.lit(0)), "distinct_in_all_palettes": F.coalesce("distinct_in_all_palettes", F.lit(0)),
        "per_palette": F.coalesce("per_palette", F.array(*[F.struct(F.lit(0).cast("long").alias("colours"), F.lit(0).cast("long").alias("unique_to_palette"))] * bins)), "files": files,
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _texts(d: DataFrame) -> DataFrame:
    """Beside files and figures, what is written of them for people: a row an image."""
    kind = dict(d.dtypes)["image_id"]
    whole = (F.octet_length("pal") == PARTS[0]) & (F.octet_length("map") == PARTS[1]) & (F.octet_length("raw") == PARTS[2])
    d = d.select("image_id", "name", "raw", "map", "pal", F.when(whole, F.concat("pal", "map", "raw")).alias("v1k"), "stats")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out: dict[str, list] = {"preview": [], "swatches": [], "report": [], "stats": []}
            for r in pdf.itertuples():
                stats = json.loads(r.stats)
                if stats["files"]["v1k"] is None:
                    del stats["files"]["v1k"]
                pal = np.frombuffer(r.pal, np.uint8).reshape(stats["palettes"], stats["slots"], 3)
                at = (np.frombuffer(r.map, np.uint8) // 16).reshape(stats["height"], -1).repeat(stats["cell_width"], 1)[:, : stats["width"]]
                text = T.report(stats)
                out["preview"].append(sinks.png(pal[at, np.frombuffer(r.raw, np.uint8).reshape(at.shape)]))
                out["swatches"].append(sinks.png(pal.repeat(sinks.SWATCH, 0).repeat(sinks.SWATCH, 1)))
                out["report"].append(text)
                out["stats"].append(json.dumps(stats))
            yield pdf[["image_id", "name", "raw", "map", "pal", "v1k"]].assign(**out)

    d = d.mapInPandas(run, f"image_id {kind}, name string, raw binary, map binary, pal binary, v1k binary, preview binary, swatches binary, report string, stats string")
    return d.withColumn("nfo", texts.screen(F.col("report")))


def join_parts(files: DataFrame) -> DataFrame:
    """Whole device files of files(folder, stem, kind, content), kind one of pal, map, raw: (folder, stem, v1k,
    problem); a part that is missing or of another size is the problem and there is no file."""
    f = files.withColumn("kind", F.lower("kind")).filter(F.col("kind").isin("pal", "map", "raw"))
    one = f.groupBy("folder", "stem").agg(*[F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("pal", "map", "raw")])
    problem = F.coalesce(*[F.when(F.col(k).isNull(), f"no {k}").when(F.octet_length(k) != n, F.concat(F.lit(f"{k} has "), F.octet_length(k).cast("string"), F.lit(f" bytes, not {n}"))) for k, n in zip(("pal", "map", "raw"), PARTS, strict=True)])
    return one.filter("map is not null").select("folder", "stem", F.when(problem.isNull(), F.concat("pal", "map", "raw")).alias("v1k"), problem.alias("problem"))


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Files of ``folder`` and the folders right below it, as ``join_parts`` takes them."""
    globs = [folder, f"{folder}/*"]
    f = None
    for g in globs:
        one = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pal,map,raw,PAL,MAP,RAW}").load(g) if g == folder or _any(spark, g) else None
        f = one if f is None else f if one is None else f.unionByName(one)
    p = F.col("path")
    return f.dropDuplicates(["path"]).select(F.regexp_extract(p, "^(.*)/", 1).alias("folder"), F.regexp_extract(p, r"([^/]*)\.[^.]*$", 1).alias("stem"), F.regexp_extract(p, r"\.([^.]*)$", 1).alias("kind"), "content")


def _any(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return any(x.isDirectory() for x in found or [])


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows of ``convert`` as all the files that their records list, below a folder that all executors
    reach, a folder an image and each file first under another name; returns how many images. Two
    images of one name are an error, and nothing is written."""
    if twice := rows.groupBy("name").count().filter("count > 1").head():
        raise ValueError(f"{twice['count']} images are called {twice.name}")

    def put(it):
        import os

        for pdf in it:
            for r in pdf.itertuples():
                os.makedirs(f"{folder}/{r.name}", exist_ok=True)
                files = json.loads(r.stats)["files"]
                size = len(r.pal) // len(files["palettes"])
                bodies = {"raw": r.raw, "map": r.map, "palettes_combined": r.pal, "v1k": r.v1k, "nfo": r.nfo, "preview": r.preview, "palettes_png": r.swatches, "report": (r.report + "\n").encode(), "stats": r.stats.encode()}
                each = [(files[k], v) for k, v in bodies.items() if k in files] + [(f, r.pal[size * b : size * (b + 1)]) for b, f in enumerate(files["palettes"])]
                for file, body in each:
                    path = f"{folder}/{r.name}/{file}"
                    with open(f"{path}.tmp", "wb") as f:
                        f.write(body)
                    os.replace(f"{path}.tmp", path)
            yield pdf[["name"]]

    return rows.mapInPandas(put, "name string").count()


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(vector_grid(spark, sf_dir, 64), {"color_bias": 0.5}, levels=64)


def device_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel's colour as its image's files say: the palette that its cell's map byte names, at the
    slot that its raw byte names."""
    d = _query(spark, sf_dir).select("image_id", "raw", "map", "pal")
    byte = lambda c, at: F.conv(F.hex(F.substring(c, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    px = d.withColumn("at", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - 1)))
    px = px.withColumn("y", F.floor(F.col("at") / WIDTH).cast("int")).withColumn("x", F.col("at") % WIDTH)
    px = px.withColumn("entry", F.floor(byte("map", F.col("y") * 3 + F.floor(F.col("x") / 8)) / 16) * 256 + byte("raw", F.col("at")))
    return px.select("image_id", "y", "x", *[byte("pal", 3 * F.col("entry") + k).alias(c) for k, c in enumerate("rgb")])


def conversion_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the JSON record that SQL can tell too."""
    get = lambda k, t: F.get_json_object("stats", f"$.{k}").cast(t).alias(k.rpartition(".")[2])
    whole = ["width", "height", "pixels", "cells", "source_colours", "master_colours", "transparent_pixels", "components", "largest_component", "recoloured_pixels", "distinct_in_all_palettes", "duplicated_across_palettes"]
    acc = ["compared_pixels", "identical_pixels", "cells_compared", "cells_damaged"]
    return _query(spark, sf_dir).select("image_id", *[get(k, "long") for k in whole], *[get(f"ideal_vs_output.{k}", "long") for k in acc], get("lossless", "boolean"), F.round(F.get_json_object("stats", "$.ideal_vs_output.seam_index").cast("double"), 6).alias("seam_index"))


def conversion_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir).select("image_id", "report", F.octet_length("nfo").alias("nfo_bytes"))


QUERIES = {"device_files": device_files, "conversion_figures": conversion_figures, "conversion_reports": conversion_reports}
ORACLE = {
    # 64 levels as bytes; the grid's images pack without loss
    "device_files": f"with px as ({vector_grid_sql(64)}) select image_id, y, x, "
    + ", ".join(f"case when transparent then 0 else cast(round_even({c} * 255e0 / 63, 0) as int) end as {c}" for c in "rgb")
    + " from px",
    "conversion_figures": images.COMPONENTS
    + """, p as (select image_id, count(*) as pixels, max(y) + 1 as height, count(distinct r * 4096 + g * 64 + b) as source_colours, count(distinct case when not transparent then r * 4096 + g * 64 + b end) as opaque_colours,
          count(*) filter (where transparent) as transparent_pixels, count(distinct case when not transparent then y * 16 + x // 8 end) as cells_compared from px group by image_id),
        g as (select image_id, count(*) as components, max(n) as largest from (select image_id, comp, count(*) as n from comps group by image_id, comp) t group by image_id)
        select p.image_id, cast(21 as bigint) as width, cast(height as bigint) as height, pixels, cast(3 * height as bigint) as cells, source_colours, source_colours as master_colours, transparent_pixels,
          components + source_colours - opaque_colours as components, largest as largest_component, cast(0 as bigint) as recoloured_pixels, opaque_colours as distinct_in_all_palettes, cast(0 as bigint) as duplicated_across_palettes,
          pixels - transparent_pixels as compared_pixels, pixels - transparent_pixels as identical_pixels, cells_compared, cast(0 as bigint) as cells_damaged, true as lossless, cast(1 as double) as seam_index
        from p join g on p.image_id = g.image_id""",
}
