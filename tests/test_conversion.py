"""Conversions, resampling and records as DataFrames, by hand-made inputs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kernels as K
from gridloom.operators import resize as R
from gridloom.plans import conversion, records
from gridloom.sources import grids, sinks

PX = "image_id long, y int, x int, r int, g int, b int, transparent boolean"


def pixels(spark, rgb, clear=None, image=0):
    h, w, _ = rgb.shape
    clear = np.zeros((h, w), bool) if clear is None else clear
    return spark.createDataFrame([(image, y, x, *map(int, rgb[y, x]), bool(clear[y, x])) for y in range(h) for x in range(w)], PX)


def figures(spark, ideal, got, ramp, clear):
    """``quality`` of an output of colour ids against the ideal one."""
    lab = K.oklab(ramp / 255.0)
    gap = np.sqrt(((lab[ideal] - lab[got]) ** 2).sum(2))
    rows = [(0, y, x, x // 8, bool(clear[y, x]), *map(int, ramp[ideal[y, x]]), *map(int, ramp[got[y, x]]), bool(ideal[y, x] != got[y, x] and not clear[y, x]), None if clear[y, x] else float(gap[y, x])) for y, x in np.ndindex(*ideal.shape)]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, cx int, transparent boolean, r int, g int, b int, r2 int, g2 int, b2 int, changed boolean, gap double")
    return conversion.quality(px).head().ideal_vs_output


def test_figures_by_hand(spark):
    ramp = np.stack([np.arange(0, 256, 4)] * 3, 1)
    ideal = np.tile(np.arange(24), (5, 1))
    clear = np.zeros((5, 24), bool)
    same = figures(spark, ideal, ideal, ramp, clear)
    assert same["identical_pct"] == 100 and same["psnr_db"] is None and same["cells_damaged"] == 0 and same["seam_index"] == 1
    one = ideal.copy()
    one[3, 10] = 40
    got = figures(spark, ideal, one, ramp, clear)
    assert (got["compared_pixels"] - got["identical_pixels"], got["cells_damaged"], got["cells_compared"]) == (1, 1, 15)
    mse = 3 * (4.0 * 30) ** 2 / (3 * 120)
    gap = float(np.sqrt(((K.oklab(ramp[[10]] / 255.0) - K.oklab(ramp[[40]] / 255.0)) ** 2).sum()))
    assert got["rgb_rmse"] == pytest.approx(mse**0.5) and got["psnr_db"] == pytest.approx(10 * np.log10(255**2 / mse))
    assert got["mean_oklab_error"] == pytest.approx(gap / 120) and got["max_oklab_error"] == pytest.approx(gap)
    clear[:, :8] = True
    wrecked = ideal.copy()
    wrecked[:, :8] = 63
    got = figures(spark, ideal, wrecked, ramp, clear)
    assert got["psnr_db"] is None and got["cells_compared"] == 10
    on, off = ideal.copy(), ideal.copy()
    on[:, 8:16] += 20
    off[:, 12:20] += 20
    a, b = (figures(spark, ideal, v, ramp, np.zeros_like(clear)) for v in (on, off))
    assert a["rgb_rmse"] == b["rgb_rmse"] and a["seam_index"] > 2 and b["seam_index"] < 1
    flat = np.zeros((5, 24), int)
    assert figures(spark, flat, flat, ramp, np.zeros_like(clear))["seam_index"] is None
    assert figures(spark, flat, flat, ramp, np.ones_like(clear))["compared_pixels"] == 0


def decoded(d, s):
    """Pixels that an image's files stand for."""
    pal = np.frombuffer(d.pal, np.uint8).reshape(s["palettes"], s["slots"], 3)
    at = np.frombuffer(d.map, np.uint8).reshape(s["height"], s["cells_per_line"]) // 16
    return pal[at.repeat(s["cell_width"], 1)[:, : s["width"]], np.frombuffer(d.raw, np.uint8).reshape(s["height"], s["width"])]


@pytest.mark.parametrize("cell", [4, 8, 16])
@pytest.mark.parametrize("reserve0", [True, False])
def test_cells_of_any_width(spark, cell, reserve0):
    rng = np.random.default_rng(cell)
    some = rng.integers(0, 256, (500, 3))
    rgb = some[rng.integers(0, 500, (16, 36))]  # the last cell of a line is a part
    clear = np.zeros((16, 36), bool)
    clear[0, :20] = True
    d = conversion.convert(pixels(spark, rgb, clear, 2**40 + 7), {"cell": cell, "coherence": 0.0, "reserve0": reserve0}).head()
    s = json.loads(d.stats)
    got = decoded(d, s)
    assert (s["cells_per_line"], s["cell_width"], d.image_id) == (-(-36 // cell), cell, 2**40 + 7)
    assert s["recoloured_pixels"] == int((got[~clear] != rgb[~clear]).any(1).sum()) and (sinks.read_png(d.preview) == got).all()
    assert s["recoloured_pixels"] == 0 or not s["lossless"]
    if reserve0:
        assert not got[clear].any()


def test_decoded_images_of_mixed_sizes_become_files(spark, tmp_path):
    """From PNG files to device files at one size, names and lists included."""
    rng = np.random.default_rng(3)
    source = {"one": rng.integers(0, 256, (30, 50, 3)), "two": rng.integers(0, 256, (60, 20, 3)), "same": rng.integers(0, 2, (24, 32, 3)) * 255}
    for k, rgb in source.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.png").write_bytes(sinks.png(rgb.astype(np.uint8)))
    px = grids.read_images(spark, str(tmp_path / "in")).withColumn("name", F.upper(F.regexp_extract("origin", "([^/]*)[.]png$", 1)))
    assert px.groupBy("name").count().orderBy("name").collect() == [("ONE", 1500), ("SAME", 768), ("TWO", 1200)]
    rows = conversion.convert(px, {"resize": "32x24", "fit": "fit", "filter": "box", "color_bias": 0.3})
    assert conversion.write_files(rows, str(tmp_path / "out")) == 3
    for r in rows.collect():
        s = json.loads(r.stats)
        rgb = source[r.name.lower()]
        assert (s["resized"], s["resize"], s["filter"], s["fit"], s["width"], s["height"]) == (True, "32x24", "box", "fit", 32, 24)
        assert (s["source_height"], s["source_width"]) == rgb.shape[:2] and s["source_colours"] == len(np.unique(rgb.reshape(-1, 3), axis=0))
        inner = {"ONE": 32 * 19, "TWO": 8 * 24, "SAME": 32 * 24}[r.name]
        assert s["transparent_pixels"] == 32 * 24 - inner and "Resampled            : 32x24 via box" in r.report
        if r.name == "SAME":
            assert (decoded(r, s) == rgb).all()
        there = {p.name for p in (tmp_path / "out" / r.name).iterdir()}
        listed = {v for v in s["files"].values() if isinstance(v, str)} | set(s["files"]["palettes"])
        assert there == listed == {r.name + e for e in (".raw", ".map", ".pal", "_preview.png", "_palettes.png", "_report.txt", ".nfo", "_stats.json", "0.pal", "1.pal", "2.pal", "3.pal")}
        each = b"".join((tmp_path / "out" / r.name / f).read_bytes() for f in s["files"]["palettes"])
        assert each == r.pal and sinks.read_png((tmp_path / "out" / r.name / f"{r.name}_palettes.png").read_bytes()).shape == (48, 3072, 3)


def test_names_seeds_and_biases(spark):
    rng = np.random.default_rng(9)
    rgb = rng.integers(0, 256, (600, 3))[rng.integers(0, 600, (24, 64))]
    one = pixels(spark, rgb)
    d = {k: conversion.convert(one, {"seed": k, "name": "GRAIN", "color_bias": 0.6, "description": "  a shore "}).head() for k in (0, 1)}
    assert d[0].name == "GRAIN" and bytes(d[0].raw) != bytes(d[1].raw)  # another seed, other clusters
    s = json.loads(d[0].stats)
    assert s["args"]["seed"] == 0 and s["args"]["name"] == "GRAIN" and s["description"] == "a shore" and not s["resized"] and s["resize"] is None
    two = one.unionByName(pixels(spark, rgb, image=100_000)).filter("y < 4")
    assert {r.name for r in conversion.convert(two).collect()} == {"IMG00000", "IMG186A0"}
    assert {r.name for r in conversion.convert(two, {"name": "GRAIN"}).collect()} == {"GRAIN00000", "GRAIN186A0"}
    with pytest.raises(ValueError, match="2 images are called A"):
        conversion.write_files(conversion.convert(two.withColumn("name", F.lit("A"))), "/nowhere")


@pytest.mark.parametrize("colours, bias", [(600, 0.0), (3000, 0.0), (900, 0.5)])
def test_whole_files_read_back(spark, tmp_path, colours, bias):
    rng = np.random.default_rng(colours)
    some = rng.integers(0, 256, (colours, 3))
    rgb = some[rng.integers(0, colours, (240, 320))]
    clear = np.zeros((240, 320), bool)
    clear[:20] = True
    rows = conversion.convert(pixels(spark, rgb, clear), {"color_bias": bias, "coherence": 0.0}, 256)
    d = rows.head()
    s = json.loads(d.stats)
    assert len(d.v1k) == 89472 and d.v1k == d.pal + d.map + d.raw and s["files"]["v1k"] == f"{d.name}.v1k"
    acc = s["ideal_vs_output"]
    assert acc["identical_pixels"] + s["recoloured_pixels"] == acc["compared_pixels"] == 220 * 320 and s["prequantized"] == (colours > 1020)
    assert d.report.count("\n") < 127 and all(len(x) <= 80 for x in d.report.split("\n")) and len(d.nfo) == 160 * (d.report.count("\n") + 2)
    pal, at, raw = (np.frombuffer(x, np.uint8) for x in (d.pal, d.map, d.raw))
    shown = pal.reshape(4, 256, 3)[(at // 16).reshape(240, 40).repeat(8, 1), raw.reshape(240, 320)]
    assert (shown == sinks.read_png(d.preview)).all() and not shown[:20].any() and (raw.reshape(240, 320)[20:] > 0).all()
    if colours == 600:
        moved = (shown[20:] != rgb[20:]).any(2).mean()
        assert moved == s["recoloured_pixels"] / (220 * 320)
    conversion.write_files(rows, str(tmp_path / "out"))
    back = grids.read_packed(spark, str(tmp_path / "out")).collect()
    assert [r.valid for r in back] == [True] and back[0].raw == d.raw
    joined = conversion.join_parts(conversion.read_parts(spark, str(tmp_path / "out"))).head()
    assert joined.v1k == d.v1k and joined.problem is None


def test_blocky_images_pack_without_loss(spark):
    rng = np.random.default_rng(1)
    rgb = np.zeros((32, 64, 3), int)
    for k in range(4):  # four regions of 250 colours
        own = np.unique(rng.integers(0, 256, (2000, 3)), axis=0)[:250] if k else rng.integers(0, 60, (250, 3))
        rgb[:, 16 * k : 16 * k + 16] = own[np.resize(np.arange(250), 512)].reshape(32, 16, 3)
    s = json.loads(conversion.convert(pixels(spark, rgb)).head().stats)
    assert s["master_colours"] <= 1000 and s["lossless"] == (s["recoloured_pixels"] == 0)


def test_missing_parts_are_named(spark):
    f = [("a", "x", "map", bytes(9600)), ("a", "x", "pal", bytes(3072)), ("a", "y", "MAP", bytes(9600)), ("a", "y", "pal", bytes(3072)), ("a", "y", "raw", bytes(5)), ("a", "z", "raw", bytes(76800))]
    got = {r.stem: (r.v1k, r.problem) for r in conversion.join_parts(spark.createDataFrame(f, "folder string, stem string, kind string, content binary")).collect()}
    assert got == {"x": (None, "no raw"), "y": (None, "raw has 5 bytes, not 76800")}


SINC = lambda x: math.sin(math.pi * x) / (math.pi * x) if x else 1.0
#: Half width and shape of each filter, from their definitions.
SHAPES = {
    "box": (0.5, lambda x: 1.0 if -0.5 < x <= 0.5 else 0.0),
    "bilinear": (1, lambda x: 1 - abs(x) if abs(x) < 1 else 0.0),
    "hamming": (1, lambda x: SINC(x) * (0.54 + 0.46 * math.cos(math.pi * x)) if abs(x) < 1 else 0.0),
    "bicubic": (2, lambda x: 1.5 * abs(x) ** 3 - 2.5 * x * x + 1 if abs(x) < 1 else -0.5 * abs(x) ** 3 + 2.5 * x * x - 4 * abs(x) + 2 if abs(x) < 2 else 0.0),
    "lanczos": (3, lambda x: SINC(x) * SINC(x / 3) if abs(x) < 3 else 0.0),
}


def line(v, n, name):
    """A list of numbers at length n."""
    scale, out = len(v) / n, []
    for o in range(n):
        middle = (o + 0.5) * scale
        if name == "nearest":
            out.append(v[min(len(v) - 1, math.floor(middle))])
            continue
        half, shape = SHAPES[name]
        wide = max(scale, 1)
        w = {i: shape((i - middle + 0.5) / wide) for i in range(max(0, math.floor(middle - half * wide + 0.5)), min(len(v), math.floor(middle + half * wide + 0.5)))}
        whole = {i: math.copysign(math.floor(abs(x / sum(w.values())) * 2**22 + 0.5), x) for i, x in w.items()}
        out.append(min(255, max(0, (int(sum(v[i] * x for i, x in whole.items())) + 2**21) // 2**22)))
    return out


def placed(w, h, tw, th, fit, aspect=4 / 3):
    """Part of the source (x, y, width, height), the size it gets, and where it stands."""
    if fit == "cover":
        n, m = (round(h * aspect), h) if w / h > aspect else (w, round(w / aspect))
        return ((w - n) // 2, (h - m) // 2, n, m), (tw, th), (0, 0)
    if fit == "fit":
        pixel = aspect * th / tw
        gw, gh = tw, round(tw * pixel / (w / h))
        if gh > th:
            gw, gh = round(th * (w / h) / pixel), th
        gw, gh = max(1, min(tw, gw)), max(1, min(th, gh))
        return (0, 0, w, h), (gw, gh), ((tw - gw) // 2, (th - gh) // 2)
    return (0, 0, w, h), (tw, th), (0, 0)


@pytest.mark.parametrize("name", ["nearest", *R.FILTERS])
@pytest.mark.parametrize("to, fit", [((5, 4), "stretch"), ((16, 20), "stretch"), ((12, 9), "cover"), ((12, 9), "fit")])
def test_resize_by_definition(spark, name, to, fit):
    """Images of four sizes in one table."""
    rng = np.random.default_rng(0)
    source = [rng.integers(0, 256, (h, w, 3)) for w, h in ((9, 11), (30, 7), (to[0], to[1]), (1, 1))]
    px = None
    for k, rgb in enumerate(source):
        one = pixels(spark, rgb, image=k)
        px = one if px is None else px.unionByName(one)
    got = {(r.image_id, r.y, r.x): (r.r, r.g, r.b, r.transparent) for r in R.resize(px, to, name, fit).collect()}
    assert len(got) == len(source) * to[0] * to[1]
    for k, rgb in enumerate(source):
        (x0, y0, w, h), inner, (ox, oy) = placed(rgb.shape[1], rgb.shape[0], *to, fit)
        v = [[[line([int(p[c]) for p in row], inner[0], name) for c in range(3)] for row in rgb[y0 : y0 + h, x0 : x0 + w]]][0]
        for x in range(inner[0]):
            down = [line([row[c][x] for row in v], inner[1], name) for c in range(3)]
            for y in range(inner[1]):
                assert got.pop((k, y + oy, x + ox)) == (*(down[c][y] for c in range(3)), False)
    assert set(got.values()) <= {(0, 0, 0, True)}


def test_geometry(spark):
    for size, to, fit, want in (
        ((1000, 500), (320, 240), "fit", ((0, 0, 1000, 500), (320, 160), (0, 40))),
        ((1000, 500), (320, 240), "cover", ((166, 0, 667, 500), (320, 240), (0, 0))),
        ((100, 400), (160, 240), "fit", ((0, 0, 100, 400), (30, 240), (65, 0))),
    ):
        g = R.geometry(spark.createDataFrame([size], "width int, height int"), to, fit).head()
        assert ((g.x0, g.y0, g.w, g.h), (g.iw, g.ih), (g.ox, g.oy)) == want == placed(*size, *to, fit)
    assert R.taps(spark.createDataFrame([(100, 7)], "size int, to int"), "lanczos").filter("o = 3").agg(F.sum("w")).head()[0] == pytest.approx(1 << 22, abs=50)


def test_lists(spark):
    rows = [("B", "two \u20ac"), ("A", "x" * 90), ("LONGNAME9", None), ("C\x9b", "one\x9bLONGKEY1two")]
    raw = records.list_bytes(spark.createDataFrame(rows, "key string, description string")).head().content
    assert bytes(raw) == b"A       " + b"x" * 75 + b"\x9b" + b"B       two ?\x9b" + b"C?      one?LONGKEY1two\x9b" + b"LONGNAME\x9b"
    more = spark.createDataFrame([(bytearray(bytes(raw) + b"B       new\x01junk\x9bshort\x9b"),)], "content binary")
    assert {r.key: r.description for r in records.read_list(more).collect()} == {"A       ": "x" * 75, "B       ": "new", "C?      ": "one?LONGKEY1two", "LONGNAME": ""}


def test_failures_and_figures(spark):
    runs = [(1, 2, "x\nDither needs scipy: install it"), (2, 1, "Traceback\nValueError: bad"), (3, 9, None), (4, 1, "No such file or directory: q"), (5, 1, "MemoryError"), (6, 1, " ")]
    got = {r.job: (r.c.kind, r.c.message) for r in spark.createDataFrame(runs, "job int, code int, err string").select("job", records.classify(F.col("code"), F.col("err")).alias("c")).collect()}
    assert [got[k][0] for k in range(1, 7)] == ["scipy", "error", "error", "input", "memory", "error"]
    assert got[2][1].endswith("ValueError: bad") and got[3][1].endswith(" 9")
    out = [(1, 'warn\n{"output_colours": 3}\n{"output_colours": 4}\n{"x": 1}'), (2, "none"), (3, None)]
    assert {r.job: r.stats for r in records.last_stats(spark.createDataFrame(out, "job int, stdout string")).collect()} == {1: '{"output_colours": 4}', 2: None, 3: None}
    t = spark.createDataFrame([(1.05, 0.5, 0.01, 3.0), (1.1, 1.5, 0.02, 25.0), (1.3, 5.5, 0.5, 26.0), (None, None, None, None)], "seam_index double, recoloured_pct double, mean_oklab_error double, cells_damaged_pct double")
    assert [tuple(r) for r in t.select(*[records.tone(c) for c in t.columns]).collect()] == [(None,) * 4, ("warn", "warn", "warn", None), ("error", "error", "warn", "warn"), (None,) * 4]


def test_snapshots_and_sources(spark):
    f = [("d", n) for n in ("Preview_2.png", "preview_10.PNG", "Preview_02.txt", "Preview_11.txt", "other.png")] + [("e", "x.png")]
    files = spark.createDataFrame(f, "folder string, name string")
    assert {r.folder: (r.next_number, r.shots) for r in records.next_numbers(files).collect()} == {"d": (12, 3), "e": (1, 0)}
    assert [(r.number, r.png, r.txt) for r in records.snapshots(files).collect()] == [(2, "Preview_2.png", "Preview_02.txt"), (10, "preview_10.PNG", None)]
    wanted = [(1, "/a/x.png", "/o", "/f"), (2, "sub/y.png", "/o", "/f"), (3, "/gone/z.png", "/o", "/f"), (4, "/gone/W.PNG", "/o", "/f"), (5, "none", "/o", "/f")]
    there = [(p,) for p in ("/a/x.png", "/o/sub/y.png", "/f/z.png", "/q/w.png", "/p/w.png")]
    got = records.find_sources(spark.createDataFrame(wanted, "job int, input string, out_folder string, folder string"), spark.createDataFrame(there, "path string"))
    assert {r.job: (r.path, r.how) for r in got.collect()} == {1: ("/a/x.png", "recorded"), 2: ("/o/sub/y.png", "resolved"), 3: ("/f/z.png", "folder"), 4: ("/p/w.png", "index"), 5: (None, "none")}


def test_recovery(spark):
    from gridloom.functions import screen as T
    from gridloom.functions import settings as S

    s = S.DEFAULTS | {"dither": "jjn"}
    text, old = T.with_data("x", s, {}), json.dumps({"input": "i.png"})
    rows = [("a", text, old, None, None, None), ("b", None, json.dumps({"args": s}), None, None, None), ("c", None, old, None, text, None), ("d", None, old, None, None, '{"dither": "blue"}'), ("e", None, old, None, None, None), ("f", None, "{", None, None, None), ("g", None, old, "Dithering            : Floyd, strength 0.50", None, None)]
    got = {r.folder: r for r in records.recover(spark.createDataFrame(rows, "folder string, summary string, stats string, report string, match string, trial string")).collect()}
    assert {k: r.confidence for k, r in got.items()} == {"a": "exact", "b": "exact", "c": "preview match", "d": "verified", "e": "best guess", "f": "none", "g": "best guess"}
    assert [json.loads(got[k].settings)["dither"] for k in "abcdeg"] == ["jjn", "jjn", "jjn", "blue", "none", "floyd"] and got["e"].note and not got["g"].note
    old = spark.createDataFrame([("a", bytearray(b"1"))], "folder string, content binary")
    tried = spark.createDataFrame([("a", 2, "late", bytearray(b"1")), ("a", 1, "early", bytearray(b"1")), ("a", 0, "other", bytearray(b"2"))], "folder string, rank int, settings string, content binary")
    assert [tuple(r) for r in records.first_match(old, tried).collect()] == [("a", "early")]


def test_gather(spark):
    f = [("/x/charger1.v1k", b"ab"), ("/x/Charger_12.v1k", b"cd"), ("/x/sub/charger_13.v1k", b"ef"), ("/x/zcopy.v1k", b"ab"), ("/x/bad.v1k", b"abc")]
    got = {r.path: (r.name, r.problem) for r in records.gather_plan(spark.createDataFrame([(p, bytearray(c)) for p, c in f], "path string, content binary"), 2).collect()}
    assert got == {"/x/charger1.v1k": ("CHARGER1", None), "/x/Charger_12.v1k": ("CHARGER_", None), "/x/sub/charger_13.v1k": ("CHARGE01", None), "/x/zcopy.v1k": (None, "duplicate"), "/x/bad.v1k": (None, "size 3")}
