"""New descriptions of conversions, and ramps of shades."""

import json

import numpy as np

from gridloom.functions import names
from gridloom.functions import screen as T
from gridloom.plans import records, sql

SF = "/root/testdata/sf0.001"


def test_describe(spark):
    long = "a long description of some seventy characters that goes over two lines"
    report = "\n".join(["title", T.row("Input", "f.png", True), T.row("Description", "old words", True), T.more("and more"), T.row("Dimensions", "1 x 1")]) + "\n"
    bare = "\n".join(["title", T.row("Input", "f.png", True), T.row("Dimensions", "1 x 1")])
    stats = json.dumps({"source_name": "f.png", "description": "old words and more", "args": {"description": None}})
    summary = T.with_data("head\n" + report, {"input": "f.png", "description": "old words and more"}, {"k": 1})
    rows = [("a", stats, report, summary), ("b", stats, bare, None), ("c", stats, None, "not readable"), ("d", None, report, None), ("e", stats, report, None), ("f", stats, report, summary)]
    ask = [("a", long), ("b", "  "), ("c", "new"), ("d", "new"), ("e", "x" * 76), ("f", "caf\u00e9"), ("nowhere", "x")]
    f = spark.createDataFrame(rows, "folder string, stats string, report string, summary string")
    got = {r.folder: r for r in records.describe(f, spark.createDataFrame(ask, "folder string, text string")).collect()}
    assert sorted(got) == list("abcdef")
    a = got["a"]
    assert a.changed == ["stats", "report", "screen", "summary"] and a.old == "old words and more" and a.new == long
    assert "and more" not in a.report and a.report.count("Description") == 1 and a.report.endswith(T.row("Dimensions", "1 x 1") + "\n")
    assert names.nfo_decode(bytes(a.screen)) == a.report.rstrip("\n").split("\n") and json.loads(a.stats)["args"]["description"] == long
    assert T.settings_of(a.summary)[0]["description"] == long and a.report.rstrip() in a.summary and a.summary.count("[data]") == 1
    again = records.describe(spark.createDataFrame([("a", a.stats, a.report, a.summary)], f.schema), spark.createDataFrame([("a", long)], "folder string, text string")).first()
    assert again.changed == [] and (again.stats, again.report, again.summary) == (a.stats, a.report, a.summary)
    b = got["b"]
    assert b.new == "f" and b.changed == ["stats", "report", "screen"] and b.report.split("\n")[2] == T.row("Description", "f", True)
    assert got["c"].changed == ["stats"] and got["c"].summary == "not readable"
    for k in "def":
        assert got[k].changed == [] and got[k].problem and got[k].report == report


def test_ramp(spark):
    colours = sql.step(spark, sql.vector_grid(spark, SF, 64), "palette").filter("image_id = 2").toPandas()
    luma = {c: 299 * r + 587 * g + 114 * b for c, r, g, b in zip(colours.cid, colours.r, colours.g, colours.b, strict=True)}
    order = sorted(luma, key=lambda c: (-luma[c], c))
    wide = [round((i + 1) * 80 / len(order)) - round(i * 80 / len(order)) for i in range(len(order))]
    right = np.repeat(order, wide).tolist()
    line = right[::-1] + right
    got = {r.x: r.cid for r in sql.run(spark, SF, "separator_ramp").filter("image_id = 2").collect()}
    assert [got[x] for x in range(160)] == line
    pens = {r.place: r.pen for r in sql.run(spark, SF, "rule_pens").filter("image_id = 2").collect()}
    assert [pens[c] for c in range(80)] == [max(line[2 * c : 2 * c + 2], key=lambda k: (luma[k], k)) % 128 for c in range(80)]
