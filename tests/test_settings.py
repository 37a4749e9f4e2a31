"""Settings and texts: round trips and fixed layouts."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import names as N
from gridloom.functions import screen as T
from gridloom.functions import settings as S
from gridloom.plans import texts as TX


def test_lines_round_trip():
    r = random.Random(0)
    pick = {"fit": ["stretch", "cover", "fit"], "filter": ["box", "lanczos"], "dither": ["none", "floyd", "blue"], "reserve0": [True, False], "optimize": [True, False], "colors": [0, 300], "seed": [0, 7], "slots": [256, 16], "name": ["", "A_1"], "description": ["", 'say "so"', "a & b"], "input": ["x.png", r"C:\d e\x.png"], "out": ["out", r"o p\q"], "coherence": [1.5, 0.0]}
    for _ in range(200):
        s = S.DEFAULTS | {k: r.choice(v) for k, v in pick.items()}
        s |= {"display_aspect": r.choice(["4:3", "16:9"])} if s["fit"] != "stretch" else {}
        s |= {"dither_strength": r.choice([1.0, 0.5])} if s["dither"] != "none" else {}
        s |= {"max_colors": True} if r.random() < 0.3 else {"color_bias": r.choice([0.0, 0.25])}
        assert S.from_argv(S.to_argv(s)) == s == S.from_command_line(S.command_line(s))


def test_options_without_effect_are_left_out():
    assert S.to_argv({"input": "a", "resize": "", "filter": "box", "fit": "fit", "dither_strength": 0.2, "max_colors": True, "color_bias": 0.5}) == ["a", "--out", "out", "--max-colors"]
    assert S.from_argv(["a", "--new", "3", "--seed", "x", "--quiet", "--slots", "9", "b", "--seed"]) == S.DEFAULTS | {"input": "a", "slots": 9}
    assert S.split_line('a "b c" d"e f"g  "" "x\\"y" C:\\p') == ["a", "b c", "de fg", "", 'x"y', "C:\\p"]


def test_records():
    assert S.from_record({"resize": "", "slots": 9, "other": 1}) == S.DEFAULTS | {"slots": 9}
    assert '"_name": "p"' in S.to_record({"input": "x"}, "p") and '"input"' not in S.to_record({"input": "x"}, "p")
    assert (S.usable({}), S.budget({}), S.effective_bias({"color_bias": 7}), S.effective_name({"input": "d\\x.y.png"})) == (255, 1020, 1.0, "x.y")
    assert S.parse_size("320X240") == (320, 240) and S.parse_aspect("16:9") == 16 / 9 and S.parse_aspect("1.5") == 1.5 and S.parse_colour("#0aFF10") == (10, 255, 16)


def test_pens(spark):
    text = ["Result               : Lossless - x (y) <- z", "Heading:", "===ab===", "  ", "a: b", "Result               : Lossyish (a(b)c) d)e", " " * 23 + "v) (w", "Label                : 1 (2" + "x" * 90]
    got = [r.p for r in spark.createDataFrame([(i, v) for i, v in enumerate(text)], "i int, v string").orderBy("i").select(TX.pens(F.col("v")).alias("p")).collect()]
    assert all(len(p) == 80 for p in got)
    row = got[0]
    assert row[:21] == [T.LABEL] * 21 and row[21:23] == [T.COLON_PEN, T.PLAIN] and row[23:31] == [T.GOOD] * 8 and row[31:36] == [T.VALUE] * 5 and row[36:44] == [T.NOTE] * 3 + [T.VALUE] + [T.NOTE] * 4 and row[44:] == [T.PLAIN] * 36
    assert got[1][:8] == [T.TITLE] * 8 and got[2][:8] == T.RULE[:3] + [T.TITLE] * 2 + T.RULE[5:8] and got[3] == [T.PLAIN] * 80
    assert got[4][:5] == [T.LABEL, T.COLON_PEN, T.VALUE, T.VALUE, T.PLAIN]
    at = text[5].index("(")
    assert got[5][22:at] == [T.VALUE] * (at - 22) and got[5][at : at + 7] == [T.NOTE] * 7 and got[5][at + 7 : at + 11] == [T.VALUE] * 4
    assert got[6][23:28] == [T.VALUE] * 3 + [T.NOTE] * 2 and got[7][25:] == [T.NOTE] * 55
    assert [T.cap_first(x) for x in ("abc", "  n/a (x)", "", " é")] == ["Abc", "  N/A (x)", "", " É"]


def test_screen(spark):
    t = ["ab\r\n" + "x" * 90 + "\n\n", "", "\n", "a\n\nÿ€"]
    got = [bytes(r.s) for r in spark.createDataFrame(list(enumerate(t)), "i int, v string").orderBy("i").select(TX.screen(F.col("v")).alias("s")).collect()]
    assert len(got[0]) == 3 * 160 and N.nfo_decode(got[0]) == ["ab", "x" * 80] and not any(got[0][-160:])
    assert got[1] == got[2] == bytes(160) and N.nfo_decode(got[3]) == ["a", "", "ÿ\xac"]
    with pytest.raises(Exception, match="128 lines"):
        spark.createDataFrame([("x\n" * 128,)], "v string").select(TX.screen(F.col("v"))).collect()


def test_summaries_carry_their_settings():
    s = S.DEFAULTS | {"input": "a b.png", "dither": "blue"}
    text = T.with_data("head", s, {"output_colours": 3})
    assert T.settings_of(text) == (s, "exact") and T.settings_of(text + "\n[data] x\nno json\n") == (s, "exact")
    assert T.settings_of(text.split("[data]")[0]) == (s, "command") and T.settings_of("none") == (None, "none")
    assert T.parse_stats('warn\n{"a": 1}\n{"output_colours": 5}\n{broken') == {"output_colours": 5} and T.parse_stats("") is None
    assert T.settings_from_stats({"args": s | {"name": None}}) == (s, True)
    got, exact = T.settings_from_stats({"input": "q", "color_bias": 1.0}, "Resampled            : 3x3 via box (fit=fit, display-aspect=16:9)\nDithering            : Floyd, strength 0.50")
    assert not exact and (got["max_colors"], got["dither"], got["dither_strength"], got["display_aspect"]) == (True, "floyd", 0.5, "16:9")
    assert T.headline({}, {"lossless": True, "output_colours": 9}) == "LOSSLESS - 9 colours of a possible 1020" and T.headline({}, {}) == ""
    assert T.psnr_text({"ideal_vs_output": {"psnr_db": None}}) == "identical" and T.psnr_text({}) == "" and T.seam_text(1.2).endswith("(grid showing)")
    assert T.description(" x ", "f.png") == "x" and T.description("", "d/f.g..png") == "f.g" and len(T.description("y" * 90, "")) == 75
