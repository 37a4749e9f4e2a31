"""Text for an 80-column screen of glyphs and colours, and the texts of reports and summaries."""

from __future__ import annotations

import json
import re
import textwrap

from . import settings as S

COLUMNS, LINES, COLON = 80, 127, 21


def pen(hue: int, luma: int) -> int:
    return hue * 8 + luma // 2


#: Pens of the parts of a line, as fixed values.
LABEL, COLON_PEN, VALUE, NOTE, TITLE, GOOD, BAD, PLAIN = pen(15, 8), pen(8, 8), pen(7, 4), pen(8, 6), pen(1, 14), pen(12, 12), pen(3, 6), pen(0, 14)
#: Pens of the rule that runs through a banner, as fixed values: a fade towards the middle.
RULE = [
    0x38, 0x38, 0x38, 0x38, 0x38, 0x39, 0x39, 0x39, 0x39, 0x39, 0x3A, 0x3A, 0x3A, 0x3A, 0x3A, 0x3A, 0x3B, 0x3B, 0x3B, 0x3B,
    0x3B, 0x3C, 0x3C, 0x3C, 0x3C, 0x3C, 0x3D, 0x3D, 0x3D, 0x7D, 0x0D, 0x7D, 0x7E, 0x7E, 0x7E, 0x7E, 0x7F, 0x0F, 0x7F, 0x0F,
    0x0F, 0x7F, 0x0F, 0x7F, 0x7E, 0x7E, 0x7E, 0x7E, 0x7D, 0x0D, 0x7D, 0x3D, 0x3D, 0x3D, 0x3C, 0x3C, 0x3C, 0x3C, 0x3C, 0x3B,
    0x3B, 0x3B, 0x3B, 0x3B, 0x3A, 0x3A, 0x3A, 0x3A, 0x3A, 0x3A, 0x39, 0x39, 0x39, 0x39, 0x39, 0x38, 0x38, 0x38, 0x38, 0x38,
]


def cap_first(text: str) -> str:
    return re.sub(r"^( *)(n/a|[^ ]?)", lambda m: m[1] + m[2].upper(), text)


def row(label: str, value: object, as_entered: bool = False) -> str:
    return f"{cap_first(label.strip()):<{COLON}}: {value if as_entered else cap_first(str(value))}"


def more(text: str) -> str:
    return " " * (COLON + 2) + text


def description(text: str | None, source: str, most: int = 75) -> str:
    base = source.replace("\\", "/").rpartition("/")[2]
    stem = base[: base.rfind(".")] if base.rfind(".") > 0 else base
    return ((text or "").strip() or stem.rstrip("."))[:most].rstrip()


def redescribe(text: str, new: str) -> str:
    """A report whose description is ``new``: in place of the rows it had, else below the input's row."""
    wrapped = textwrap.wrap(new, COLUMNS - COLON - 2) or [""]
    rows = [row("Description", wrapped[0], True), *map(more, wrapped[1:])]
    lines, blank = text.rstrip("\n").split("\n"), " " * (COLON + 2)
    of = {line[:COLON].rstrip(): k for k, line in reversed(list(enumerate(lines)))}
    start = of.get("Description")
    if start is None:
        start = end = of.get("Input", 0) + 1
    else:
        end = next((k for k in range(start + 1, len(lines)) if not (lines[k].startswith(blank) and lines[k].strip())), len(lines))
    return "\n".join(lines[:start] + rows + lines[end:]) + "\n"


#: Labels and sentences of a report, which readers of old ones look for, in order. A row is its
#: label, its text, and what must hold for it (``!`` for what must not); one without a label goes on
#: with the row before, and one without both is empty.
ROWS = [
    ("Dimensions", "{source_width} x {source_height}  ({source_pixels} px)", ""),
    ("Resampled", "{width}x{height} via {args[filter]} (fit={args[fit]}{aspect})", "resized"),
    ("Resampled", "none (native {width}x{height})", "!resized"),
    ("Cell width", "{cell_width} px  ->  {cells_per_line} cells/line * {height} lines = {cells} cells", ""),
    ("Palettes x slots", "{palettes} x {slots}  (usable {usable_per_palette}/palette{reserved})", ""),
    ("Transparent px", "{transparent_pixels} letterbox/pillarbox -> index 0", "padded"),
    ("Pre-quantized", "{source_colours} source colours{reduced}", ""),
    ("Master colours", "{master_colours}", ""),
    ("Output colours", "{output_colours}  (distinct RGB on screen)", ""),
    ("", "", ""),
    ("Convertor Version", "{convertor_version}", ""),
    ("Strategy", "{strategy}", ""),
    ("Coherence", "{coherence:.2f}  (attribute-map smoothing)", "balanced"),
    ("Coherence", "{coherence:.2f}  (unused - {kind} strategy)", "!balanced"),
    ("Dithering", "none", "!dithers"),
    ("Dithering", "{dither}, strength {dither_strength:.2f}{inert}", "dithers"),
    ("Result", "Lossless - components packed into {palettes} palettes", "lossless"),
    ("", "with no colour loss.", "lossless"),
    ("Result", "Lossy - cells could not be partitioned cleanly.", "!lossless"),
    ("recoloured pixels", "{recoloured_pixels} ({recoloured_pct:.3f}% of image)", "!lossless"),
    ("mean OKLab error", "{mean_oklab_error:.4f}  (on recoloured pixels only)", "!lossless"),
    ("note", "a single component needs {largest_component} colours (> {usable_per_palette});", "crowded"),
    ("", "raise --color-bias (e.g. 0.5 or 1.0) for more colours.", "crowded"),
    ("identical pixels", "{acc[identical_pixels]} / {acc[compared_pixels]}  ({acc[identical_pct]:.2f}% of opaque px)", ""),
    ("RMSE (sRGB)", "{acc[rgb_rmse]:.2f}     <- the norm distance", ""),
    ("PSNR", "identical - the cell rule cost nothing", "!differs"),
    ("PSNR", "{acc[psnr_db]:.1f} dB", "differs"),
    ("mean OKLab error", "{acc[mean_oklab_error]:.4f}  (every pixel, not just the recoloured ones)", ""),
    ("worst OKLab error", "{acc[max_oklab_error]:.4f}", ""),
    ("cells damaged", "{acc[cells_damaged]} / {acc[cells_compared]}  ({acc[cells_damaged_pct]:.1f}%)", ""),
    ("cell seams", "n/a (no column detail to measure)", "!seamed"),
    ("cell seams", "{acc[seam_index]:.2f}x  (the cell grid added no visible seam)", "seamed"),
    ("", "RMSE and PSNR above cannot see this", "seamed"),
    ("", "", ""),
    ("Per-palette colours", "{own} / {usable_per_palette} colours", ""),
    ("Duplicated Colours", "{duplicated_across_palettes} {entries} ({distinct_in_all_palettes} distinct colours in all palettes)", ""),
]


def report(stats: dict, title: str = "conversion report") -> str:
    """The report of a conversion from its figures, in 80 columns: the rows of ``ROWS`` that hold."""
    args, acc, kind = stats["args"], stats["ideal_vs_output"], stats["strategy"].partition(" ")[0]
    holds = {
        "": True, "resized": stats["resized"], "padded": stats["transparent_pixels"] > 0, "balanced": kind == "balanced", "dithers": stats["dither"] != "none", "lossless": stats["lossless"],
        "crowded": kind == "fidelity" and not stats["lossless"] and stats["largest_component"] > stats["usable_per_palette"], "differs": acc["psnr_db"] is not None, "seamed": acc["seam_index"] is not None,
    }
    fields = stats | {
        "acc": acc, "kind": kind, "source_pixels": stats["source_width"] * stats["source_height"], "entries": "entry" if stats["duplicated_across_palettes"] == 1 else "entries",
        "aspect": "" if args["fit"] == "stretch" else f", display-aspect={args['display_aspect']}", "reserved": ", slot 0 = transparent" if stats["reserve0"] else "",
        "reduced": f" -> reduced to {stats['master_colours']}" if stats["prequantized"] and stats["source_colours"] > stats["master_colours"] else "",
        "inert": "" if stats["prequantized"] else "  (inert - source within colour budget)", "own": " ".join(f"P{i}: {p['unique_to_palette']}" for i, p in enumerate(stats["per_palette"])),
    }
    said, *rest = textwrap.wrap(stats["description"], COLUMNS - COLON - 2) or [""]
    out = [title.center(COLUMNS, "="), row("Input", stats["source_name"], True), row("Description", said, True), *map(more, rest)]
    for label, text, when in ROWS:
        if bool(holds[when.lstrip("!")]) != when.startswith("!"):
            text = text.format_map(fields)
            out.append(row(label, text) if label else more(text) if text else "")
    return "\n".join(out)


def psnr_text(stats: dict) -> str:
    acc = stats.get("ideal_vs_output")
    return "" if not isinstance(acc, dict) or not acc else "identical" if acc.get("psnr_db") is None else f"{acc['psnr_db']:.1f} dB"


def seam_text(seam: float | None) -> str:
    return "n/a  (no column detail to measure)" if seam is None else f"{seam:.2f}x  (grid {'not visible' if seam < 1.10 else 'showing'})"


#: Thresholds above which a figure warns and is an error, as fixed values; None for none.
TONES = {"seam_index": (1.10, 1.30), "recoloured_pct": (1.0, 5.0), "mean_oklab_error": (0.02, None), "cells_damaged_pct": (25.0, None)}


def headline(settings: dict, stats: dict) -> str:
    if not stats:
        return ""
    n = stats.get("output_colours", 0)
    if stats.get("lossless"):
        return f"LOSSLESS - {n} colours of a possible {S.budget(settings)}"
    psnr = psnr_text(stats)
    return f"lossy ({stats.get('strategy', '?')}) - {n} colours, {stats.get('recoloured_pct', 0.0):.2f}% of pixels recoloured" + (f", {psnr} vs ideal" if psnr else "")


#: What marks the line before a text's record of settings and figures.
DATA = "[data]"


def with_data(text: str, settings: dict, stats: dict) -> str:
    """A text, its command line, and a footer with settings and figures in one line of JSON."""
    record = json.dumps({"settings": S.DEFAULTS | settings, "stats": stats}, sort_keys=True)
    return f"{text.rstrip()}\n\nrun with\n{'-' * 64}\n{S.command_line(settings)}\n\n{DATA}  settings and figures, one line\n{record}\n"


def settings_of(text: str) -> tuple[dict | None, str]:
    """Settings that a text holds and how sure they are: of its last footer that reads, else of its
    ``run with`` line."""
    for part in reversed(re.split(r"^\[data\].*\n", text, flags=re.M)[1:]):
        try:
            got = json.loads(part.split("\n", 1)[0])
            return S.from_record(got["settings"]), "exact"
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    line = re.search(r"^run with\n-+\n(.+)$", text, re.M)
    return (S.from_command_line(line[1]), "command") if line else (None, "none")


def parse_stats(out: str) -> dict | None:
    """The last line of a program's output that is a JSON object with figures."""
    for line in reversed((out or "").strip().splitlines()):
        try:
            got = json.loads(line) if line.strip().startswith("{") else None
        except ValueError:
            got = None
        if isinstance(got, dict) and "output_colours" in got:
            return got
    return None


def settings_from_stats(stats: dict, text: str = "") -> tuple[dict, bool]:
    """Settings of a conversion's figures, and whether they are its very options. Without those,
    what figures and report name is taken, and defaults for the rest."""
    if isinstance(stats.get("args"), dict):
        return S.from_record({k: "" if v is None and k in ("name", "description", "resize") else v for k, v in stats["args"].items()}), True
    s = {k: stats[k] for k in ("input", "resize", "filter", "fit", "reserve0", "coherence", "description") if stats.get(k) is not None}
    bias = float(stats.get("color_bias") or 0)
    s |= {"max_colors": True} if bias >= 1 else {"color_bias": bias}
    if aspect := re.search(r"display-aspect=([^)\s]+)", text):
        s["display_aspect"] = aspect[1]
    said = re.search(r"^Dithering\s*: (\w+)(?:, strength ([\d.]+))?", text, re.M)
    if stats.get("dither"):
        s |= {"dither": stats["dither"], "dither_strength": float(stats.get("dither_strength") or 1)}
    elif said:
        s |= {"dither": said[1].lower()} | ({"dither_strength": float(said[2])} if said[2] else {})
    return S.DEFAULTS | s, False
