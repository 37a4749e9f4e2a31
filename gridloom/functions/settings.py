"""Settings of a conversion: fields, argument lists, command lines and JSON records."""

from __future__ import annotations

import json
from typing import Any, NamedTuple


class Field(NamedTuple):
    name: str
    default: Any
    flag: str
    #: A field that must be set, or one and a value it must not have, for the flag to mean anything.
    needs: tuple[str, Any] | None = None


#: Fields, defaults and flags in the order of an argument list. A switch has no value;
#: its flag says the opposite of the default.
FIELDS = [
    Field("input", "", ""),
    Field("out", "out", "--out"),
    Field("name", "", "--name"),
    Field("cell", 8, "--cell"),
    Field("palettes", 4, "--palettes"),
    Field("slots", 256, "--slots"),
    Field("reserve0", True, "--no-reserve0"),
    Field("colors", 0, "--colors"),
    Field("resize", "320x240", "--resize"),
    Field("filter", "lanczos", "--filter", ("resize", "")),
    Field("fit", "stretch", "--fit", ("resize", "")),
    Field("display_aspect", "4:3", "--display-aspect", ("fit", "stretch")),
    Field("description", "", "--description"),
    Field("max_colors", False, "--max-colors"),
    Field("color_bias", 0.0, "--color-bias", ("max_colors", True)),
    Field("optimize", True, "--no-optimize"),
    Field("coherence", 1.5, "--coherence"),
    Field("dither", "none", "--dither"),
    Field("dither_strength", 1.0, "--dither-strength", ("dither", "none")),
    Field("seed", 0, "--seed"),
]
BY_NAME = {f.name: f for f in FIELDS}
BY_FLAG = {f.flag: f for f in FIELDS if f.flag}
DEFAULTS = {f.name: f.default for f in FIELDS}
#: Fields that are written even on their default, if they aren't empty.
ALWAYS = ("out", "resize")
_SPECIAL = set(" \t\"'\\&|<>^()")


def _matters(f: Field, s: dict) -> bool:
    while f.needs:
        other, without = f.needs
        if s[other] == without:
            return False
        f = BY_NAME[other]
    return True


def to_argv(settings: dict) -> list[str]:
    """The input and every option that isn't its default and has an effect."""
    s = DEFAULTS | settings
    out = [s["input"]]
    for f in FIELDS[1:]:
        v = s[f.name].strip() if f.name == "description" else s[f.name]
        if isinstance(f.default, bool):
            out += [f.flag] if bool(v) != f.default else []
        elif _matters(f, s) and v != "" and (f.name in ALWAYS or v != f.default) and not (f.name == "colors" and v <= 0):
            out += [f.flag, f"{v:g}" if isinstance(f.default, float) else str(v)]
    return out


def from_argv(argv: list[str]) -> dict:
    """Tolerant inverse of ``to_argv``: unknown options are skipped, with a value that isn't an option;
    a value of the wrong kind leaves the default."""
    s, rest = dict(DEFAULTS), [str(a) for a in argv]
    while rest:
        a = rest.pop(0)
        f = BY_FLAG.get(a)
        if f and isinstance(f.default, bool):
            s[f.name] = not f.default
        elif f:
            if rest:
                try:
                    s[f.name] = type(f.default)(rest.pop(0))
                except ValueError:
                    pass
        elif a.startswith("-"):
            if rest and not rest[0].startswith("-"):
                rest.pop(0)
        elif not s["input"]:
            s["input"] = a
    return s


def quote(text: str) -> str:
    return text if text and not _SPECIAL & set(text) else '"' + text.replace('"', '\\"') + '"'


def split_line(line: str) -> list[str]:
    """Arguments of a line: double quotes group, ``\\"`` in them is a quote, any other backslash is one."""
    import re

    found = re.finditer(r'(?:"(?:\\"|[^"])*"?|[^\s"])+', line)
    inner = lambda m: m[1].replace('\\"', '"') if m[1] is not None else m[0]
    return [re.sub(r'"((?:\\"|[^"])*)"?|[^"]+', inner, m[0]) for m in found]


def command_line(settings: dict, script: str = "convert.py", python: str = "python") -> str:
    return " ".join(map(quote, [python, script, *to_argv(settings)]))


def from_command_line(line: str) -> dict:
    """Settings of a pasted line; an interpreter and a script at its head are passed over."""
    argv = split_line(line)
    while argv and not argv[0].startswith("-"):
        head = argv[0].replace("\\", "/").rpartition("/")[2].lower()
        if not (head.endswith(".py") or head.split(".")[0] in ("python", "python3", "py")):
            break
        argv.pop(0)
    return from_argv(argv)


def from_record(d: dict) -> dict:
    """Settings of a JSON record: what is missing has its default, what is unknown is dropped, and an
    empty size is one of before sizes were fixed."""
    s = DEFAULTS | {k: v for k, v in d.items() if k in DEFAULTS}
    return s | ({} if s["resize"] else {"resize": DEFAULTS["resize"]})


def to_record(settings: dict, preset: str | None = None) -> str:
    """JSON of all fields; a preset has its name and no input, out, name or description."""
    s = DEFAULTS | settings
    if preset is not None:
        s = {"_name": preset} | {k: v for k, v in s.items() if k not in ("input", "out", "name", "description")}
    return json.dumps(s, sort_keys=True)


def usable(settings: dict) -> int:
    s = DEFAULTS | settings
    return int(s["slots"]) - bool(s["reserve0"])


def budget(settings: dict) -> int:
    return int((DEFAULTS | settings)["palettes"]) * usable(settings)


def effective_bias(settings: dict) -> float:
    s = DEFAULTS | settings
    return 1.0 if s["max_colors"] else max(0.0, min(1.0, float(s["color_bias"])))


def effective_name(settings: dict) -> str:
    s = DEFAULTS | settings
    return s["name"] or s["input"].replace("\\", "/").rpartition("/")[2].rpartition(".")[0] or s["input"].replace("\\", "/").rpartition("/")[2]


def parse_size(text: str) -> tuple[int, int]:
    w, h = text.lower().split("x")
    return int(w), int(h)


def parse_aspect(text: str) -> float:
    a, _, b = text.partition(":")
    return float(a) / float(b) if b else float(a)


def parse_colour(text: str) -> tuple[int, int, int]:
    return tuple(bytes.fromhex(text.lstrip("#")[:6]))  # type: ignore[return-value]
