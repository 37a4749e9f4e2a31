"""Names and descriptions as column expressions, and text in fixed-width records."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_name(c: Column) -> Column:
    """Upper-case [A-Z0-9_] of a name, at most 8; empty is IMG, a leading digit gets an I."""
    s = F.regexp_replace(F.upper(c), "[^A-Z0-9_]", "")
    s = F.when(s == "", "IMG").when(s.rlike("^[0-9]"), F.concat(F.lit("I"), s)).otherwise(s)
    return F.substring(s, 1, 8)


def name_problem(c: Column) -> Column:
    """The first rule that a short name breaks, or null."""
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(F.char_length(c) > 8, "too long")
        .when(c.rlike("^[0-9]"), "starts with a digit")
        .when(~c.rlike("^[A-Z0-9_]*$"), "bad character")
    )


def clean_description(c: Column) -> Column:
    """{text, problem}: white space run together; other than printable ASCII or over 75 characters is a problem."""
    text = F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    problem = F.when(~text.rlike("^[ -~]*$"), "only printable ASCII").when(F.char_length(text) > 75, F.concat(F.char_length(text).cast("string"), F.lit(" characters, 75 at most")))
    return F.struct(text.alias("text"), problem.alias("problem"))


def preview_number(c: Column) -> Column:
    """NN of Preview_NN.png or .txt, any case; else null."""
    n = F.regexp_extract(c, r"(?i)^preview_(\d+)\.(png|txt)$", 1)
    return F.when(n != "", n.cast("int"))


def unique_name(name: str, taken: set[str], last: dict[str, int] | None = None) -> str:
    """A short name not taken yet: its tail is overwritten by 01, 02, ...

    ``last`` keeps each name's last counter for calls in a row over a ``taken`` that only
    grows, so that lower counters aren't tried again. After 9,999,999 the counter would
    take the first character's place, and a name can't begin with a digit.
    """
    if name not in taken:
        return name
    last = {} if last is None else last
    for i in range(last.get(name, 0) + 1, 10_000_000):
        tail = f"{i:02d}"
        new = name[: 8 - len(tail)] + tail
        if new not in taken:
            last[name] = i
            return new
    raise ValueError("no name of 8 characters is left")


def wrap(text: str, width: int = 57) -> list[str]:
    out: list[str] = []
    for word in re.split(r"\s+", text.strip()):
        if out and len(out[-1]) + 1 + len(word) <= width:
            out[-1] += " " + word
        elif word:
            out.append(word)
    return out


#: Most lines of an .nfo file.
NFO_LINES = 127


def nfo_encode(lines: list[str], attr: int = 0) -> bytes:
    """Records of 80 {glyph, attribute} pairs, then one of zeros; 127 lines at most."""
    if len(lines) > NFO_LINES:
        raise ValueError("too many lines")
    return b"".join(bytes(v for ch in line[:80].ljust(80).encode("latin-1", "replace") for v in (ch, attr)) for line in lines) + bytes(160)


def nfo_decode(raw: bytes) -> list[str]:
    out = []
    for a in range(0, len(raw) - 159, 160):
        rec = raw[a : a + 160]
        if not any(rec):
            break
        out.append(rec[::2].decode("latin-1").rstrip())
    return out
