"""Texts on a screen of 80 columns: a glyph and a pen for every place, as expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import screen as T
from . import sql

#: The banner that SQL and Spark cut at its title.
_EDGE = ("^=+", "=+$")


def _let(of: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(of), then), F.lit(0))


def pens(text: Column) -> Column:
    """A pen for each of the 80 places of a line, by what the line is: empty; a banner, whose title stands
    in a rule; a row of label, colon at its place and value; the rest of a value; a heading; a free label and
    value; or a value alone. In values, notes in brackets and all from an arrow on have a pen of
    their own, as has the verdict of a result."""
    return _let(F.substring(text, 1, T.COLUMNS), lambda line: _let(_parts(line), lambda p: _let(_notes(p), lambda notes: _pens(p, notes))))


def _parts(line: Column) -> Column:
    """What kind of line it is and where its parts begin, from 0."""
    n, label = F.length(line), F.substring(line, 1, T.COLON)
    lead, trail = (F.length(F.regexp_extract(line, e, 0)) for e in _EDGE)
    row = (F.substring(line, T.COLON + 1, 1) == ":") & (F.btrim(label) != "")
    going_on = F.startswith(line, F.lit(" " * (T.COLON + 2)))
    heading = ~row & ~going_on & F.endswith(F.rtrim(line), F.lit(":"))
    free = F.instr(line, ": ")
    colon = F.when(row, T.COLON).when(~going_on & ~heading & (free > 0), free - 1)
    verdict = F.when(row & (F.btrim(label) == "Result"), F.regexp_extract(F.substr(line, F.lit(T.COLON + 2)), r"^ (Lossless|Lossy)\b", 1)).otherwise("")
    start = F.when(verdict != "", T.COLON + 2 + F.length(verdict)).otherwise(F.coalesce(colon + 1, F.lit(0)))
    kind = F.when(F.btrim(line) == "", "empty").when((lead > 0) & (trail > 0) & (lead < n), "banner").when(heading, "heading").otherwise("value")
    return F.struct(n.alias("n"), kind.alias("kind"), lead.alias("lead"), (n - trail).alias("end"), colon.alias("colon"), verdict.alias("verdict"), start.alias("start"), F.substr(line, start + 1).alias("value"))


def _notes(p: Column) -> Column:
    """Whether each place of the value belongs to a note."""
    value = p["value"]
    arrow = F.instr(value, "<-")

    def step(acc: Column, i: Column) -> Column:
        """Open brackets after a place, and whether it stands in some."""
        c = F.substr(value, i, F.lit(1))
        deep = acc["deep"] + (c == "(").cast("int")
        inside = (deep > 0) | ((arrow > 0) & (i >= arrow))
        return F.struct((deep - ((c == ")") & (deep > 0)).cast("int")).alias("deep"), F.array_append(acc["note"], inside).alias("note"))

    places = F.when(F.length(value) > 0, F.sequence(F.lit(1), F.length(value))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.struct(F.lit(0).alias("deep"), F.array().cast("array<boolean>").alias("note")), step)["note"]


def _pens(p: Column, notes: Column) -> Column:
    rule = F.array(*map(F.lit, T.RULE))

    def one(j: Column) -> Column:
        return (
            F.when((j >= p["n"]) | (p["kind"] == "empty"), T.PLAIN)
            .when(p["kind"] == "banner", F.when((j >= p["lead"]) & (j < p["end"]), T.TITLE).otherwise(F.get(rule, j)))
            .when(p["kind"] == "heading", T.TITLE)
            .when(j < p["colon"], T.LABEL)
            .when(j == p["colon"], T.COLON_PEN)
            .when(j < p["start"], F.when(j == T.COLON + 1, T.PLAIN).when(p["verdict"] == "Lossless", T.GOOD).otherwise(T.BAD))
            .when(F.get(notes, j - p["start"]), T.NOTE)
            .otherwise(T.VALUE)
        )

    return F.transform(F.sequence(F.lit(0), F.lit(T.COLUMNS - 1)), one)


def lines(text: Column) -> Column:
    """Lines of a text, whichever ends they have; empty ones at its end don't count."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))


def screen(text: Column) -> Column:
    """Records of 80 pairs of glyph and pen for the lines of a text, then one of zeros, as bytes; a text of
    over 127 lines is an error."""
    byte = lambda v: F.lpad(F.hex(v), 2, "0")

    def record(line: Column) -> Column:
        shown = F.rpad(line, T.COLUMNS, " ")  # cut, too
        pair = lambda of, j: F.concat(byte(F.pmod(F.ascii(F.substr(shown, j + 1, F.lit(1))), F.lit(256))), byte(F.get(of, j)))
        return _let(pens(line), lambda of: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(T.COLUMNS - 1)), lambda j: pair(of, j)), ""))

    def whole(all_of: Column) -> Column:
        many = F.raise_error(F.concat(F.size(all_of).cast("string"), F.lit(f" lines, {T.LINES} at most"))).cast("binary")
        return F.when(F.size(all_of) > T.LINES, many).otherwise(F.unhex(F.concat(F.array_join(F.transform(all_of, record), ""), F.lit("00" * 2 * T.COLUMNS))))

    return _let(lines(text), whole)


#: Lines of every kind about each image, in the SQL that both engines share.
_LINES = """select image_id, line_no, line from report
    union all select distinct image_id, 20, '=====image ' || cast(image_id as varchar(20)) || '=====' from px
    union all select distinct image_id, 21, 'Image ' || cast(image_id as varchar(20)) || ':' from px
    union all select image_id, 22, rpad('Result', 21, ' ') || ': ' || case when count(distinct r) > 60 then 'Lossy' else 'Lossless' end || ' - ' || cast(count(*) as varchar(20)) || ' (of (' || cast(max(y) as varchar(20)) || ') lines) px' from px group by image_id
    union all select image_id, 23, rpad('', 23, ' ') || 'more) (' || cast(max(r) as varchar(20)) || ' <- the most) <-' from px group by image_id
    union all select image_id, 24, 'free: ' || cast(min(r) as varchar(20)) || ' (least)' from px group by image_id
    union all select image_id, 25, 'no label (' || cast(min(g) as varchar(20)) from px group by image_id
    union all select image_id, 26, '   ' from px group by image_id"""


def _text(px: str) -> str:
    report = sql.sized(sql.with_steps(sql.QUERIES["report_rows"][1])).replace("{px}", "px")
    return f"with px as ({px}), report as ({report}) {_LINES}"


def report_pens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pens of report lines of every kind about each image, as hexadecimal digits."""
    from ..sources.grids import vector_grid

    d = spark.sql(_text("select * from {grid}"), grid=vector_grid(spark, sf_dir, 64))
    return d.select("image_id", "line_no", F.array_join(F.transform(pens(F.col("line")), lambda v: F.lpad(F.hex(v), 2, "0")), "").alias("pens"))


def _oracle() -> str:
    from ..sources.grids import vector_grid_sql

    rule = ", ".join(map(str, T.RULE))
    return f"""with t as ({_text(vector_grid_sql(64))}),
      k as (select *, length(line) as n, length(regexp_extract(line, '^=+')) as lead, length(regexp_extract(line, '=+$')) as trail, substr(line, 22, 1) = ':' and trim(substr(line, 1, 21)) <> '' as is_row,
        starts_with(line, repeat(' ', 23)) as on_, rtrim(line) like '%:' as head, instr(line, ': ') as free from (select image_id, line_no, substr(line, 1, 80) as line from t) s),
      v as (select *, case when is_row then 21 when not on_ and not head and free > 0 then free - 1 end as colon,
        case when is_row and trim(substr(line, 1, 21)) = 'Result' then case when regexp_matches(substr(line, 23), '^ Lossless([^a-zA-Z0-9_]|$)') then 'Lossless' when regexp_matches(substr(line, 23), '^ Lossy([^a-zA-Z0-9_]|$)') then 'Lossy' else '' end else '' end as verdict from k),
      w as (select *, case when verdict <> '' then 23 + length(verdict) else coalesce(colon + 1, 0) end as start from v),
      c as (select *, case when j >= start then substr(line, cast(j + 1 as int), 1) else '' end as ch from w, range(0, 80) p(j)),
      s as (select *, sum(case when ch = '(' then 1 when ch = ')' then -1 else 0 end) over (partition by image_id, line_no order by j) as run,
        min(case when j >= start and substr(line, cast(j + 1 as int), 2) = '<-' then j end) over (partition by image_id, line_no) as arrow from c),
      d as (select *, run - least(0, min(run) over (partition by image_id, line_no order by j)) as deep from s),
      e as (select *, case when ch = ')' then coalesce(lag(deep) over (partition by image_id, line_no order by j), 0) else deep end as inside from d)
      select image_id, line_no, string_agg(printf('%02X', cast(case when j >= n or trim(line) = '' then {T.PLAIN}
          when lead > 0 and trail > 0 and lead < n then case when j >= lead and j < n - trail then {T.TITLE} else ([{rule}])[cast(j + 1 as int)] end
          when not is_row and not on_ and head then {T.TITLE} when j < colon then {T.LABEL} when j = colon then {T.COLON_PEN}
          when j < start then case when j = 22 then {T.PLAIN} when verdict = 'Lossless' then {T.GOOD} else {T.BAD} end
          when inside > 0 or j >= arrow then {T.NOTE} else {T.VALUE} end as int)), '' order by j) as pens from e group by image_id, line_no"""


QUERIES = {"report_pens": report_pens}
ORACLE = {"report_pens": _oracle()}
