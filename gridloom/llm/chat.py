"""Operator 10 (native): chat formatting into budgeted windows.

Only DataFrame functions. A turn is written as

    <|im_start|>ROLE newline TEXT<|im_end|> newline

A backslash in a role or text is doubled and ``<|`` becomes ``<\\|``, so no text can hold a
control string; a newline in a role becomes ``\\n``. ``unescape`` reverts all of it.

A token here is a byte of formatted UTF-8 text, of which a byte-level tokenizer makes one id at
most, so ``budget`` bounds any such tokenizer's ids and is held exactly.

Prefix sums of turn tokens choose the windows: with S = (budget - history - tokens of the
system turn) / 2, the turns that start in [kS, (k+1)S) form a span, and a turn of over S
tokens stands alone. So a window's own turns stay within 2S unless it is one such turn, and
no sequential walk is needed: rows are dealt by ranges of (conversation, turn, role, text), and
sums run within a range and then over ranges, so a conversation that holds a third of all rows
is spread, whatever its turn numbers. A leading system turn opens every window; all turns before
a window that start within ``history`` tokens before it (less where its one long turn leaves less
room) follow it as history. Only a window whose system turn and one own turn are over the
budget by themselves exceeds it, and has no history. The loss mask covers each assistant text in
the window where it isn't a repeat.

Cases: a null role or text is empty; turns sort by (turn, role, text), null turns first, and
equal rows are turns of their own; rows with a null conv_id form one conversation; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialize, read

START, END = "<|im_start|>", "<|im_end|>"
#: Bytes of a turn's marks and line ends.
MARKS = len(START) + len(END) + 2


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column) -> Column:
    one = lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), one), "\\")


def tokens(role: Column, text: Column) -> Column:
    """Bytes of a turn as it is written."""
    return (F.octet_length(escape_role(role)) + F.octet_length(escape(text)) + MARKS).cast("long")


def format_windows(turns: DataFrame, budget: int = 8192, history: int = 1024) -> DataFrame:
    """Per window: conv_id, window_id (number of its first own turn in the conversation), text,
    n_context (repeated turns that lead it), n_turns, n_tokens and loss_mask (start and length in
    characters of text)."""
    order = ["conv", "turn", "role", "text"]
    t = turns.select(
        F.struct(F.col("conv_id").alias("id")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    t = t.withColumn("n", tokens(F.col("role"), F.col("text")))
    # written at once, so that a row's block and rank don't change
    dealt = t.repartitionByRange(*order).withColumn("block", F.spark_partition_id())
    in_block = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    t = materialize(dealt.withColumn("rn", F.row_number().over(in_block) - 1))
    # the first row of each conversation; partial minima come before the shuffle
    first = t.groupBy("conv").agg(F.min(F.struct("block", "rn", "role", "text", "n")).alias("f"))
    sys = F.col("f.role") == "system"
    info = first.select("conv", sys.alias("sys"), F.when(sys, F.col("f.text")).alias("sys_text"), F.col("f.block").alias("sys_block"), F.when(sys, F.col("f.n")).otherwise(0).alias("sys_n"))
    info = materialize(info.withColumn("S", F.greatest(F.lit(1).cast("long"), F.floor((budget - history - F.col("sys_n")) / 2))))
    slim = t.join(info.select("conv", "S", "sys_n", F.when(F.col("sys"), F.col("sys_block")).alias("sb")), "conv")
    lead = (F.col("rn") == 0) & F.coalesce(F.col("block") == F.col("sb"), F.lit(False))
    r = slim.withColumn("lead", lead).withColumn("own", F.when(F.col("lead"), 0).otherwise(F.col("n"))).withColumn("big", (F.col("own") > F.col("S")).cast("long"))
    before = Window.partitionBy("conv", "block").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("tok0", F.coalesce(F.sum("own").over(before), F.lit(0))).withColumn("big0", F.coalesce(F.sum("big").over(before), F.lit(0)))
    r = materialize(r)
    total = r.groupBy("conv", "block").agg(F.sum("own").alias("tok"), F.sum("big").alias("bigs"), F.count("*").alias("rows"))
    over_blocks = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("conv", "block", *[F.coalesce(F.sum(c).over(over_blocks), F.lit(0)).alias(f"{c}_off") for c in ("tok", "bigs", "rows")])
    r = r.join(total, ["conv", "block"]).select(
        "conv", "lead", "role", "text", "n", "own", "S", "sys_n",
        (F.col("rows_off") + F.col("rn")).alias("idx"),
        (F.col("tok_off") + F.col("tok0")).alias("start"),
        (2 * (F.col("bigs_off") + F.col("big0")) + F.col("big")).alias("sub"),
    ).withColumn("span", F.floor(F.col("start") / F.col("S")))
    r = materialize(r)
    wins = r.groupBy("conv", "span", "sub").agg(F.min("start").alias("wstart"), F.min("idx").alias("wid"), F.sum("own").alias("wown"), F.max("sys_n").alias("sys_n"))
    room = F.greatest(F.lit(0), F.least(F.lit(history), budget - F.col("sys_n") - F.col("wown")))
    wins = materialize(wins.withColumn("room", room))
    piece = ["idx", "new", "role", "text", "n"]
    own = r.join(wins.select("conv", "span", "sub", "wid"), ["conv", "span", "sub"]).select("conv", "wid", "idx", F.lit(True).alias("new"), "role", "text", "n")
    # turns meet the windows that start up to ``history`` after them by stretches of that length
    stretch = lambda c: F.floor(F.col(c) / max(1, history))
    near = r.filter(~F.col("lead")).withColumn("at", F.explode(F.array(stretch("start"), stretch("start") + 1)))
    later = wins.filter("room > 0").select("conv", "wid", "wstart", "room", stretch("wstart").alias("at"))
    past = near.join(later, ["conv", "at"]).filter((F.col("start") < F.col("wstart")) & (F.col("idx") < F.col("wid")) & (F.col("wstart") - F.col("start") <= F.col("room")))
    past = past.select("conv", "wid", "idx", F.lit(False).alias("new"), "role", "text", "n")
    j = own.unionByName(past)
    again = wins.filter("wid > 0").select("conv", "wid").join(info.filter("sys"), "conv").select(
        "conv", "wid", F.lit(-1).cast("long").alias("idx"), F.lit(False).alias("new"), F.lit("system").alias("role"), F.col("sys_text").alias("text"), F.col("sys_n").alias("n")
    )
    w = j.unionByName(again).groupBy("conv", "wid").agg(F.array_sort(F.collect_list(F.struct(*piece))).alias("turns"))
    frame = F.transform("turns", lambda x: F.struct(F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["new"] & (x["role"] == "assistant")).alias("loss")))
    w = w.withColumn("frame", frame)
    tail = F.lit(END + "\n")
    mask = F.aggregate(
        "frame",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("m")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"]) + len(END) + 1).alias("at"),
            F.when(x["loss"], F.array_append(acc["m"], F.struct((acc["at"] + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).alias("length")))).otherwise(acc["m"]).alias("m"),
        ),
    )["m"]
    return w.select(
        F.col("conv.id").alias("conv_id"),
        F.col("wid").cast("long").alias("window_id"),
        F.array_join(F.transform("frame", lambda x: F.concat(x["head"], x["body"], tail)), "").alias("text"),
        F.size(F.filter("turns", lambda x: ~x["new"])).alias("n_context"),
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_tokens"),
        mask.alias("loss_mask"),
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """Windows with their first-time turns (role, text) and loss texts, parsed from text."""
    parts = F.slice(F.split("text", r"<\|im_end\|>\n", -1), F.col("n_context") + 1, F.col("n_turns") - F.col("n_context"))

    def turn(p: Column) -> Column:
        at = F.instr(p, "\n")
        return F.struct(unescape(F.substring(p, len(START) + 1, at - len(START) - 1)).alias("role"), unescape(F.substring(p, at + 1, F.char_length(p))).alias("text"))

    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("text"), m["start"] + 1, m["length"])))
    return windows.withColumn("turns", F.transform(parts, turn)).withColumn("loss", F.array_join(loss, ""))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The added conversation has a key of its own, so one of the table with that id stays apart."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("added", F.lit(False))
    marks = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(END + START + "assistant ok").alias("text"), F.lit(True).alias("added"))
    w = read_turns(format_windows(c.unionByName(marks).withColumn("conv_id", F.struct("conv_id", "added"))))
    flat = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    w = w.select("conv_id", "window_id", F.size("turns").alias("k"), flat.alias("flat"), "loss", F.char_length("text").alias("chars"))
    per = w.groupBy("conv_id").agg(F.sum("k").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window_id", "flat", "loss"))).alias("x"), F.sum("chars").alias("formatted_chars"))
    joined = lambda f: F.array_join(F.col(f"x.{f}"), "")
    return per.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(joined("flat").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
