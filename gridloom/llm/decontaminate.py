"""Operator 2 (native): benchmark decontamination as a prefix-filtered set join.

Only DataFrame functions; no Python runs on the executors. Words are runs of ASCII
digits, ASCII letters and code points from 128, with A-Z lower-cased. A window is 13
consecutive words of an item, or all words of a shorter item. A document word inside
an occurrence of a window is hit.

1. Windows are cut into shingles of up to three words; their frequencies are counted
   over all documents (partial sums before the shuffle).
2. Shingles are ordered by rarity. For exact containment the necessary prefix of a
   window is its rarest shingle; a window with a shingle that no document has is out.
3. Document positions join the prefixes. Positional and length bounds (the window must
   fit between the document's first and last word) come before the exact comparison
   of the item-sized slice of words.
4. Occurrences become intervals; a document's covered words are summed over them.

The benchmark side is broadcast within a checked size, else both joins shuffle by
shingle, documents sending positions only and fetching their words again by key.

Cases: null or wordless texts have no words and no hits; wordless or null items have no
window; repeated items count once by item_id, null item_ids are ignored; rows with equal
doc_id and text are found once and give a result each; empty tables and extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, bytes_of, fresh, materialize, read

#: A run of characters that belong to no word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII_GAPS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a shingle, at most.
K = 3


def words_of(text: Column) -> Column:
    """Array of words; [''] or null if there are none."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.split(F.btrim(low, F.lit(_ASCII_GAPS)), GAP)


def n_of(words: Column) -> Column:
    return F.when(words.isNull() | (words[0] == ""), 0).otherwise(F.size(words))


def _windows(bench: DataFrame, n: int) -> DataFrame:
    """Distinct windows: win (array of words), items (sorted distinct item_ids), length."""
    w = bench.select(F.col("item_id"), words_of(F.col("text").cast("string")).alias("w")).filter("item_id is not null and w is not null and w[0] <> ''")
    w = w.withColumn("n", F.least(F.size("w"), F.lit(n)))
    w = w.select("item_id", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("at"))
    w = w.select("item_id", F.slice("w", F.col("at"), F.col("n")).alias("win"))
    return w.groupBy("win").agg(F.collect_set("item_id").alias("items"))


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """Every position with a shingle of k words, and one row per document with a null one."""
    d = docs.withColumn("words", words_of(F.col("text"))).withColumn("n_words", n_of(F.col("words")))
    d = d.select("key", "n_words", "words", F.posexplode(F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("p", "w"))
    rest = [F.get(F.col("words"), F.col("p") + i) for i in range(1, k)]
    return d.withColumn("sh", F.when(F.col("w").isNotNull() & (F.col("p") + k <= F.col("n_words")), F.xxhash64(F.lit(k), "w", *rest)))


def occurrences(docs: DataFrame, bench: DataFrame, n: int = 13, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per document key: n_words, and for each occurrence its start, length and items.

    ``docs`` has key and text. A row without an occurrence stands for each key.
    """
    wins = materialize(_windows(bench, n).withColumn("k", F.least(F.size("win"), F.lit(K))))
    ks = sorted(r.k for r in wins.select("k").distinct().collect()) or [K]  # three values at most
    sh = F.expr("transform(sequence(0, size(win) - k), i -> struct(i as off, case k when 1 then xxhash64(1, win[i]) when 2 then xxhash64(2, win[i], win[i + 1]) else xxhash64(3, win[i], win[i + 1], win[i + 2]) end as sh))")
    tokens = wins.select("win", "items", "k", F.explode(sh).alias("s")).select("win", "items", "k", "s.off", "s.sh")
    vocabulary = materialize(tokens.select("k", "sh").distinct())
    near = bytes_of(wins) <= limit
    hint = F.broadcast if near else lambda x: x
    freq = None
    for k in ks:
        pos = _positions(docs, k).filter("sh is not null").select("sh")
        f = pos.join(hint(vocabulary.filter(F.col("k") == k).select("sh")), "sh").groupBy("sh").agg(F.count("*").alias("freq"))
        freq = f if freq is None else freq.unionByName(f)
    freq = materialize(freq.groupBy("sh").agg(F.sum("freq").alias("freq")))
    rare = tokens.join(freq, "sh", "left").groupBy("win", "items", "k").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "off", "sh")).alias("r"))
    rare = materialize(rare.filter("r.freq > 0").select("win", "items", "k", "r.off", "r.sh", F.size("win").alias("len")))
    out = None
    for k in ks:
        prefix = rare.filter(F.col("k") == k).select("win", "items", "off", "len", F.col("sh"))
        if near:
            got = _positions(docs, k).join(F.broadcast(prefix), "sh", "left")
        else:
            own = _positions(docs, k).select("key", "n_words", "p", "w", "sh")
            got = own.join(prefix, "sh", "left").filter("win is not null or w is null")
            got = got.join(docs.select("key", words_of(F.col("text")).alias("words")).dropDuplicates(["key"]), "key")
        start = F.col("p") - F.col("off")
        exact = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win")
        # the comparison sits behind the bounds, so that it is made for few rows
        hit = F.when(F.col("win").isNotNull() & (start >= 0) & (start + F.col("len") <= F.col("n_words")), exact)
        got = got.filter(hit | F.col("w").isNull()).select("key", "n_words", F.when(F.col("w").isNotNull(), start).alias("start"), F.col("len"), F.when(F.col("w").isNotNull(), F.col("items")).alias("items"))
        out = got if out is None else out.unionByName(got)
    return out


def contamination(docs: DataFrame, bench: DataFrame, n: int = 13, share: int = 20, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per key of ``docs(key, text)``: copies (its rows), n_words, n_hit, n_items, items_sha256,
    contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    occ = occurrences(docs, bench, n, limit)
    per = occ.groupBy("key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("start").isNull()).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end"))))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("to")),
        lambda acc, s: F.struct((acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).cast("long").alias("hit"), F.greatest(acc["to"], s["end"]).alias("to")),
    )["hit"]
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    r = per.select("key", "copies", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"))
    return r.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.col("text").cast("string")).withColumn("key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents; repeated rows are found once and then repeated."""
    docs = _keyed(read(spark, sf_dir, "documents").select("doc_id", "text")).select("key", "text")
    r = contamination(docs, read(spark, sf_dir, "benchmark"))
    r = r.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return r.select(F.col("key.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def keep_clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns, whatever their names."""
    key = F.struct(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    own = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    bad = materialize(contamination(own, bench).filter("contaminated").select("key"))
    mine = fresh(docs, "key")
    bad = bad.withColumnRenamed("key", f"{mine}_bad")
    side = F.broadcast(bad) if bytes_of(bad) <= BROADCAST_BYTES else bad
    return docs.withColumn(mine, key).join(side, F.col(mine).eqNullSafe(F.col(f"{mine}_bad")), "left_anti").select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op2_benchmark_decontamination": f"""
with d as (select doc_id, row_number() over () as row_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
win as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') as g
        from (select item_id, w, least(13, len(w)) as k, unnest(range(1, len(w) - least(13, len(w)) + 2)) as p from i where len(w) > 0) t),
gram as (select row_id, p, k, array_to_string(w[p:p + k - 1], ' ') as g
         from (select row_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from win) s where len(w) >= k) t),
occ as (select row_id, p, k, item_id from gram join win using (k, g)),
hit as (select row_id, count(distinct q) as n from (select row_id, unnest(range(p, p + k)) as q from occ) t group by row_id),
item as (select row_id, count(*) as n, string_agg(x, ',' order by x) as ids from (select distinct row_id, cast(item_id as varchar) as x from occ) t group by row_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(item.n, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
from d left join hit using (row_id) left join item using (row_id)"""
}
