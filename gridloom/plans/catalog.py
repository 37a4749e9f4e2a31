"""Names, manifests, snapshots, queues and fixed-width codecs over the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.order import numbered
from ..operators.unique import unique_names as uniquely

TABLES = ("pages", "documents", "conversations", "benchmark", "events", "labels", "embeddings")

#: name -> (Spark SQL, SQL of the other engine).
SQL: dict[str, tuple[str, str]] = {}


def _both(name: str, body: str, **change: str) -> None:
    """Register a query whose dialects differ only by the replacements given."""
    other = body
    for a, b in ((r"regexp_replace_all", "regexp_replace"),):
        body = body.replace(a, b)
    other = other.replace("regexp_replace_all(", "regexp_replace_g(")
    import re

    other = re.sub(r"regexp_replace_g\(((?:[^()]|\([^()]*\))*), '([^']*)', '([^']*)'\)", r"regexp_replace(\1, '\2', '\3', 'g')", other)
    for a, b in change.items():
        other = other.replace(a, b)
    SQL[name] = (body, other)


_SHORT = """select page_id, url, case when s = '' then 'IMG' when substr(s, 1, 1) between '0' and '9' then substr('I' || s, 1, 8) else substr(s, 1, 8) end as short
   from (select page_id, url, regexp_replace_all(upper(url), '[^A-Z0-9_]', '') as s from pages) t"""
_both("short_names", _SHORT)
_both("name_collisions", f"select short, count(*) as n, min(page_id) as first_page from ({_SHORT}) q group by short having count(*) > 1")
_both("name_problems", """select page_id, case when s is null or s = '' then 'empty' when length(s) > 8 then 'too long' when substr(s, 1, 1) between '0' and '9' then 'starts with a digit'
   when s <> regexp_replace_all(s, '[^A-Z0-9_]', '') then 'bad character' else 'ok' end as problem from (select page_id, upper(substr(url, cast(9 + page_id % 3 as int), cast(5 + page_id % 7 as int))) as s from pages) t""")  # fmt: skip
_both("dedup_content", "select doc_id, digest, rk = 1 as kept from (select doc_id, md5(text) as digest, row_number() over (partition by md5(text) order by source, doc_id) as rk from documents) t")
_both("manifest_join", """select p.page_id, p.key8, coalesce(m.description, p.key8) as description from (select page_id, substr(upper(url), 8, 8) as key8 from pages) p
   left join (select key8, description from (select key8, description, row_number() over (partition by key8 order by page_id desc) as rk from
     (select page_id, substr(upper(url), 8, 8) as key8, substr(html, 1, 75) as description from pages where html like '%nav%') a) b where rk = 1) m on p.key8 = m.key8""")  # fmt: skip
_both("description_fallback", """select d.doc_id, coalesce(nullif(trim(case when d.doc_id % 3 = 0 then '' else d.source end), ''), nullif(trim(b.text), ''), cast(d.doc_id as varchar(20))) as description
   from documents d left join benchmark b on b.item_id = d.doc_id""")  # fmt: skip
_both("clean_descriptions", r"select doc_id, trim(substr(regexp_replace_all(text, '[ \n\t]+', ' '), 1, 75)) as description, length(trim(regexp_replace_all(text, '[ \n\t]+', ' '))) <= 75 as fits from documents")
_both("settings_budget", """select event_id, slots - 1 as usable, palettes * (slots - 1) as budget, least(1.0e0, greatest(0.0e0, case when event_id % 5 = 0 then 1.0e0 else value / 100.0e0 end)) as effective_bias
   from (select event_id, value, cast(2 + event_id % 255 as int) as slots, cast(1 + event_id % 4 as int) as palettes from events) t""")  # fmt: skip
_both("tones", """select event_id, case when value >= 130 then 'error' when value >= 110 then 'warn' else 'ok' end as seam_tone, case when value > 5 then 'error' when value > 1 then 'warn' else 'ok' end as recolour_tone from events""")
_both("inert_dither", "select event_id, event_type <> 'click' and value < 50 as inert from events")
_both("queue_collisions", "select user_id, event_type, count(*) as n, min(event_id) as first_job, max(event_id) as last_job from events group by user_id, event_type having count(*) > 1")
_both("queue_states", "select event_type as state, count(*) as jobs, count(distinct user_id) as users from events group by event_type")
_both("snapshot_numbers", """select user_id, coalesce(max(n), 0) + 1 as next_number, count(distinct n) as shots from (select user_id, cast(event_id % 37 as int) as n from events) t group by user_id""")
_both("snapshot_order", "select user_id, event_id, cast(row_number() over (partition by user_id order by event_id % 37, event_id) as int) as position from events")
_both("newest_file", "select user_id, max(event_id) as event_id from (select user_id, event_id, ts, max(ts) over (partition by user_id) as newest from events) t where ts = newest group by user_id")
_both("source_lookup", """select d.doc_id, coalesce(a.page_id, b.page_id) as page_id, case when a.page_id is not null then 'recorded' when b.page_id is not null then 'index' else 'none' end as how
   from documents d left join pages a on a.page_id = d.doc_id and d.lang = 'en' left join (select page_id % 97 as k, min(page_id) as page_id from pages group by page_id % 97) b on b.k = d.doc_id % 97""")  # fmt: skip
_both("recovery_priority", """select doc_id, case when q = 3 then 'exact' when q = 2 then 'preview' when q = 1 then 'verified' else 'guess' end as confidence from
   (select d.doc_id, max(case when l.toxic = 1 then 3 when l.quality = 1 then 2 when l.doc_id is not null then 1 else 0 end) as q from documents d left join labels l on l.doc_id = d.doc_id group by d.doc_id) t""")  # fmt: skip
_both("orphans", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
_both("preview_match", """select doc_id, text_hash, latest from (select doc_id, md5(text) as text_hash, max(doc_id) over (partition by md5(text), length(text)) as latest, count(*) over (partition by md5(text), length(text)) as k from documents) t where k > 1""")
_both("classify_errors", """select page_id, case when html like '%script%' and html like '%track%' then 'input' when html like '%nav%' then 'memory' else 'error' end as kind from pages""")
_both("listing_order", "select page_id, cast(row_number() over (order by case when page_id % 7 = 0 then 0 else 1 end, substr(url, 8, 8), page_id) as int) as position from pages")
_both("manifest_records", "select page_id, rpad(substr(upper(url), 8, 8), 8, ' ') || substr(html, 1, 75) as record from pages")
# every job is pointed at the image that its user names; name and results are cleared
_both("retarget_queue", "select e.event_id, e.event_type as label, b.item_id as image, cast(null as varchar(20)) as name, cast(null as int) as colours from events e join benchmark b on b.item_id = e.user_id")
_both("description_export", """select page_id, case when length(url) >= w then url else rpad(url, cast(w as int), ' ') end || ' = ' || substr(regexp_replace_all(coalesce(html, ''), '[^ -~]', ' '), 1, 75) as line
   from (select page_id, url, html, (select least(24, max(length(url))) from pages) as w from pages) t""")  # fmt: skip
# a queue file has labels and settings, not results; a preset has its name and no input, out, name or description
_JOB = "select event_id, event_type, user_id, cast(2 + event_id % 255 as int) as slots, cast(1 + event_id % 4 as int) as palettes from events"
SQL["queue_records"] = (
    f"select event_id, to_json(named_struct('label', event_type, 'settings', named_struct('input', cast(user_id as string), 'palettes', palettes, 'slots', slots)), map('ignoreNullFields', 'false')) as job from ({_JOB}) t",
    f"select event_id, cast(to_json({{'label': event_type, 'settings': {{'input': cast(user_id as varchar), 'palettes': palettes, 'slots': slots}}}}) as varchar) as job from ({_JOB}) t",
)
SQL["preset_records"] = (
    f"select event_type as name, to_json(named_struct('_name', event_type, 'palettes', max(palettes), 'slots', max(slots)), map('ignoreNullFields', 'false')) as preset from ({_JOB}) t group by event_type",
    f"select event_type as name, cast(to_json({{'_name': event_type, 'palettes': max(palettes), 'slots': max(slots)}}) as varchar) as preset from ({_JOB}) t group by event_type",
)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    body = SQL[name][0]
    used = {t for t in TABLES if re.search(rf"\b(from|join)\s+{t}\b", body)}
    for t in used:
        body = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", body)
    return spark.sql(body, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in a listing: folders (here every 7th page) first, then by the first eight characters of the name."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    by = [(F.col("page_id") % 7 != 0).cast("int"), F.substring("url", 8, 8), F.col("page_id")]
    keyed = p.select("page_id", *[c.alias(f"k{i}") for i, c in enumerate(by[:2])])
    return numbered(keyed, ["k0", "k1", "page_id"]).select("page_id", F.col("position").cast("int").alias("position"))


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names in page order, each made unique within its directory (here the host)."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("folder"), N.short_name(F.regexp_extract("url", "([^/]*)$", 1)).alias("short"))
    return uniquely(p, ["folder"], "short", ["page_id"]).select("page_id", "folder", "unique_name")


def nfo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped text as fixed-width records and back: lines, bytes and whether they agree.

    Text of more than 127 lines is rejected whole: its lines are counted, and there are no bytes."""
    d = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")

    def kernel(it):
        for pdf in it:
            rows = []
            for i, t in zip(pdf.item_id, pdf.text, strict=True):
                lines = N.wrap((t or "").encode("latin-1", "replace").decode("latin-1"))
                rejected = len(lines) > N.NFO_LINES
                raw = b"" if rejected else N.nfo_encode(lines)
                rows.append((i, len(lines), len(raw), not rejected and N.nfo_decode(raw) == lines, rejected))
            yield pd.DataFrame(rows, columns=["item_id", "n_lines", "n_bytes", "same", "rejected"])

    return d.mapInPandas(kernel, "item_id long, n_lines int, n_bytes int, same boolean, rejected boolean")


QUERIES = {"listing_order": listing_order, "unique_names": unique_names, "nfo_roundtrip": nfo_roundtrip}
