"""Operator 3: WARC archives with an external index merge.

Pages become WARC 1.1 records, gzip members of their own. Of records with equal payloads of
at least ``least`` bytes, the one with the largest page_id is a response and the others are
revisits that refer to it; the pairs (payload digest, page_id) are found by an aggregate
with partial maxima, and only digests with more than one page go back to the pages, by a
broadcast within a checked size and else a shuffle join, salted by page_id.

Each task writes blocks of records: an archive is the concatenation of its blocks, held as
rows (archive, block, data) of Parquet files in the shared folder, since executors have no
other shared writer; ``export`` streams them to plain .warc.gz files. With each block goes a
capture run, its index entries sorted by (URL key, timestamp, page_id). A sample of entries
splits the key space into ranges; a run is cut at the splitters, and each range's task merges
its k run segments with a loser tree. Ranges in order make one globally ordered index. The
splitters are whole (key, timestamp, page_id) triples, so a URL with a third of all captures
is cut like any other. Records are read through that index, by its offsets: a page whose entry
were lost would be missing from the result.

Cases: a null html is empty, and empty payloads equal each other; a row with a null page_id
is a response and is never referred to; of repeated rows of the winning page_id all are
responses; a null url has the key "-"; an empty table gives no rows; extra columns are
ignored. Without a timestamp column the capture time is page_id seconds after 1970.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_BYTES, bytes_of, drop, materialize, read, small_side

#: Bytes of payload in a block, about.
BLOCK = 4 << 20
ENTRY = "struct<urlkey:string,ts:string,page_id:bigint,kind:string,digest:string,payload_bytes:bigint,archive:int,block:int,offset:bigint,length:bigint>"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased: com,example)/path?q."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    host = host.removeprefix("www.")
    port = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){u.path.lower() or '/'}" + (f"?{'&'.join(sorted(u.query.lower().split('&')))}" if u.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stamp(page_id: int | None) -> str:
    try:
        return (_EPOCH + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, ts: str) -> bytes:
    """One record as a gzip member. A url that a header line can't hold as it is stands there with
    percent signs for spaces and control characters, and again whole in Base64."""
    plain = url is not None and url.isprintable() and url.strip() == url and url not in ("", "-")
    uri = url if plain else "-" if not url else "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {ts}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if not plain:
        head.append("X-Source-URL: " + ("null" if url is None else "=" + base64.b64encode(url.encode()).decode()))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if refers_to is None else b""
    raw = "\r\n".join([*head, "Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(data: bytes, at: int = 0, size: int | None = None) -> tuple[dict[str, str], bytes, int]:
    """Fields, body and length of the record at ``at``; ValueError if it is damaged or, with a
    ``size``, doesn't fill just that many bytes."""
    z = zlib.decompressobj(31)
    view = memoryview(data)[at : None if size is None else at + size]
    raw = z.decompress(view)
    if not z.eof or (size is not None and z.unused_data):
        raise ValueError("a record is cut off or of another length")
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n], len(view) - len(z.unused_data)


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        html = b.column("html").cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([hashlib.sha1(x or b"").digest() for x in html], pa.binary()), pa.array([len(x or b"") for x in html], pa.int64())], ["page_id", "sha", "size"])


def _write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, no = TaskContext.get().partitionId(), 0
    for big in it:
        for b in W.pieces(big, "html", BLOCK):
            out, run, at = io.BytesIO(), [], 0
            rows = zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist(), b.column("refers_to").to_pylist(), b.column("ts").to_pylist(), strict=True)
            for page, url, html, refers, ts in rows:
                payload = (html or "").encode()
                digest, ts = digest_of(payload), ts or stamp(page)
                raw = record(page, url, payload, digest, refers, ts)
                out.write(raw)
                run.append({"urlkey": url_key(url), "ts": ts, "page_id": page, "kind": "response" if refers is None else "revisit", "digest": digest, "payload_bytes": len(payload), "archive": part, "block": no, "offset": at, "length": len(raw)})
                at += len(raw)
            run.sort(key=entry_key)
            yield pa.RecordBatch.from_pylist([{"archive": part, "block": no, "data": out.getvalue(), "run": run}], _BLOCK_SCHEMA)
            no += 1


_ENTRY_TYPE = pa.struct([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("archive", pa.int32()), ("block", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_BLOCK_SCHEMA = pa.schema([("archive", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("run", pa.list_(_ENTRY_TYPE))])


def entry_key(e: dict) -> tuple:
    return e["urlkey"], e["ts"], -(2**63) if e["page_id"] is None else e["page_id"], e["archive"], e["block"], e["offset"]


def write_archives(pages: DataFrame, least: int = 0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Blocks (archive, block, data, run) of all pages(page_id, url, html[, ts]), written."""
    ts = F.col("ts").cast("string") if "ts" in pages.columns else F.lit(None).cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), ts.alias("ts"))
    d = p.select("page_id", "html").mapInArrow(_digests, "page_id long, sha binary, size long").filter(F.col("size") >= least)
    d = materialize(d.filter("page_id is not null"))
    same = d.groupBy("sha", "size").agg(F.max("page_id").alias("to"), F.min("page_id").alias("low")).filter("low < to")
    same = materialize(same.select("sha", "size", "to"))
    # (page_id, sha) of revisits only; equal page_ids with other payloads stay apart by the digest
    again = d.join(F.broadcast(same) if bytes_of(same) <= limit else same, ["sha", "size"]).filter(F.col("page_id") < F.col("to"))
    again = materialize(again.groupBy("page_id", "sha").agg(F.max("to").alias("refers_to")))
    side = F.broadcast(again) if bytes_of(again) <= limit else again
    p = p.withColumn("sha", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))).join(side, ["page_id", "sha"], "left")
    out = materialize(p.select("page_id", "url", "html", "refers_to", "ts").mapInArrow(_write, f"archive int, block int, data binary, run array<{ENTRY}>"), "uncompressed")
    drop(d)
    return out


def read_archives(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Per entry of ``index`` (as ``merge_index`` gives it) the record at its place: page_id,
    payload_bytes, payload_digest, record_type, refers_to, url, ts, payload (null for revisits),
    range, seq. A record that isn't what the entry says is an error.

    Entries gather by block, whose records they are, so a task holds a block at a time."""
    at = F.struct("offset", "length", "page_id", "digest", "kind", "range", "seq")
    entries = materialize(index.groupBy("archive", "block").agg(F.sort_array(F.collect_list(at)).alias("entries")))
    both = blocks.select("archive", "block", "data").join(small_side(entries), ["archive", "block"])
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "ts", "payload", "range", "seq"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int64()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for raw, wanted in zip(b.column("data"), b.column("entries"), strict=True):
                data, rows = raw.as_py(), []
                for e in wanted.as_py():
                    f, body, _ = parse(data, e["offset"], e["length"])
                    digest, kind = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"]
                    ids = [None if (x := f.get(k, "null").removeprefix("<urn:page:").removesuffix(">")) == "null" else int(x) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    if (ids[0], digest, kind) != (e["page_id"], e["digest"], e["kind"]):
                        raise ValueError("a record isn't the one of its index entry")
                    if kind == "response" and digest_of(body) != digest:
                        raise ValueError("a payload doesn't match its digest")
                    source = f.get("X-Source-URL")
                    url = f["WARC-Target-URI"] if source is None else None if source == "null" else base64.b64decode(source[1:]).decode()
                    rows.append((ids[0], len(body) if kind == "response" else int(f["X-Payload-Length"]), digest, kind, ids[1], url, f["WARC-Date"], body if kind == "response" else None, e["range"], e["seq"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return both.select("data", "entries").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, ts string, payload binary, range int, seq long")


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, so the next
    entry costs one match on each level of the way to the root."""

    def __init__(self, runs: list[list[dict]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.head = [self._key(i) for i in range(self.k)]
        self.loser = [-1] * max(1, self.k)
        self.win = self._play(1) if self.k > 1 else 0

    def _key(self, i: int):
        return (0, *entry_key(self.runs[i][self.at[i]])) if self.at[i] < len(self.runs[i]) else (1,)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        w, self.loser[node] = (a, b) if self.head[a] <= self.head[b] else (b, a)
        return w

    def __iter__(self) -> Iterator[dict]:
        while self.k and self.head[self.win][0] == 0:
            w = self.win
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.head[w] = self._key(w)
            node = (w + self.k) // 2
            while node:
                if self.head[self.loser[node]] < self.head[w]:
                    w, self.loser[node] = self.loser[node], w
                node //= 2
            self.win = w


def merge_index(blocks: DataFrame, per_range: int = 50_000, sample: int = 20) -> DataFrame:
    """The globally ordered capture index: range, seq (order within it), and entries' columns.

    A range has about ``per_range`` entries; ``sample`` entries a range are drawn for the splitters,
    which the driver sorts (at 10^9 records 400,000 of some 100 bytes)."""
    runs = blocks.select("run")
    n = runs.agg(F.sum(F.size("run"))).head()[0] or 0
    ranges = max(1, -(-n // per_range))
    cuts: list[tuple] = []
    if ranges > 1:
        e = runs.select(F.explode("run").alias("e")).select("e.urlkey", "e.ts", F.coalesce("e.page_id", F.lit(-(2**63))).alias("page_id"))
        got = sorted((r.urlkey, r.ts, r.page_id) for r in e.sample(min(1.0, sample * ranges / n), seed=7).collect())
        cuts = [got[i * len(got) // ranges] for i in range(1, ranges)] if got else []

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for b in it:
            for run in b.column("run"):
                x = run.as_py()
                where = [bisect_right(cuts, entry_key(e)[:3]) for e in x]
                edge = [0, *(i for i in range(1, len(x)) if where[i] != where[i - 1]), len(x)]
                rows = [{"range": where[a], "segment": x[a:z]} for a, z in zip(edge[:-1], edge[1:], strict=True) if z > a]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("range", pa.int32()), ("segment", pa.list_(_ENTRY_TYPE))]))

    def merge(table: pa.Table) -> pa.Table:
        tree = LoserTree(table.column("segment").to_pylist())
        r = table.column("range")[0].as_py()
        return pa.Table.from_pylist([{"range": r, "seq": i, **e} for i, e in enumerate(tree)], pa.schema([("range", pa.int32()), ("seq", pa.int64()), *_ENTRY_TYPE]))

    fields = ENTRY.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    parts = runs.mapInArrow(cut, f"range int, segment array<{ENTRY}>")
    return parts.groupBy("range").applyInArrow(merge, f"range int, seq long, {fields}")


def export(blocks: DataFrame, folder: str) -> list[str]:
    """Write archives as .warc.gz files to a folder of the driver, a block at a time."""
    names: list[str] = []
    for r in blocks.select("archive", "block", "data").orderBy("archive", "block").toLocalIterator():
        name = f"{folder}/part-{r.archive:05d}.warc.gz"
        with open(name, "wb" if r.block == 0 else "ab") as f:
            f.write(r.data)
        if r.block == 0:
            names.append(name)
    return names


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written, indexed, and read back through the merged index."""
    blocks = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    back = read_archives(blocks, merge_index(blocks))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "instr('0123456789abcdef', substr(hex, 5 * g + {}, 1)) - 1"
_V = " + ".join(f"({_DIGIT.format(j)}) * {16 ** (5 - j)}" for j in range(1, 6))
ORACLE_SQL = {
    "op3_warc": f"""
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, strlen(body) as n, sha1(body) as hex from p),
d as (select page_id, n, hex, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((({_V}) >> s) & 31 as int) + 1, 1)), '')), '') as digest from h),
m as (select *, max(page_id) over (partition by hex, n) as top from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when page_id is null or page_id = top then 'response' else 'revisit' end as record_type, case when page_id < top then top end as refers_to from m"""
}
