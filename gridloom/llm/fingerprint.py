"""Operator 13: document fingerprints from prefix polynomial hashes.

The prefix array of a sequence c is s[i] = sum over j < i of (c[j] + 1) * B^j modulo the prime
2^61 - 1. The hash of span [i, i + m) is (s[i + m] - s[i]) * B^-i: the same for equal spans wherever
they stand, and for other spans of up to m code points the same with a chance of m / 2^61 over B.
So two spans are compared in constant time, a span made of two others is hashed from theirs, and
the longest common extension of two positions is found by binary search.

A fingerprint is the ``SKETCH`` least distinct 48-bit mixes of the hashes of all spans of ``SPAN`` code
points (the whole text where it is shorter), as hexadecimal digits: equal texts have equal
ones. From the least values of two sketches' union the share of common spans J is read, and their
likeness is 2 J / (1 + J): common spans against the mean number of both; exact for texts of up to
``SKETCH`` spans. Half a text kept gives about 0.5.

Documents stand in order of doc_id, descending, null last, those of one id by the MD5 of their text.
Ranges of that order begin at keys of a sample, of which every one is a document: it is dealt to
its range and, as what comes next, to the range before. So each range is one task's stream of
documents with their next ones; text is shuffled once, and a task holds some ``GROUP`` code points
or a text and its next one, with about 40 bytes a code point.

Cases: null text is empty; an empty text has an empty fingerprint, like another empty one's (1) and
unlike all others (0); rows that repeat a doc_id and text are one document and give one row, left out
before the shuffle where a task has met them; other rows of an id each are a document, dealt by their
MD5 too, so an id of many rows is no one task's; a sole document is its own next; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

P = (1 << 61) - 1
#: Chosen once at random below P, so that hashes of different runs agree.
BASE = 1_604_233_817_355_926_731 % P
_ODD = np.uint64(0x9E3779B97F4A7C15)
SPAN, SKETCH = 16, 128
#: Code points hashed at a time; elements in which arithmetic goes, so that it stays in cache.
GROUP, BLOCK = 1 << 20, 1 << 15
_P, _1, _30, _31, _61 = (np.uint64(x) for x in (P, 1, 30, 31, 61))
_M30, _M31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P for numbers below P: halves of 31 bits, and 2^61 counts as 1."""
    ah, al, bh, bl = a >> _31, a & _M31, b >> _31, b & _M31
    mid = ah * bl
    mid += al * bh
    out = ah * bh << _1
    out += mid >> _30
    out += (mid & _M30) << _31
    out += al * bl
    return _fold(out)


_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """B^i and B^-i for i < n, kept by the process."""
    global _powers
    while _powers.shape[1] < n:
        have = _powers.shape[1]
        step = [pow(BASE, have, P), pow(pow(BASE, P - 2, P), have, P)]
        _powers = np.concatenate([_powers, np.stack([_mul(_powers[i], np.full(have, step[i], np.uint64)) for i in (0, 1)])], 1)
    return _powers


class Prefix:
    """The prefix array of a sequence of code points."""

    def __init__(self, codes: np.ndarray) -> None:
        self.power, self.inverse = powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        total = np.uint64(0)
        for i in range(0, len(codes), BLOCK):
            x = _mul(codes[i : i + BLOCK].astype(np.uint64) + _1, self.power[i : i + len(codes[i : i + BLOCK])])
            low = np.cumsum(x & np.uint64(0xFFFFFFFF))  # below 2^47; the upper halves below 2^44
            high = np.cumsum(x >> np.uint64(32))
            high = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
            self.sums[i + 1 : i + 1 + len(x)] = _fold(high + low + total)
            total = self.sums[i + len(x)]

    @classmethod
    def of(cls, text: str) -> Prefix:
        return cls(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))

    def span(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the spans of ``size`` code points from ``at``."""
        at = np.asarray(at, np.int64)
        return _mul(_fold(self.sums[at + size] + (_P - self.sums[at])), self.inverse[at])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size``, in order."""
        n = max(len(self.sums) - size, 0)
        out = np.empty(n, np.uint64)
        for i in range(0, n, BLOCK):
            j = min(i + BLOCK, n)
            out[i:j] = _mul(_fold(self.sums[i + size : j + size] + (_P - self.sums[i:j])), self.inverse[i:j])
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether the spans of ``size`` from ``a`` and ``b`` are equal."""
        return self.span(a, size) == self.span(b, size)

    def joined(self, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of span (a, m) followed by span (b, n)."""
        return _fold(self.span(a, m) + _mul(self.power[m], self.span(b, n)))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extensions: how many code points from ``a`` and from ``b`` agree, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), np.asarray(most, np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _mix(h: np.ndarray) -> np.ndarray:
    return h * _ODD >> np.uint64(16)


def _least(parts: list[np.ndarray], sketch: int) -> np.ndarray:
    """The least distinct values of all parts. Values beyond a bound that some three times as many
    are expected to meet are only looked at where too few are below it."""
    n = sum(len(p) for p in parts)
    if n > 8 * sketch:
        bound = np.uint64(min((3 * sketch << 48) // n, (1 << 48) - 1))
        out = np.unique(np.concatenate([p[p <= bound] for p in parts]))
        if len(out) >= sketch:
            return out[:sketch]
    return np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))[:sketch]


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def likeness(a: np.ndarray | str, b: np.ndarray | str, sketch: int = SKETCH) -> float:
    """Likeness of two fingerprints, from 0 to 1."""
    a, b = (np.array([int(x[i : i + 12], 16) for i in range(0, len(x), 12)], np.uint64) if isinstance(x, str) else x for x in (a, b))
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.concatenate([a, b])
    union.sort()
    twice = union[:-1][union[1:] == union[:-1]]
    least = np.unique(union)[:sketch]
    share = np.searchsorted(twice, least[-1], "right") / len(least)
    return float(2 * share / (1 + share))


def compare(texts: list[str], span: int = SPAN, sketch: int = SKETCH) -> Iterator[tuple]:
    """For each text but the last, with the next one: n_chars, edited text, both fingerprints, their
    likeness, that with the next text's, and the code points that it shares from the start on with both."""
    size = np.array([len(t) for t in texts])
    at = np.concatenate([[0], np.cumsum(size)])
    h = Prefix.of("".join(texts))
    mixed = _mix(h.windows(span))
    n, m = size[:-1], size[1:]
    tail = np.minimum(n // 2, m)
    kept = n - n // 2
    start, then = at[:-2], at[1:-1]
    prefix = kept + h.extension(start + kept, then, np.minimum(n // 2, tail))
    shared = h.extension(start, then, np.minimum(n, m))
    # Spans across the joint: the last 1 to span - 1 code points of what is kept, and then the tail's.
    left = np.arange(1, span)
    row, part = np.nonzero((left <= kept[:, None]) & (span - left <= tail[:, None]))
    across = _mix(h.joined(start[row] + kept[row] - left[part], left[part], then[row], span - left[part]))
    edge = np.searchsorted(row, np.arange(len(n) + 1))
    short = _mix(h.span(at[:-1], size))
    short_edited = _mix(h.joined(start, kept, then, tail))

    def sketch_of(i: int) -> np.ndarray:
        if size[i] < span:
            return short[i : i + 1] if size[i] else short[:0]
        return _least([mixed[at[i] : at[i + 1] - span + 1]], sketch)

    prints = [sketch_of(i) for i in range(len(texts))]
    for i in range(len(n)):
        if kept[i] + tail[i] < span:
            edited = short_edited[i : i + 1] if kept[i] + tail[i] else short[:0]
        else:
            a, b = start[i], then[i]
            parts = [mixed[a : max(a, a + kept[i] - span + 1)], across[edge[i] : edge[i + 1]], mixed[b : max(b, b + tail[i] - span + 1)]]
            edited = _least(parts, sketch)
        text = texts[i][: kept[i]] + texts[i + 1][: tail[i]]
        yield int(n[i]), text, _hex(prints[i]), _hex(edited), likeness(prints[i], edited, sketch), likeness(prints[i], prints[i + 1], sketch), int(prefix[i]), int(shared[i])


def _key(doc_id: int | None, md5: bytes) -> tuple:
    return (doc_id is None, ~(doc_id or 0), md5)


def _deal(bounds: list[tuple], first: tuple):
    """Rows with their range, and once more as what comes next for the range before: those whose key
    begins a range, and the first of all for the last."""
    ahead_of = {b: i for i, b in enumerate(bounds)}
    ahead_of[first] = len(bounds)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for b in it:
            at, where, ahead = [], [], []
            for i, (doc_id, md5) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                key = _key(doc_id, md5)
                if key in met:
                    continue
                met.add(key)
                at.append(i)
                where.append(bisect_right(bounds, key))
                ahead.append(False)
                if key in ahead_of:
                    at.append(i)
                    where.append(ahead_of[key])
                    ahead.append(True)
            if len(met) > 100_000:  # what is met again after that goes in the stream of its range
                met.clear()
            out = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(where, pa.int32()), pa.array(ahead, pa.bool_())], [*b.schema.names, "range", "ahead"])

    return run


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long"
_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "prefix_edited", "prefix_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def _stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of a range's documents as they come, a group at a time; the last of a group, or
    the row that comes next, is the first of the following."""

    def rows() -> Iterator[tuple]:
        last = None
        for b in it:
            for doc_id, md5, text, where, ahead in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (now := (where, ahead, doc_id, md5)) != last:  # repeated rows stand together
                    yield where, ahead, doc_id, text
                last = now

    def done(group: list[tuple]) -> pa.RecordBatch:
        out = []
        for (_, _, doc_id, _), (n, text, *rest) in zip(group, compare([g[3] for g in group]), strict=False):
            out.append((doc_id, n, hashlib.sha256(text.encode()).hexdigest(), *rest))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _FIELDS)

    group: list[tuple] = []
    held, over = 0, -1
    for r in rows():
        if r[0] == over:  # a further row ahead of a range that is done
            continue
        group.append(r)
        held += len(r[3])
        if len(group) > 1 and (r[1] or held >= GROUP or len(group) > 4096):
            yield done(group)
            over = r[0] if r[1] else over
            group = [] if r[1] else [r]
            held = sum(len(g[3]) for g in group)


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row per document of ``docs(doc_id, text)``, with its edited text's figures (see ``OUT``).

    ``partitions`` ranges (as many as the session's shuffle partitions, if not given) are found by a
    sample of some 16 keys each, weighed by the texts' lengths."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw, fields = docs, [F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("md5"), text.alias("text")]
    docs = raw.select(fields)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).head()
    top = docs.filter(F.col("doc_id").eqNullSafe(F.lit(seen.top).cast("long"))).agg(F.min("md5").alias("md5")).head()
    share = min(1.0, 16 * partitions / max(seen.n, 1))
    sample = (raw.sample(share, seed=7) if share < 1 else raw).select(fields).select("doc_id", "md5", (F.length("text") + 200).alias("n"))
    keys = sorted((_key(r.doc_id, bytes(r.md5)), r.n) for r in sample.collect())
    total, run, bounds = sum(n for _, n in keys), 0, []
    for key, n in keys:
        if run * partitions >= (len(bounds) + 1) * total and key not in bounds[-1:]:
            bounds.append(key)
        run += n
    first = _key(seen.top, bytes(top.md5)) if seen.n else _key(None, b"")
    dealt = docs.mapInArrow(_deal(bounds, first), "doc_id long, md5 binary, text string, range int, ahead boolean")
    order = ["range", "ahead", F.col("doc_id").isNull(), F.desc("doc_id"), "md5"]
    return dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions(*order).mapInArrow(_stream, OUT)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
