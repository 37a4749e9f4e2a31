"""Operator 12: compression of vectors to codes by Yinyang Lloyd iterations.

Vectors of integers are cut into equal parts; each part has a codebook, and a vector's code names the
nearest entry of each. The codebooks' entries are clustered into groups of about ``GROUP``. For each
part of a vector its task keeps the entry, an upper bound of its distance, and for each group one
lower bound of the distance to all other entries there. After an update these bounds move by the
entries' drifts (the group's by the largest of its drifts): a part whose upper bound is below all lower
bounds keeps its entry, and otherwise only groups whose bound doesn't exceed the tightened distance are
scanned. Bounds are rounded outwards, and a group is skipped only when strictly farther, so ties are
always met; scanned distances are exact integers, and the least index wins.

Vectors stay where they are: a round reads the state (components, codes, bounds) from its table and writes
the next one, so a lost executor repeats its tasks of one round. Only the entries' sums and counts, added
up by Spark, and the codebooks pass through the driver: their size depends on no row count.

Cases: vectors null, empty, or with a component that is null or not finite (scaled in doubles) are left
out; rows of the length of the least id's vector that can be cut take part, rows of other lengths
come back with null code, error and label_error; repeated rows each give a row and count as often; of
rows that repeat one of the first ids, the least vector is the entry; a null vec_id is none of the first
ids; null labels count as one label; components too large for exact doubles are computed without bound,
by scanning all entries; an error beyond 64 bits is the largest number of 64 bits; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialize, read, small_side
from .vectors import BIG, MOST, matrix, scaled, whole

#: Entries of a group, about.
GROUP = 8
#: Rows up to which the first ids are looked for in one place.
FEW = 4096


def groups_of(book: np.ndarray) -> np.ndarray:
    """The group of each entry: Lloyd's iterations on the entries, from every ``GROUP``-th."""
    x = np.clip(book.astype(float), -1e100, 1e100)
    c = x[::GROUP].copy()
    for _ in range(5):
        at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.stack([x[at == g].mean(0) if (at == g).any() else c[g] for g in range(len(c))])
    return at


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all entries; both hold doubles that keep
    them exact, or both integers without bound."""
    if x.dtype == object:
        return ((x[:, None] - book) ** 2).sum(2)
    return (x**2).sum(1)[:, None] - 2 * (x @ book.T) + (book**2).sum(1)


def outward(x: np.ndarray, way: float) -> np.ndarray:
    """As 32-bit floats, not nearer than ``x`` in the direction ``way``."""
    return np.nextafter((x * (1 + np.sign(way) * 1e-12)).astype(np.float32), np.float32(way))


class Round:
    """One assignment by the codebooks ``books`` (part, entry, component) of integers, after the
    entries moved from ``before``; without it, all entries are scanned."""

    def __init__(self, books: np.ndarray, group: np.ndarray, before: np.ndarray | None = None) -> None:
        self.books, self.group, self.met = books, group, 0
        self.n_groups = int(group.max()) + 1
        self.before = before
        self.top = max(abs(int(v)) for v in books.ravel())
        if before is not None:
            moved = np.array([[float(sum(int(v) ** 2 for v in e)) ** 0.5 for e in p] for p in books - before]) if self.top < 1e100 else None
            self.drift = moved * (1 + 1e-9) if moved is not None else np.full(group.shape, np.inf)
            self.most = np.stack([[self.drift[p][group[p] == g].max(initial=0) for g in range(self.n_groups)] for p in range(len(books))])

    def assign(self, x: np.ndarray, state: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, upper bounds, lower bounds, and exact squared distances summed over parts."""
        parts, width = len(self.books), self.books.shape[2]
        code = np.zeros((len(x), parts), np.uint8)
        up, low = np.zeros((len(x), parts), np.float32), np.zeros((len(x), parts, self.n_groups), np.float32)
        error = np.zeros(len(x), object)
        exact = max(float(np.abs(x).max(initial=0)), float(self.top)) < (BIG / (4 * width)) ** 0.5
        for p in range(parts):
            y = x[:, p * width : p * width + width]
            y, book = (y, self.books[p].astype(float)) if exact else (whole(y), self.books[p])
            if state is None or not exact or self.before is None:
                code[:, p], up[:, p], low[:, p], d = self._all(y, book, p, exact)
            else:
                code[:, p], up[:, p], low[:, p], d = self._some(y, book, p, *(s[:, p] for s in state))
            error += d.astype(np.int64).astype(object) if exact else d
        return code, up, low, error

    def _all(self, y, book, p, exact):
        d = distances(y, book)
        self.met += d.size
        at = d.argmin(1).astype(np.int64)
        best = d[np.arange(len(y)), at]
        if not exact:  # nothing is known next time
            return at, np.inf, 0, best
        other = d.copy()
        other[np.arange(len(y)), at] = np.inf
        low = np.stack([np.sqrt(other[:, self.group[p] == g].min(1, initial=np.inf)) for g in range(self.n_groups)], 1)
        return at, outward(np.sqrt(best), np.inf), outward(low, -np.inf), best

    def _some(self, y, book, p, at, up, low):
        at, rows = at.astype(np.int64), np.arange(len(y))
        low = np.maximum(low.astype(float) - self.most[p], 0) * (1 - 1e-12)
        hot = np.flatnonzero(low.min(1) <= (up.astype(float) + self.drift[p][at]) * (1 + 1e-12))
        best = ((y - book[at]) ** 2).sum(1)
        root, old, held = np.sqrt(best), at.copy(), best.copy()
        seconds: list = []
        for g in range(self.n_groups):
            members = np.flatnonzero(self.group[p] == g)
            r = hot[low[hot, g] <= root[hot] * (1 + 1e-12)]
            if not len(r) or not len(members):
                continue
            d = distances(y[r], book[members])
            self.met += d.size
            first = d.argmin(1)
            least, entry = d[np.arange(len(r)), first], members[first]
            d[np.arange(len(r)), first] = np.inf
            seconds.append((g, r, entry, least, d.min(1)))
            closer = (least < best[r]) | ((least == best[r]) & (entry < at[r]))
            best[r[closer]], at[r[closer]] = least[closer], entry[closer]
        for g, r, entry, least, second in seconds:
            low[r, g] = np.sqrt(np.where(entry == at[r], second, least))
        left = rows[old != at]  # the entry left behind is one of the others of its group now
        g = self.group[p][old[left]]
        low[left, g] = np.minimum(low[left, g], np.sqrt(held[left]))
        return at, outward(np.sqrt(best), np.inf), outward(low, -np.inf), best


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _array(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _step(shared, final: bool):
    """A round over rows of components and, after the first, of state."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Round = shared.value
        parts, width = len(r.books), r.books.shape[2]
        for b in it:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"), parts * width)
            state = None
            if "low" in b.schema.names:
                state = _array(b.column("code"), np.uint8, parts), _array(b.column("up"), np.float32, parts), _array(b.column("low"), np.float32, parts, r.n_groups)
            with np.errstate(all="ignore"):
                code, up, low, error = r.assign(x, state)
            keep = [b.column("vec_id"), b.column("label")]
            if final:
                text = pa.array([c.tobytes().hex() for c in code], pa.string())
                yield pa.RecordBatch.from_arrays([*keep, text, pa.array([min(int(e), MOST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*keep, b.column("v"), _bytes(code), _bytes(up), _bytes(low)], ["vec_id", "label", "v", "code", "up", "low"])

    return run


#: Sums go in limbs of so many bits, so that Spark adds them up exactly however large they are.
LIMB = 32


def _sums(parts: int, width: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = defaultdict(int)
        for b in it:
            if not b.num_rows:
                continue
            x, code = matrix(b.column("v"), parts * width), _array(b.column("code"), np.uint8, parts)
            fits = float(np.abs(x).max()) * len(x) < BIG
            for p in range(parts):
                for e, n in enumerate(np.bincount(code[:, p])):
                    if n:
                        total[p, e, -1] += int(n)
                for j in range(width):
                    col = x[:, p * width + j]
                    if fits:
                        for e, s in enumerate(np.bincount(code[:, p], col)):
                            total[p, e, j] += int(s)
                    else:
                        for e, v in zip(code[:, p].tolist(), col.tolist(), strict=True):
                            total[p, e, j] += int(v)
        out = []
        for key, s in total.items():
            sign, s, limb = (-1 if s < 0 else 1), abs(s), 0
            while s:
                out.append((*key, limb, sign * (s & ((1 << LIMB) - 1))))
                s, limb = s >> LIMB, limb + 1
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "at", "limb", "s"), r, strict=True)) for r in out], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("s", pa.int64())]))

    return run


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries as floors of the means of their parts; unused ones stay."""
    parts, n, width = books.shape
    rows = state.select("v", "code").mapInArrow(_sums(parts, width), "part int, entry int, at int, limb int, s long")
    total: dict = defaultdict(int)
    for r in rows.groupBy("part", "entry", "at", "limb").agg(F.sum("s").alias("s")).collect():  # as many as the codebooks have numbers
        total[r.part, r.entry, r["at"]] += r.s << (LIMB * r.limb)
    out = books.copy()
    for p in range(parts):
        for e in range(n):
            if count := total[p, e, -1]:
                out[p, e] = [total[p, e, j] // count for j in range(width)]
    return out


def smallest(ids: DataFrame, k: int) -> int | None:
    """A number up to which at least ``k`` (all, if fewer) and not many more of the distinct ``vec_id``
    are, by counts over ever narrower ranges."""
    ends = ids.agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi")).head()
    lo, hi, need = ends.lo, ends.hi, k
    while hi is not None:
        shift = max(0, (hi - lo).bit_length() - 10)
        counts = ids.filter(F.col("vec_id").between(lo, hi)).groupBy(F.shiftright("vec_id", shift).alias("r")).count().collect()  # 1025 at most
        for r, n in sorted((c.r, c["count"]) for c in counts):
            need -= n
            if need <= 0:
                lo, hi, need = max(lo, r << shift), min(hi, ((r + 1) << shift) - 1), need + n
                break
        else:
            return hi
        if shift == 0 or n <= FEW:
            return hi
    return None


def vector_codes(rows: DataFrame, scale: float = 256.0, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Codes of the vectors of ``rows(vec_id, label, embedding)``: vec_id, label, code, error, label_error,
    and codebooks_sha256 of the final entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has a byte a part, so 1 to 256 entries")
    spark = rows.sparkSession
    kept = scaled(rows, scale, ["vec_id", "label"])
    kind = dict(kept.dtypes)["label"]
    ids = kept.filter((F.size("v") % parts == 0) & F.col("vec_id").isNotNull())
    size = ids.agg(F.min(F.struct("vec_id", F.size("v").alias("n"))).alias("r")).select("r.n").head().n or 0
    fits = F.size("v") == size
    named = kept.filter(fits & F.col("vec_id").isNotNull())
    distinct = materialize(named.select("vec_id").distinct())
    cut = smallest(distinct, entries)
    drop(distinct)
    if cut is None:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), *(F.lit(None).cast("long").alias(c) for c in ("error", "label_error")), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    first = named.filter(F.col("vec_id") <= cut).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    books = whole(np.array([r.v for r in first], float)).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
    group = np.stack([groups_of(b) for b in books])
    state, before = kept.filter(fits), None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Round(books, group, before))
        after = materialize(state.mapInArrow(_step(shared, False), f"vec_id long, label {kind}, v array<double>, code binary, up binary, low binary"))
        if before is not None:
            drop(state)
        state, before = after, books
        books = updated(state, books)
    shared = spark.sparkContext.broadcast(Round(books, group, before))
    final = materialize(state.mapInArrow(_step(shared, True), f"vec_id long, label {kind}, code string, error long"))
    if rounds:
        drop(state)
    totals = materialize(final.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long").alias("label_error")))
    final = final.join(small_side(totals), F.col("label").eqNullSafe(F.col("of")))
    text = ",".join(str(int(v)) for v in books.ravel())
    out = final.select("vec_id", "label", "code", "error", "label_error")
    rest = kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), *(F.lit(None).cast("long").alias(c) for c in ("error", "label_error")))
    return out.unionByName(rest).withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest()))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds(n: int) -> str:
    """CTEs a0, b1, a1, ...: assignments (row, part, entry, squared distance) and codebooks, in turn."""
    out = []
    for i in range(n + 1):
        out.append(f"""
a{i} as (select rn, part, (min((d, entry))).entry as entry, (min((d, entry))).d as d from (
  select v.rn, v.part, b.entry as entry, list_sum(list_transform(range(1, len(v.e) + 1), lambda i: (v.e[i] - b.e[i]) * (v.e[i] - b.e[i]))) as d
  from v join b{i} b on b.part = v.part) group by rn, part)""".replace("min((d, entry))", "min({'d': d, 'entry': entry})"))
        if i < n:
            out.append(f"""
m{i + 1} as (select part, entry, list(m order by j) as e from (
  select a.part, a.entry, j, (sum(v.e[j]) - ((sum(v.e[j]) % count(*)) + count(*)) % count(*)) // count(*) as m
  from a{i} a join v on a.rn = v.rn and a.part = v.part, range(1, 5) t(j) where j <= len(v.e) group by a.part, a.entry, j) group by part, entry),
b{i + 1} as (select b.part, b.entry, coalesce(m.e, b.e) as e from b{i} b left join m{i + 1} m on m.part = b.part and m.entry = b.entry)""")
    return ",".join(out)


ORACLE_SQL = {
    "op12_vector_codes": f"""
with k as (select row_number() over (order by vec_id) - 1 as rn, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as e
           from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as (select rn, vec_id, part, e[part * 4 + 1 : part * 4 + 4] as e from k, range(0, 16) t(part)),
b0 as (select part, rn as entry, e from v where rn < 64),{_rounds(2)},
t as (select k.vec_id, k.label, string_agg(printf('%02x', cast(a.entry as int)), '' order by part) as code, cast(sum(d) as bigint) as error
      from a2 a join k on k.rn = a.rn group by k.rn, k.vec_id, k.label),
h as (select sha256(string_agg(x, ',' order by part, entry)) as h from (select part, entry, array_to_string(e, ',') as x from b2))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from t, h"""
}
