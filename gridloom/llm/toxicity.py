"""Operator 5: toxicity by maximum-scoring segments over token log-odds.

Tokens are words and their prefixes of 4 to 8 bytes, by hash. From a bounded sample of
labelled rows (``per_class`` of each label, by hash of doc_id, texts of ``longest``
characters at most) each token of the ``vocabulary`` with the strongest log-odds gets the log-odds of occurring in toxic texts against
clean ones, by occurrences under an informative Dirichlet prior of weight ``prior`` spread like the
pooled counts, less one standard error. A word scores its own log-odds if it is known, else those
of its longest known prefix, else 0, less a drift, so that ordinary text scores negative.

A linear scan keeps cumulative sums and yields all maximal-scoring segments of a text.
The best scores of clean sample texts, less log(words) / decay, follow an extreme-value
(Gumbel) law; its location and scale turn a segment's score into a significance, and every
segment under ``alpha`` is a toxic passage. A logistic curve over the best significance and
the sum over passages, fitted on the sample, gives the document's score: the chance of a toxic
label were both labels equally common, whatever their shares in the sample.

Labels come only from rows in ``train``; labels, lang, source and doc_id are no input of a score.

Cases: null, empty and wordless texts score as a text without any hit; rows without a label,
or with a null one, teach nothing; without toxic or clean samples the score is the share of
toxic ones (0 if none); repeated rows score alike; null ids stay null and count as held out
false; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import crc32_of_id, least_by_hash, read

#: Texts of fewer words are judged as if they had so many: the law of few words would be a guess.
LEAST_WORDS = 32
PREFIXES = (4, 5, 6, 7, 8)
_SALT = {k: np.uint64(0x9E37_79B9 * (k + 1)) for k in PREFIXES}


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = 1.0
    decay: float = 1.0
    mu: float = 0.0
    beta: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    share: float | None = None
    alpha: float = 0.01


def _tokens(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word indexes and token hashes, from the shortest prefix to the word."""
    out = []
    for k in PREFIXES:
        at = np.flatnonzero(e - s >= k)
        out.append((at, W.mix(W.hashes(data, s[at], s[at] + k) ^ _SALT[k])))
    return [*out, (np.arange(len(s)), W.hashes(data, s, e))]


def word_scores(m: Model, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    x = np.zeros(len(s))
    if len(m.keys):
        for at, h in _tokens(data, s, e):
            i = np.minimum(np.searchsorted(m.keys, h), len(m.keys) - 1)
            known = m.keys[i] == h
            at, odds = at[known], m.odds[i[known]]
            x[at] = np.where(np.abs(odds) > np.abs(x[at]), odds, x[at])
    return x - m.drift


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of scores x, in order.

    Each run of positive scores opens a segment with the cumulative sums at its two ends; it
    takes in all from the nearest earlier segment that starts lower while that one ends lower
    too. Each kept segment links to its nearest earlier one with a lower start, so those between,
    which start no lower, are never looked at again, and time is linear in the runs.
    """
    up = x > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    c = np.concatenate([[0.0], np.cumsum(x)])
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []  # sum before
    high: list[float] = []  # sum after
    link: list[int] = []
    runs = zip(edge[::2].tolist(), edge[1::2].tolist(), c[edge[::2]].tolist(), c[edge[1::2]].tolist(), strict=True)
    for a, b, lo, hi in runs:
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = link[j]
            if j < 0 or high[j] >= hi:
                break
            a, lo = first[j], low[j]
            for part in (first, last, low, high, link):
                del part[j:]
            j -= 1
        for part, v in ((first, a), (last, b), (low, lo), (high, hi), (link, j)):
            part.append(v)
    return [(a, b, r - lo) for a, b, lo, r in zip(first, last, low, high, strict=True)]


def significance(m: Model, score: float, n: int) -> float:
    """-log of the chance that a clean text of n words has so good a segment."""
    z = (score - np.log(max(n, LEAST_WORDS)) / m.decay - m.mu) / m.beta
    p = -np.expm1(-np.exp(-np.clip(z, -30, 300)))
    return float(-np.log(max(p, 1e-30)))


def features(m: Model, x: np.ndarray) -> tuple[float, float, list[tuple[int, int, float, float]]]:
    found = [(a, b, v, significance(m, v, len(x))) for a, b, v in segments(x)]
    passages = [p for p in found if p[3] >= -np.log(m.alpha)]
    return max((p[3] for p in found), default=0.0), float(np.log1p(sum(p[3] for p in passages))), passages


def score(m: Model, best: float, total: float) -> float:
    if m.share is not None:
        return m.share
    a, b, c = m.weights
    return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(best) + c * total, -30, 30))))


def _spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = W.buffers(texts)
    return (data, *W.spans(data, off, W.IS_WORD[data]))


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Token hashes, how often each occurs, and the number of words."""
    keys, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for a in range(0, len(texts), 100):
        data, s, e, _ = _spans(pa.array(texts[a : a + 100]))
        total += len(s)
        k, c = np.unique(np.concatenate([h for _, h in _tokens(data, s, e)]), return_counts=True)
        keys, inv = np.unique(np.concatenate([keys, k]), return_inverse=True)
        n = np.bincount(inv, np.concatenate([n, c]), len(keys)).astype(np.int64)
    return keys, n, total


def fit(toxic: list[str], clean: list[str], prior: float = 400.0, drifts: tuple[float, ...] = (0.1, 0.3, 1.0), vocabulary: int = 200_000, folds: int = 10) -> Model:
    """Each of ``folds`` parts of the sample is scored by the log-odds of the others, almost as
    many texts as the whole has, so a small sample's curve fits its model too; that calibrates the curve
    and picks the drift, and the model keeps the log-odds of the whole sample."""
    if not toxic or not clean:
        return Model(share=float(bool(toxic)))
    parts = [[_counts(texts[k::folds]) for k in range(folds)] for texts in (toxic, clean)]
    rows = []
    for k in range(folds):
        rest = [_merged(p[:k] + p[k + 1 :]) for p in parts]
        m = _odds(*rest, prior, vocabulary)
        rows += [(y, x) for y, texts in ((1, toxic[k::folds]), (0, clean[k::folds])) for x in _texts_scores(m, texts)]
    m = _odds(*map(_merged, parts), prior, vocabulary)
    tried = [_calibrate(replace(m, drift=d), [(y, x - d) for y, x in rows]) for d in drifts]
    return min(tried, key=lambda t: t[0])[1]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    keys, inv = np.unique(np.concatenate([k for k, _, _ in parts]), return_inverse=True)
    return keys, np.bincount(inv, np.concatenate([n for _, n, _ in parts]), len(keys)), sum(t for _, _, t in parts)


def _calibrate(m: Model, rows: list[tuple[int, np.ndarray]]) -> tuple[float, Model]:
    """Log loss of the curve, and the model with its extreme-value law and curve fitted."""
    top = np.array([max((v for *_, v in segments(x)), default=0.0) for y, x in rows if not y])
    n = np.array([max(LEAST_WORDS, len(x)) for y, x in rows if not y])
    # decay of the score's tail, from the excesses over the upper quarter
    q = np.quantile(top, 0.75)
    over = top[top > q] - q
    m.decay = float(np.clip(1 / over.mean(), 0.2, 10)) if len(over) and over.mean() > 0 else 1.0
    rest = top - np.log(n) / m.decay
    m.beta = max(float(rest.std()) * np.sqrt(6) / np.pi, 0.05)
    m.mu = float(rest.mean()) - 0.5772 * m.beta
    x = np.array([(1.0, np.log1p(b), t) for b, t, _ in (features(m, v) for _, v in rows)])
    y = np.array([float(y) for y, _ in rows])
    m.weights = _logistic(x, y, np.where(y == 1, (1 - y).sum() / y.sum(), 1.0))
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ np.array(m.weights), -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), m


def _odds(toxic: tuple[np.ndarray, np.ndarray, int], clean: tuple[np.ndarray, np.ndarray, int], prior: float, vocabulary: int) -> Model:
    (k1, c1, n1), (k0, c0, n0) = toxic, clean
    keys, inv = np.unique(np.concatenate([k1, k0]), return_inverse=True)
    a = np.bincount(inv[: len(k1)], c1, len(keys))
    b = np.bincount(inv[len(k1) :], c0, len(keys))
    keep = a + b >= 3
    keys, a, b = keys[keep], a[keep], b[keep]
    alpha = np.maximum(0.5, prior * (a + b) / max(1, n1 + n0))  # the prior's counts, spread like the pooled ones, half a count at least
    odds = lambda c, n: np.log((c + alpha) / (n + prior - c - alpha))
    d = odds(a, n1) - odds(b, n0)
    d = np.sign(d) * np.maximum(0, np.abs(d) - np.sqrt(1 / (a + alpha) + 1 / (b + alpha)))
    order = np.sort(np.lexsort((-(a + b), -np.abs(d)))[: min(vocabulary, int((d != 0).sum()))])
    return Model(keys=keys[order], odds=np.clip(d[order], -2.0, 8.0), drift=0.0)


def _texts_scores(m: Model, texts: list[str]) -> Iterator[np.ndarray]:
    for a in range(0, len(texts), 100):
        data, s, e, at = _spans(pa.array(texts[a : a + 100]))
        x = word_scores(m, data, s, e)
        for i in range(len(at) - 1):
            yield x[at[i] : at[i + 1]]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 0.1 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, longest: int = 50_000, vocabulary: int = 200_000) -> Model:
    """Fit on a bounded sample of ``labels(doc_id, toxic)`` joined to ``docs``; the caller
    passes only labels it may learn from. An id with both labels teaches nothing; of repeated
    ids and texts one row counts. The least hashes of ids make the sample, so it's repeatable."""
    sure = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).filter("y = z").select("doc_id", "y")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= longest).withColumn("h", F.xxhash64("text"))
    ids = least_by_hash(docs.select("doc_id", "h").join(sure, "doc_id"), "y", per_class).drop("rank")  # 2 * per_class rows at most
    rows = docs.join(F.broadcast(ids), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "y").collect()
    texts = {y: [r.text for r in sorted((r for r in rows if r.y == y), key=lambda r: (r.doc_id, r.text))] for y in (0, 1)}
    return fit(texts[1], texts[0], vocabulary=vocabulary)


def _predict(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for big in it:
            for b in W.pieces(big, "text", 1 << 20):
                data, s, e, at = _spans(b.column("text"))
                x = word_scores(m, data, s, e)
                p, spans = np.zeros(b.num_rows), []
                for i in range(b.num_rows):
                    best, total, found = features(m, x[at[i] : at[i + 1]])
                    p[i] = score(m, best, total)
                    spans.append([{"start": f[0], "end": f[1], "score": f[2], "significance": f[3]} for f in found])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("significance", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array(spans, kind)], [*b.schema.names[:-1], "score", "passages"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs(doc_id, text)``: doc_id, score, passages (words from start to end)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "array<struct<start:int,end:int,score:double,significance:double>>"
    return d.mapInArrow(_predict(shared), f"doc_id long, score double, passages {kind}")


def held_out(c: str = "doc_id"):
    return F.coalesce(crc32_of_id(c) % 3 == 1, F.lit(False))


def _scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out())
    source = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, train(source, labels))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _scored(spark, read(spark, sf_dir, "documents"), sf_dir)
    return r.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score below ``limit``, with all their columns."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter("doc_id is not null and toxic is not null").filter(~held_out())
    m = train(read(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return filter_rows(docs, spark.sparkContext.broadcast(m), limit)


def filter_rows(docs: DataFrame, shared, limit: float) -> DataFrame:
    schema, text = docs.schema, docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for big in it:
            for b in W.pieces(big, "text", 1 << 20):
                data, s, e, at = _spans(b.column(text).cast(pa.string()))
                x = word_scores(m, data, s, e)
                keep = [score(m, *features(m, x[at[i] : at[i + 1]])[:2]) < limit for i in range(b.num_rows)]
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
