"""Operator 6: language of words and documents by a linear-chain conditional random field.

Words are runs of ASCII letters and code points from 128. A word's features are its affixes
and inner n-grams of 2 to 4 bytes (an affix is an n-gram with the word's border) and the
word itself, a lexicon entry, all hashed to rows of one weight table. Weights and label
transitions are learned together by gradient ascent on the chains' likelihood: chains are
spliced from runs of words of labelled documents, so that labels switch within them as in
code-switched text. Forward-backward labels each word of a text; a document's shares are the sums of
its words' marginals.

A chain of any length is cut into blocks of 64 words. The product of a block's matrices
carries messages over it, so blocks of all documents advance side by side and the result is
that of the plain recursion.

Training takes ``per_label`` documents of each language, by hash of doc_id, of at most
``longest`` characters, and fewer of each where languages are many, so that the sample has
some ``most`` documents: bounded by these parameters. Every language with such a row is learned.

Cases: a text that is null or has no letter is ``und`` with score 0; without any labelled
row everything is; repeated rows are labelled alike; null doc_ids stay null and count as
held out false; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import words as W
from .common import crc32_of_id, least_by_hash, materialize, read

_b = np.arange(256)
IS_LETTER = ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
SIZE = 1 << 14  # rows of each order's table
SPAN = 64


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (4 * SIZE, labels): n-grams of 2, 3, 4 bytes, then words
    trans: np.ndarray  # (labels, labels)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a zero after each, and n + 1 offsets."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8) if texts else np.zeros(0, np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]) if texts else np.zeros(1, np.int64)
    return data, off


def indexes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the table for each byte of a word and its end (m, 3), each word's first of
    these, the words' lexicon rows, and each text's first word."""
    inside = IS_LETTER[data]
    s, e, at = W.spans(data, off, inside)
    if not len(s):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), at
    low = np.where(inside, W.LOWER[data], 0).astype(np.uint32)
    n = len(low)
    p1 = np.concatenate([[0], low[:-1]]).astype(np.uint32)
    p2 = np.where(p1 > 0, np.concatenate([[0, 0], low[:-2]])[:n], 0).astype(np.uint32)
    p3 = np.where(p2 > 0, np.concatenate([[0, 0, 0], low[:-3]])[:n], 0).astype(np.uint32)
    use = inside.copy()
    use[np.minimum(e, n - 1)] = True  # a zero or other gap follows each word
    pos = np.flatnonzero(use)
    g = low[pos] | p1[pos] << np.uint32(8)
    out = np.empty((len(pos), 3), np.int64)
    for k, more in enumerate((None, p2[pos] << np.uint32(16), p3[pos] << np.uint32(24))):
        g = g if more is None else g | more
        out[:, k] = ((g * np.uint32(2654435761) >> np.uint32(18)) & np.uint32(SIZE - 1)) + np.uint32(k * SIZE)
    lex = (W.hashes(data, s, e) >> np.uint64(50)).astype(np.int64) + 3 * SIZE
    return out, np.searchsorted(pos, s), lex, at


def emissions(m: Model, idx: np.ndarray, first: np.ndarray, lex: np.ndarray) -> np.ndarray:
    x = m.table[idx[:, 0]] + m.table[idx[:, 1]] + m.table[idx[:, 2]]
    return np.add.reduceat(x, first, axis=0) + m.table[lex]


def marginals(e: np.ndarray, at: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posterior label probabilities (words, labels) of chains e[at[i]:at[i + 1]]."""
    k = e.shape[1]
    size = np.diff(at)
    blocks = -(-size // SPAN)
    b_at = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(b_at[-1])
    if nb == 0:
        return np.zeros((0, k))
    a = np.exp(trans - trans.max())
    word = np.arange(len(e)) - np.repeat(at[:-1], size)
    row, col = np.repeat(b_at[:-1], size) + word // SPAN, word % SPAN
    x = np.zeros((SPAN, nb, k))
    live = np.zeros((SPAN, nb), bool)
    x[col, row] = np.exp(e - e.max(1, keepdims=True))
    live[col, row] = True
    # each block's matrix: from the label before it to that of its last word
    mat = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(SPAN):
        on = np.flatnonzero(live[t])
        y = (mat[on].reshape(-1, k) @ a).reshape(-1, k, k) * x[t, on][:, None, :]
        mat[on] = y / y.sum((1, 2), keepdims=True)
    start, end = np.ones((nb, k)) / k, np.ones((nb, k)) / k
    docs = np.flatnonzero(blocks > 0)
    for j in range(int(blocks.max())):
        d = docs[blocks[docs] > j + 1]
        if not len(d):
            break
        i = b_at[d] + j
        v = np.einsum("nk,nkl->nl", start[i], mat[i])
        start[i + 1] = v / v.sum(1, keepdims=True)
        i = b_at[d + 1] - 1 - j
        v = np.einsum("nkl,nl->nk", mat[i], end[i])
        end[i - 1] = v / v.sum(1, keepdims=True)
    f, g = np.empty((SPAN, nb, k)), np.empty((SPAN, nb, k))
    for t in range(SPAN):
        # the message into a chain's first word is even, so the first transition is of no effect on ties
        v = (start @ a) * x[t]
        v = np.where(live[t][:, None], v / np.maximum(v.sum(1, keepdims=True), 1e-300), start)
        f[t] = start = v
    for t in range(SPAN - 1, -1, -1):
        g[t] = end
        v = (x[t] * end) @ a.T
        end = np.where(live[t][:, None], v / np.maximum(v.sum(1, keepdims=True), 1e-300), end)
    p = f[col, row] * g[col, row]
    return p / p.sum(1, keepdims=True)


def fit(langs: list[str], texts: list[tuple[str, str]], chains: int = 4096, length: int = 48, rounds: int = 4, batch: int = 256, rate: float = 0.15, seed: int = 1) -> Model:
    """Learn from (lang, text) pairs; AdaGrad over batches of spliced chains."""
    k = len(langs)
    m = Model(langs, np.zeros((4 * SIZE, k)), np.zeros((k, k)))
    if k < 2:
        return m
    rng, docs = np.random.default_rng(seed), [[] for _ in langs]
    for lang, text in texts:
        idx, first, lex, _ = indexes(*joined([text.encode()]))
        if len(lex) >= 4:
            docs[langs.index(lang)].append((idx, np.append(first, len(idx)), lex))
    able = [y for y in range(k) if docs[y]]
    if len(able) < 2:
        return m
    made = []
    for _ in range(chains):
        rows, lex, size, y = [], [], [], []
        while len(y) < length:
            label = able[rng.integers(len(able))]
            idx, first, words = docs[label][rng.integers(len(docs[label]))]
            take = min(int(rng.geometric(1 / 24)) + 1, length - len(y), len(words))
            a = int(rng.integers(len(words) - take + 1))
            rows.append(idx[first[a] : first[a + take]])
            size += np.diff(first[a : a + take + 1]).tolist()
            lex += words[a : a + take].tolist()
            y += [label] * take
        made.append((np.concatenate(rows), np.array(size), np.array(lex), np.array(y)))
    s_table, s_trans = np.full((4 * SIZE, k), 1e-2), np.full((k, k), 1e-2)
    for _ in range(rounds):
        order = rng.permutation(chains)
        for lo in range(0, chains, batch):
            part = [made[i] for i in order[lo : lo + batch]]
            idx, size = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            lex, y = np.concatenate([p[2] for p in part]), np.concatenate([p[3] for p in part])
            first = np.cumsum(size) - size
            n = len(part)
            e = emissions(m, idx, first, lex)
            p, pair = _chain_marginals(e.reshape(n, length, k), m.trans)
            grad = -p.reshape(-1, k)
            grad[np.arange(len(y)), y] += 1
            word = np.repeat(np.arange(len(size)), size)
            gt = np.empty_like(m.table)
            for j in range(k):
                gt[:, j] = np.bincount(lex, grad[:, j], 4 * SIZE)
                for c in range(3):
                    gt[:, j] += np.bincount(idx[:, c], grad[word, j], 4 * SIZE)
            yy = y.reshape(n, length)
            ga = -pair
            np.add.at(ga, (yy[:, :-1].ravel(), yy[:, 1:].ravel()), 1)
            gt, ga = gt - 1e-3 * m.table, ga - 1e-3 * m.trans
            s_table += gt**2
            s_trans += ga**2
            m.table += rate * gt / np.sqrt(s_table)
            m.trans += rate * ga / np.sqrt(s_trans)
    m.table = m.table.astype(np.float32)
    return m


def _chain_marginals(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed pair marginals of chains of equal length."""
    n, t, k = e.shape
    a = np.exp(trans - trans.max())
    x = np.exp(e - e.max(2, keepdims=True))
    f, b = np.empty_like(x), np.empty_like(x)
    f[:, 0] = x[:, 0] / x[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        v = (f[:, i - 1] @ a) * x[:, i]
        f[:, i] = v / v.sum(1, keepdims=True)
    b[:, -1] = 1 / k
    for i in range(t - 2, -1, -1):
        v = (x[:, i + 1] * b[:, i + 1]) @ a.T
        b[:, i] = v / v.sum(1, keepdims=True)
    p = f * b
    pair = f[:, :-1, :, None] * a * (x[:, 1:] * b[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return p / p.sum(2, keepdims=True), pair.sum((0, 1))


def train(docs: DataFrame, per_label: int = 400, most: int = 20_000, longest: int = 50_000) -> Model:
    """Fit on a bounded sample of ``docs(doc_id, text, lang)``, which the caller may learn from:
    ``per_label`` rows of each language, fewer if all languages together exceed ``most`` (20 rows
    at least), by least hash of doc_id. Of repeated ids and texts one row counts."""
    rows = docs.filter("doc_id is not null and lang is not null and text is not null")
    rows = rows.select("doc_id", "text", "lang", F.xxhash64("text").alias("h")).filter(F.length("text") <= longest)
    ids = materialize(least_by_hash(rows, "lang", per_label))
    langs = sorted(r.lang for r in ids.select("lang").distinct().collect())
    share = max(20, min(per_label, most // max(1, len(langs))))
    ids = ids.filter(F.col("rank") <= share).select("lang", "doc_id", "h")
    got = rows.join(F.broadcast(ids), ["lang", "doc_id", "h"]).dropDuplicates(["lang", "doc_id", "h"])  # len(langs) * share rows at most
    return fit(langs, sorted((r.lang, r.text) for r in got.select("lang", "text").collect()))


def label(m: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and share of each text."""
    raw = [(t or "").encode() for t in texts]
    idx, first, lex, at = indexes(*joined(raw))
    k = len(m.langs)
    share = np.zeros((len(raw), max(k, 1)))
    if len(lex) and k:
        p = marginals(emissions(m, idx, first, lex).astype(float), at, m.trans)
        c = np.concatenate([np.zeros((1, k)), np.cumsum(p, 0)])
        share[:] = c[at[1:]] - c[at[:-1]]
    total = share.sum(1)
    best = share.argmax(1)
    score = np.where(total > 0, share.max(1) / np.maximum(total, 1e-300), 0.0)
    lang = []
    for i, t in enumerate(texts):
        ok = k and total[i] > 0 and (_ascii_letter(raw[i]) or any(c.isalpha() for c in t))
        lang.append(m.langs[best[i]] if ok else "und")
        score[i] = score[i] if ok else 0.0
    return lang, np.clip(score, 0, 1)


def _ascii_letter(raw: bytes) -> bool:
    b = np.frombuffer(raw[:4096], np.uint8)
    return bool((IS_LETTER[b] & (b < 128)).any())


def label_words(m: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of a text."""
    data, off = joined([text.encode()])
    s, e, _ = W.spans(data, off, IS_LETTER[data])
    idx, first, lex, at = indexes(data, off)
    if not len(lex) or not m.langs:
        return []
    p = marginals(emissions(m, idx, first, lex).astype(float), at, m.trans)
    raw = data.tobytes()
    return [(raw[a:b].decode(), m.langs[int(q.argmax())], float(q.max())) for a, b, q in zip(s, e, p, strict=True)]


def _predict(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in W.pieces(big, "text", 1 << 19):
                lang, score = label(shared.value, b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def held_out(c: str = "doc_id"):
    return F.coalesce(crc32_of_id(c) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs(doc_id, text)``: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def trained(spark: SparkSession, sf_dir: str) -> Model:
    return train(read(spark, sf_dir, "documents").select("doc_id", "text", "lang").filter(~held_out()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = predict(read(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return r.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.0) -> DataFrame:
    """The rows whose text has a language, with a share of at least ``least``, all columns kept.
    What is ``und`` goes: a null text, or one without a letter. A text that mixes languages is
    no worse for that, so by default no share is asked for. ``lang_pred``, the language found, is
    added (in place of a column of that name), for later stages to go by."""
    return filter_rows(docs, spark.sparkContext.broadcast(trained(spark, sf_dir)), least, "lang_pred")


def filter_rows(docs: DataFrame, shared, least: float, found: str | None = None) -> DataFrame:
    """Rows as ``keep_known`` keeps them; their language goes to a column ``found``, if given."""
    docs = docs.drop(found) if found else docs
    text, schema = docs.columns.index("text"), StructType([*docs.schema.fields, *([StructField(found, StringType())] if found else [])])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for b in W.pieces(big, "text", 1 << 19):
                lang, score = label(shared.value, b.column(text).to_pylist())
                if found:
                    b = pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string())], [*b.schema.names, found])
                yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)
