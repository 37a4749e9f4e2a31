"""Hard negatives and vector codes against brute force, and the cases of their docstrings."""

import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import hard_negatives as H
from gridloom.llm import vector_codes as C

ROW = "vec_id long, label int, embedding array<double>, d int, code string, key string"


def table(spark, rows):
    """Beside the columns in use, some whose names clash with the operators' own."""
    return spark.createDataFrame([(i, y, v, 7, "clash", "x") for i, y, v in rows], ROW)


def vectors(n, d, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.2, (6, d))
    x = centre[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, d))
    x[n // 2 : n // 2 + 20] = x[3]  # copies, so scores tie
    return [(i, int(rng.integers(0, labels)), v.tolist()) for i, v in enumerate(x)]


ODD = [(None, 1, [0.1] * 8), (7001, None, [0.1] * 8), (7002, 1, None), (7003, 1, [0.1] * 7 + [None]), (7004, 1, [float("nan")] * 8), (7005, 1, [float("inf")] * 8), (7006, 1, [])]


def hard(rows):
    """By definition, in whole numbers; one row an id."""
    keep = {}
    for i, y, v in rows:
        if i is not None and y is not None and v and all(c is not None and abs(c * 256) < float("inf") for c in v):
            keep[i] = min(keep.get(i, (y, v)), (y, v))
    x = {i: (y, [int(np.floor(256 * c)) for c in v]) for i, (y, v) in keep.items()}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    dot = lambda a, b: clip(sum(p * q for p, q in zip(a, b, strict=True)))
    out = []
    for a in x:
        if a % 100 == 0:
            s = sorted((-dot(x[a][1], v), i, y) for i, (y, v) in x.items() if i != a and len(v) == len(x[a][1]))
            for p, i, _ in [t for t in s if t[2] == x[a][0]][:5]:
                near = [t for t in s if t[2] != x[a][0] and 80 * -p <= 100 * -t[0] <= 100 * -p][:5]
                out += [(a, i, r + 1, t[1], -p, -t[0]) for r, t in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("rows, anchors", [(4096, 1024), (37, 2)])  # one group, and a grid of many
def test_hard_negatives(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(H, "ROWS", rows)
    monkeypatch.setattr(H, "ANCHORS", anchors)
    t = vectors(600, 8) + ODD + [(900, 0, [0.2] * 8), (900, 1, [0.1] * 8), (900, 0, [0.2] * 8)]
    t += [(i, i % 2, [0.3, 0.1 * i, 0.2]) for i in range(1000, 1012)] + [(1100, 0, [0.0]), (1101, 1, [0.5]), (1102, 0, [0.1]), (1200, 9, [-0.3] * 8)]
    got = H.hard_negatives(table(spark, t), "vec_id % 100 = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = hard(t)
    assert len(want) > 50 and sorted(tuple(r) for r in got.collect()) == want


def test_hard_negatives_of_huge_and_of_no_vectors(spark):
    rng = random.Random(2)
    t = [(i * 50, i % 3, [rng.choice([-1, 1]) * 10.0 ** rng.choice([0, 9, 12, 200]) for _ in range(4)]) for i in range(60)] + [(7, 1, [1e308] * 4)]
    got = H.hard_negatives(table(spark, t), "vec_id % 100 = 0")
    assert sorted(tuple(r) for r in got.collect()) == hard(t)
    assert H.hard_negatives(table(spark, []), "vec_id % 100 = 0").count() == 0
    assert H.hard_negatives(table(spark, [(100, 1, [0.1] * 4)]), "vec_id % 100 = 0").count() == 0


def test_bounds_of_quantised_scores_hold_and_prune():
    x = np.floor(256 * np.array([v for _, _, v in vectors(3000, 16, seed=4)]))
    books = H.fit(x[:1000])
    codes, rest = H.encode(x, books)
    low, high = H.bounds(x[:50], books, codes, rest)
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high >= H.least_kept(low, 5)[:, None]).mean() < 0.2  # what five best need of exact products
    low, high = H.bounds(x[:50], [b * 0 for b in books], codes, np.sqrt((x**2).sum(1)))  # the worst codebooks
    assert (low <= exact).all() and (exact <= high).all()


def coded(rows, parts=16, entries=64, rounds=2):
    """Lloyd's iterations by definition, in whole numbers: (vec_id, code, error, label_error), entries' digest."""
    x = [(i, y, [int(np.floor(256 * c)) for c in v]) for i, y, v in rows if v and all(c is not None and abs(c * 256) < float("inf") for c in v)]
    named = sorted((i, v) for i, _, v in x if i is not None and len(v) % parts == 0)
    d = len(named[0][1])
    w = d // parts
    first = {}
    for i, v in named:
        if len(v) == d:
            first.setdefault(i, v)
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [list(b) for b in zip(*[cut(first[i]) for i in sorted(first)[:entries]], strict=True)]
    fit = [(i, y, cut(v)) for i, y, v in x if len(v) == d]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for r in range(rounds + 1):
        at = [[min((gap(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, _, v in fit]
        if r < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [v[p] for (_, _, v), a in zip(fit, at, strict=True) if a[p][1] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    error = [min(sum(d for d, _ in a), 2**63 - 1) for a in at]
    per = {}
    for (_, y, _), e in zip(fit, error, strict=True):
        per[y] = per.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, bytes(k for _, k in a).hex(), e, min(per[y], 2**63 - 1)) for (i, y, _), a, e in zip(fit, at, error, strict=True)]
    return sorted(out + [(i, None, None, None) for i, _, v in x if len(v) != d], key=repr), digest


@pytest.mark.parametrize("n", [400, 40])  # more ids than entries, and fewer
def test_vector_codes(spark, n):
    t = vectors(n, 32, seed=n) + [(9, 1, [0.3] * 32), (None, None, [0.1] * 32), (9001, None, [0.2] * 32), (9002, 1, [0.5] * 31), (9003, 1, [0.5] * 16), (9004, 1, None), (9005, 2, [None] * 32), (9006, 2, [float("nan")] * 32), (9007, 1, [])]
    t += [t[5]] * 2  # repeated rows
    got = C.vector_codes(table(spark, t)).collect()
    want, digest = coded(t)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_vector_codes_of_huge_numbers(spark):
    rng = random.Random(8)
    t = [(i, i % 3, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 0, 7, 15, 30, 300]) for _ in range(16)]) for i in range(90)]
    got = C.vector_codes(table(spark, t)).collect()
    want, digest = coded(t)
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=repr) == want and got[0].codebooks_sha256 == digest


def test_vector_codes_of_nothing(spark):
    assert C.vector_codes(table(spark, [])).count() == 0
    got = C.vector_codes(table(spark, [(1, 1, [0.5] * 3)])).collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == [(1, None, None)]


def test_rounds_skip_groups_and_stay_exact():
    """Against full scans over many rounds, with bounds carried along."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 40, (3000, 16)) + 120 * rng.integers(-2, 3, (3000, 1)))
    books = x[:64].reshape(64, 4, 4).transpose(1, 0, 2)
    books = np.array([int(v) for v in books.ravel()], object).reshape(books.shape)
    group, before, state, met = np.stack([C.groups_of(b) for b in books]), None, None, []
    for _ in range(6):
        r = C.Round(books, group, before)
        code, up, low, error = r.assign(x, state)
        met.append(r.met)
        parts = x.reshape(-1, 4, 4)
        d = np.stack([((parts[:, p, None] - books[p].astype(float)) ** 2).sum(2) for p in range(4)], 1)
        assert (code == d.argmin(2)).all() and (error.astype(float) == d.min(2).sum(1)).all()
        other = d.copy()
        np.put_along_axis(other, code[:, :, None].astype(int), np.inf, 2)
        assert (up >= np.sqrt(d.min(2))).all()
        for g in range(low.shape[2]):
            assert (low[:, :, g] <= np.sqrt(np.where(group[None] == g, other, np.inf).min(2))).all()
        state, before, books = (code, up, low), books, books.copy()
        for p in range(4):
            for e in set(code[:, p].tolist()):
                mine = parts[code[:, p] == e, p]
                books[p, e] = [int(c) // len(mine) for c in mine.sum(0)]
    assert met[1] < 0.8 * met[0] and met[-1] < 0.4 * met[0]


def test_smallest_narrows_ranges(spark):
    rng = random.Random(1)
    for ids in ([5], list(range(-300, 9000, 2)), [2**62, -(2**62), *rng.sample(range(2**61), 5000)], [*range(70000), 2**63 - 1]):
        cut = C.smallest(spark.createDataFrame([(i,) for i in ids], "vec_id long"), 64)
        below = sum(i <= cut for i in ids)
        assert min(64, len(ids)) <= below <= C.FEW + 64
    assert C.smallest(spark.createDataFrame([], "vec_id long"), 64) is None
