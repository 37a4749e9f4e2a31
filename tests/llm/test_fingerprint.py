"""Prefix hashes, fingerprints and their query against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from gridloom.llm import fingerprint as X


def test_spans_and_extensions_by_comparison():
    rng = random.Random(4)
    t = "".join(rng.choice("ab") for _ in range(3000)) + "é😀\x00" * 50 + "a" * 500
    h = X.Prefix.of(t)
    a, b = (np.array([rng.randrange(len(t)) for _ in range(4000)]) for _ in range(2))
    n = np.array([min(rng.randrange(12), len(t) - max(i, j)) for i, j in zip(a, b, strict=True)])
    assert (h.equal(a, b, n) == [t[i : i + k] == t[j : j + k] for i, j, k in zip(a, b, n, strict=True)]).all()
    most = len(t) - np.maximum(a, b)
    want = [next((k for k in range(m) if t[i + k] != t[j + k]), m) for i, j, m in zip(a, b, most, strict=True)]
    assert h.extension(a, b, most).tolist() == want and max(want) > 100
    poly = lambda s: sum((ord(c) + 1) * pow(X.BASE, i, X.P) for i, c in enumerate(s)) % X.P
    assert h.windows(16).tolist()[::97] == [poly(t[i : i + 16]) for i in range(0, len(t) - 15, 97)]
    assert h.joined(np.array([5]), np.array([7]), np.array([3010]), np.array([9])).tolist() == [poly(t[5:12] + t[3010:3019])]


def test_blocks_join(monkeypatch):
    t = "".join(map(chr, np.random.default_rng(0).integers(1, 0xD000, 5000)))
    one = X.Prefix.of(t)
    monkeypatch.setattr(X, "BLOCK", 64)
    many = X.Prefix.of(t)
    assert (one.sums == many.sums).all() and (one.windows(16) == many.windows(16)).all()


def plain(a, b):
    """Fingerprint values of ``a`` and ``b``, by sets of spans, and their likeness."""
    out = []
    for t in (a, b):
        spans = {t[i : i + 16] for i in range(max(1, len(t) - 15))} if t else set()
        code = lambda s: sum((ord(c) + 1) * pow(X.BASE, i, X.P) for i, c in enumerate(s)) % X.P
        out.append(sorted({(code(s) * 0x9E3779B97F4A7C15 % 2**64) >> 16 for s in spans})[:128])
    if not out[0] or not out[1]:
        return out[0], float(out[0] == out[1])
    union = sorted(set(out[0] + out[1]))[:128]
    share = len(set(out[0]) & set(out[1]) & set(union)) / len(union)
    return out[0], 2 * share / (1 + share)


DOCS = "doc_id long, text string, lang string, range int, ahead int, md5 string"


@pytest.mark.parametrize("partitions, group", [(1, 1 << 20), (5, 300), (64, 1)])
def test_fingerprints_by_definition(spark, monkeypatch, partitions, group):
    monkeypatch.setattr(X, "GROUP", group)
    rng = random.Random(6)
    words = ["w%d" % i for i in range(200)]
    t = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 60, 400]))) for _ in range(60)]
    rows = [(i * 3 - 40, x) for i, x in enumerate(t)]
    rows += [(-500, ""), (-501, None), (-502, "é"), (-503, "ab"), (-504, "a" * 4000), (11, t[0] + "!"), (11, "other"), (None, "none"), (None, t[5]), (2**63 - 1, "x y"), (-(2**63), "least")]
    rows += [rows[4], rows[4], (-503, "ab"), (-501, ""), (12345, t[7])]
    docs = spark.createDataFrame([(i, x, "en", 3, 1, "clash") for i, x in rows], DOCS).repartition(3)
    got = {(r.doc_id, r.edited_sha256): r for r in X.fingerprints(docs, partitions).collect()}
    order = sorted({(i, x or "") for i, x in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).digest()))
    assert len(got) == len(order)
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        h = len(a) // 2
        edited = a[: len(a) - h] + b[:h]
        r = got[i, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(a)
        values, near = plain(a, edited)
        assert r.fingerprint == "".join("%012x" % v for v in values)
        assert r.edited_fingerprint == "".join("%012x" % v for v in plain(edited, a)[0])
        assert abs(r.near_edited - near) < 1e-9 and abs(r.near_next - plain(a, b)[1]) < 1e-9
        same = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert (r.prefix_edited, r.prefix_next) == (same(a, edited), same(a, b))
        assert abs(X.likeness(r.fingerprint, r.edited_fingerprint) - r.near_edited) < 1e-12


def test_few_and_very_long_documents(spark):
    make = lambda rows: spark.createDataFrame([(i, x, "en", 3, 1, "clash") for i, x in rows], DOCS)
    assert X.fingerprints(make([])).count() == 0
    (r,) = X.fingerprints(make([(3, "abcdef")] * 5)).collect()
    assert (r.doc_id, r.n_chars, r.near_next) == (3, 6, 1.0) and r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    rng = np.random.default_rng(5)
    long = "".join(map(chr, rng.integers(97, 123, 3_000_000)))
    two = {r.doc_id: r for r in X.fingerprints(make([(1, long), (2, long[:2_000_000] + "!" + long[2_000_000:]), (3, "short")])).collect()}
    assert two[2].near_next > 0.99 and two[2].prefix_next == 2_000_000 and two[3].near_next == 0.0
    assert 0.6 < two[1].near_edited < 0.74 and two[1].n_chars == 3_000_000  # half of it and five letters more
