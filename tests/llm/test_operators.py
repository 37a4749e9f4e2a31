"""Operators against brute force, round trips and the cases of their docstrings."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from gridloom.llm import chat, common, decontaminate, language, near_dup, packing, token_counts, token_file, token_ids, topk, toxicity, warc
from gridloom.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows], DOCS)


def texts(n=60, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 80))) for _ in range(n)]
    for i in range(0, n, 3):
        w = out[i].split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, *out[:4], "", None, "!!", "one two", "One, two!", "é " * 3000]


def bag(t):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("whole", [32768, 1])  # by component, and bucket by bucket
def test_near_duplicates_by_brute_force(spark, whole):
    t = texts()
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs(spark, enumerate(t)), whole=whole, block=2).collect()}
    sets = [bag(x) for x in t]
    near = [[j for j, b in enumerate(sets) if i != j and a and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    least = list(range(len(t)))
    for _ in t:
        least = [min([least[i], *(least[j] for j in near[i])]) for i in range(len(t))]
    assert [(got[i].n_links, got[i].class_id) for i in range(len(t))] == [(len(x), c) for x, c in zip(near, least, strict=True)]
    assert got[80].copy_id == 0
    own = docs(spark, enumerate(t)).withColumn("_text_key", common.F.lit("own"))
    kept = near_dup.keep_one(own)
    assert kept.columns == own.columns and {(r.key, r["_text_key"]) for r in kept.collect()} == {("clash", "own")}


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dup.near_duplicates(docs(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, None)])).count() == 3


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    name = rng.sample(range(10**9), 6100)
    links = [(name[i], name[i + 1]) for i in range(3000) if i != 2000]
    links += [(name[i], name[i + k]) for i in range(3100, 6000) for k in range(1, 5)]
    links += [(7, 7), links[0], links[0][::-1], (None, 3)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    parts = [name[:2001], name[2001:3001], name[3100:6004]]
    assert got == {x: min(p) for p in parts for x in p}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_compare_by_product_and_by_pair_agree():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), rng.integers(0, 2**63, 5).astype(np.uint64)])) for _ in range(80)]
    h = np.ones((80, 2), np.uint64)
    i, j = near_dup.compare(sets, None, h, h, -1, 0.8)
    want = [(a, b) for a in range(80) for b in range(a + 1, 80) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9]
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("limit", [1 << 24, 0])  # broadcast, and the shuffle join beyond the limit
def test_decontamination(spark, limit):
    item = " ".join(f"b{i}" for i in range(20))
    rows = [(0, "x " * 50 + item + " y" * 50), (1, "B3 b4"), (2, None), (3, ""), (4, "b3, b4 z"), (5, "x b0 b1 b2"), (None, item), (6, " ".join(item.split()[:12]))]
    bench = spark.createDataFrame([(1, item), (2, "b3 b4"), (3, None), (4, "!"), (2, "b3 b4")], "item_id long, text string")
    d = docs(spark, rows).withColumn("key", decontaminate.F.struct("doc_id", decontaminate.F.xxhash64("text").alias("h")))
    got = {r.key.doc_id: r for r in decontaminate.contamination(d.select("key", "text"), bench, limit=limit).collect()}
    hit = {k: (r.n_words, r.n_hit, r.n_items, r.contaminated) for k, r in got.items()}
    assert hit == {0: (120, 20, 2, True), 1: (2, 2, 1, True), 2: (0, 0, 0, False), 3: (0, 0, 0, False), 4: (3, 2, 1, True), 5: (4, 0, 0, False), None: (20, 20, 2, True), 6: (12, 2, 1, True)}
    assert got[0].items_sha256 == hashlib.sha256(b"1,2").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    kept = decontaminate.keep_clean(docs(spark, rows).withColumn("KEY_bad", decontaminate.F.lit(1)), bench)
    assert sorted(tuple(r) for r in kept.collect()) == [(i, t, "en", "s", len(t or ""), "clash", 1, 1) for i, t in rows if i in (2, 3, 5)]
    assert decontaminate.contamination(d.select("key", "text").limit(0), bench).count() == 0
    assert decontaminate.contamination(d.select("key", "text"), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_warc_round_trip_and_index(spark):
    rows = [(1, "http://a.com/x", "hi"), (2, "http://a.com/x", "hi"), (3, None, None), (4, "b", ""), (None, "c", "hi"), (5, "http://A.com:80/y?b=2&a=1", "ü\r\n\r\n"), (5, "q\nr", "ü\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    blocks = warc.write_archives(pages)
    merged = warc.merge_index(blocks, per_range=2)
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.url) for r in warc.read_archives(blocks, merged).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 2, "http://a.com/x"), (2, "response", None, 2, "http://a.com/x"), (3, "revisit", 4, 0, None), (4, "response", None, 0, "b"), (-1, "response", None, 2, "c"), (5, "response", None, 6, "http://A.com:80/y?b=2&a=1"), (5, "response", None, 6, "q\nr")], key=str)
    index = merged.orderBy("range", "seq").collect()
    assert len(index) == 7 and [(r.urlkey, r.ts) for r in index] == sorted((r.urlkey, r.ts) for r in index)
    assert warc.read_archives(blocks, merged.filter("page_id = 2")).count() == 1
    none = warc.write_archives(pages.limit(0))
    assert warc.read_archives(none, warc.merge_index(none)).count() == 0
    raw = warc.record(1, "u", b"abc", "D", None, "t")
    assert warc.parse(b"xy" + raw + raw, 2, len(raw))[1:] == (b"abc", len(raw))
    for data, size in ((raw[:-3], None), (raw + raw, len(raw) + 1), (raw, len(raw) - 1)):
        with pytest.raises(ValueError):
            warc.parse(data, 0, size)


def test_warc_urls_and_export(spark, tmp_path):
    import gzip

    urls = [None, "", "-", " a", "a b%20c", "a\r\nX: y", "http://x.com/%41", "ü"]
    blocks = warc.write_archives(spark.createDataFrame([(i, u, "x" * i) for i, u in enumerate(urls)], "page_id long, url string, html string"))
    assert {r.page_id: r.url for r in warc.read_archives(blocks, warc.merge_index(blocks)).collect()} == dict(enumerate(urls))
    raw = b"".join(gzip.open(f).read() for f in warc.export(blocks, str(tmp_path)))
    assert raw.count(b"WARC/1.1") == len(urls) and b"WARC-Target-URI: http://x.com/%41\r\n" in raw and b"\r\nX: y" not in raw


def test_loser_tree():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted(({"urlkey": str(rng.randrange(9)), "ts": "", "page_id": rng.randrange(99), "archive": a, "block": 0, "offset": i} for i in range(rng.randrange(6))), key=warc.entry_key) for a in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []), key=warc.entry_key)


STRANGE = ["a  b", " x", "x ", "a   b\n\n c", "a \n b", "it's 'll ² x½y", "日本 語 a", "\x1c a\x1cb", "a  b", "<|endoftext|> hi", " 's", "a 's", "१२ 3", "\n a", "  x", "_a _ b__c 3d", "", " ", "é 👍🏽 ok"]


def test_token_ids_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_ids.default_tokenizer())
    e = token_ids.Encoder(token_ids.default_tokenizer(), words=60, parts=50)
    want = lambda t: [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(t, add_special_tokens=False)]
    t = STRANGE + [x or "" for x in texts()]
    assert e.encode(t) == want(t) == e.encode(t)
    assert e.encode(["a<|endoftext|>"])[0][-4:] == np.array([50256], "<u4").tobytes()
    assert len(token_ids.Encoder(token_ids.default_tokenizer(), special=False).encode(["<|endoftext|>"])[0]) == 28
    r = random.Random(3)
    marks = ["abc", "Zé", "ña", "×", "÷", "ɏ", "»", "ª", ".", ",", ";", "'s", " ", " x", "\n", "\nQ", "9", "_"]
    t = ["".join(r.choice(marks) for _ in range(r.randrange(30))) for _ in range(3000)]
    assert e.encode(t) == want(t)


def test_packing_counts_and_files(spark):
    t = texts() + STRANGE + [None]
    d = docs(spark, enumerate(t)).repartition(3)
    e = token_ids.encoder(token_ids.default_tokenizer())
    ids = [np.frombuffer(x, "<u4") for x in e.whole([x or "" for x in t])]
    pieces = packing.pack(d, length=100).collect()
    for p in pieces:
        assert p.ids == np.append(ids[p.doc_id], 1).astype("<u4")[p.start : p.start + p.length].tobytes()
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for x in ids)
    whole = packing.sequences(packing.pack(d, length=100), 100).collect()
    assert {len(r.ids) for r in whole} == {400} and sum(r.n_tokens < 100 for r in whole) <= 1
    n = np.array([len(x) for x in ids])
    limits = token_counts.limits(token_counts.histogram(d))
    for r in limits.collect():
        assert (r.n_docs, r.docs_over, r.truncated_total) == ((n == r.length).sum(), (n > r.length).sum(), np.minimum(n, r.length).sum())
    assert token_counts.truncated_total(limits, 33) == np.minimum(n, 33).sum()
    at = 0
    for r in sorted(token_file.read_segments(token_file.write_ids(d)).collect(), key=lambda r: r.doc_id):
        x = np.append(ids[r.doc_id], 2).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert token_file.read_segments(token_file.write_ids(d.limit(0))).count() == packing.pack(d.limit(0)).count() == token_counts.limits(token_counts.histogram(d.limit(0))).count() == 0


def coder(spark):
    from gridloom.llm import id_coder, jvm

    return jvm.register(spark, id_coder.SOURCE, id_coder.FUNCTIONS)


def segment_of(spark, x, block=4096):
    head = token_file.head([7, None], [len(x) // 2, len(x) - len(x) // 2], 11)
    df = spark.createDataFrame([(0, 0, bytearray(head), bytearray(np.asarray(x, "<u4").tobytes()))], "part int, segment int, head binary, ids binary")
    return df.selectExpr("part", "segment", f"concat(head, {coder(spark)['gridloom_encode_ids']}(ids, {block})) as data").head().data


def test_coder_round_trip_and_damage(spark):
    rng = np.random.default_rng(0)
    for x in (np.zeros(0), [5], rng.integers(0, 50257, 9000), np.full(5000, 131071), np.zeros(4096), rng.zipf(1.3, 9000) % 50000):
        raw = segment_of(spark, x)
        back = token_file.read_ids(spark.createDataFrame([(0, 0, raw)], "part int, segment int, data binary")).head().ids
        assert bytes(back) == np.asarray(x, "<u4").tobytes()
    raw = bytearray(segment_of(spark, np.arange(100)))
    rows = token_file.read_segments(spark.createDataFrame([(0, 0, raw)], "part int, segment int, data binary")).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == [(d, 50, zlib.crc32(np.arange(a, a + 50, dtype="<u4").tobytes())) for d, a in (("7", 0), ("None", 50))]
    for at in (2, 30, len(raw) - 20):
        bad = bytearray(raw)
        bad[at] ^= 255
        with pytest.raises(Exception, match="damaged|no segment"):
            token_file.read_ids(spark.createDataFrame([(0, 0, bad)], "part int, segment int, data binary")).collect()
    with pytest.raises(Exception, match="17 bits"):
        segment_of(spark, [1 << 17])


def test_coder_comes_near_the_entropy_or_below(spark):
    rng = np.random.default_rng(1)
    zipf = np.minimum(rng.zipf(1.3, 60_000), 50_000)
    steps = np.repeat(rng.integers(0, 50_000, (1, 500)), 120, 0).ravel()  # a passage again and again
    for x, more in ((zipf, 0.6), (steps, -6.0)):
        p = np.bincount(x)[np.unique(x)] / len(x)
        assert 8 * len(segment_of(spark, x, 65536)) / len(x) < -(p * np.log2(p)).sum() + more


def test_coder_ranks_ids_by_how_often_they_are_met(spark):
    """Few decisions an id: its rank's bin is coded, and the segment lists the ids met twice or more."""
    rng = np.random.default_rng(2)
    x = rng.permutation(1 << 17)[np.minimum(rng.zipf(1.3, 200_000), 1 << 17) - 1]
    p = np.bincount(x)[np.unique(x)] / len(x)
    raw = bytearray(segment_of(spark, x, 65536))
    assert 8 * len(raw) / len(x) < -(p * np.log2(p)).sum() + 0.6
    back = token_file.read_ids(spark.createDataFrame([(0, 0, raw)], "part int, segment int, data binary")).head().ids
    assert bytes(back) == x.astype("<u4").tobytes()
    code = 28 + 12 * 2
    listed, table = np.frombuffer(bytes(raw[code + 8 : code + 16]), "<i4")
    assert listed == (np.bincount(x) > 1).sum() and table < 4 * listed
    for at in (code + 8, code + 16 + 12 * 4 + table // 2, len(raw) - 2000):  # the list's length, the list, a block's plain bits
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(Exception, match="damaged|cut off"):
            token_file.read_ids(spark.createDataFrame([(0, 0, bad)], "part int, segment int, data binary")).collect()



def best_then_sides(x, a, b):
    """Maximal segments by definition: the best one, then those on its sides."""
    c = np.concatenate([[0], np.cumsum(x)])
    top = max(((c[j] - c[i], -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
    if top[0] <= 1e-12:
        return []
    i, j = -top[1], top[2]
    return best_then_sides(x, a, i) + [(i, j)] + best_then_sides(x, j, b)


def test_segments_are_maximal():
    import time

    assert toxicity.segments(np.array([-1.0, -2])) == [] == toxicity.segments(np.zeros(0))
    assert toxicity.segments(np.array([4.0, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5])) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = np.round(rng.normal(-0.1, 1, rng.integers(1, 30)), 3)
        assert [s[:2] for s in toxicity.segments(x)] == best_then_sides(x, 0, len(x))
    start = time.process_time()
    assert len(toxicity.segments(np.where(np.arange(2_000_000) % 2 == 0, 1.0, -1.1))) == 1_000_000
    assert time.process_time() - start < 30  # hours if every run looked back at all before it


def test_toxicity_separates(spark):
    rng = random.Random(0)
    base = lambda: " ".join(rng.choice("the of and to in is was that for on".split()) for _ in range(60))
    m = toxicity.fit([base() + " vile brute scum rotten" for _ in range(60)], [base() for _ in range(60)])
    d = docs(spark, [(0, base()), (1, base() + " vile scum brute"), (2, None), (3, ""), (None, "!")])
    got = {r.doc_id: r for r in toxicity.score_documents(d, m).collect()}
    assert got[1].score > 0.7 > got[0].score and got[2].score == got[3].score and len(got[1].passages) == 1
    assert toxicity.fit([], ["x"]).share == 0.0 and toxicity.fit([], []).share == 0.0


def test_forward_backward_equals_plain_recursion():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(3, 3))
    at = np.array([0, 1, 1, 150, 214, 300])
    e = rng.normal(size=(300, 3))
    got = language.marginals(e, at, trans)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b == a:
            continue
        f, g = np.zeros((b - a, 3)), np.ones((b - a, 3))
        start = np.ones(3) / 3 @ np.exp(trans - trans.max())
        for i in range(b - a):
            f[i] = (start if i == 0 else f[i - 1] @ np.exp(trans)) * np.exp(e[a + i])
            f[i] /= f[i].sum()
        for i in range(b - a - 2, -1, -1):
            g[i] = np.exp(trans) @ (np.exp(e[a + i + 1]) * g[i + 1])
            g[i] /= g[i].sum()
        p = f * g
        assert np.allclose(got[a:b], p / p.sum(1, keepdims=True))


def test_language(spark):
    en, de = "the house and the garden with some water", "das haus und der garten mit etwas wasser"
    m = language.fit(["de", "en"], [("en", en * 3), ("de", de * 3)] * 5, chains=256)
    d = docs(spark, [(0, en), (1, de), (2, None), (3, "123 !"), (4, ""), (5, (en + " ") * 500)])
    got = {r.doc_id: r.lang_pred for r in language.predict(d, m).collect()}
    assert got == {0: "en", 1: "de", 2: "und", 3: "und", 4: "und", 5: "en"}
    marks = [w[1] for w in language.label_words(m, f"{en} {de}")]
    assert marks[0] == "en" and marks[-1] == "de"


def test_cover_tree():
    rng = np.random.default_rng(0)
    far = np.repeat(rng.normal(size=(60, 16)), 50, 0) + 0.01 * rng.normal(size=(3000, 16))
    x = np.floor(1024 * np.concatenate([far, far[:5]]))
    t = topk.Tree(x)
    assert sorted(t.order) == list(range(len(x)))
    for i, kids in enumerate(t.kids):
        own = t.order[t.lo[i] : t.hi[i]]
        d = np.sqrt(((x[own] - x[t.centre[i]]) ** 2).sum(1))
        assert t.centre[i] in own and d.max() <= min(t.radius[i], 2.0 ** t.level[i] if d.max() else 0)
        if len(kids):
            c = x[[t.centre[k] for k in kids]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.where(np.eye(len(c)), np.inf, 0)
            assert t.centre[i] in [t.centre[k] for k in kids] and apart.min() > 2.0 ** (t.level[i] - 1)
            assert all(np.sqrt(((x[t.order[t.lo[k] : t.hi[k]]] - x[t.centre[k]]) ** 2).sum(1)).max() <= 2.0 ** (t.level[i] - 1) for k in kids)
    ids = np.arange(len(x))
    best = topk.Best(ids[::50], 5)
    met = topk.search(topk.Tree(x[::50], topk.FEW), t, ids, best)
    s = x[::50] @ x.T
    s[np.arange(len(s)), ids[::50]] = -np.inf
    assert (best.vec == np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]).all()
    assert met < 0.4 * s.size


def test_top_k_of_large_and_odd_vectors(spark):
    big = [(0, [2e7, 1.0, 3.0]), (50, [1e4, -2.5, 1e9]), (1, [-2e7, 1.5, 0.25]), (2, [1e9, 1e9, 1e9]), (3, [1e17, 0.0, 0.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (100, [0.5, 0.5]), (5, [])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, df.filter("vec_id % 50 = 0")).collect()
    ints = [(i, [math.floor(1024 * v) for v in x]) for i, x in big]
    for q, x in ints:
        if q % 50 == 0:
            want = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=True)))), j) for j, y in ints if j != q and len(x) == len(y) > 0)
            assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, block):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[7], v[9] = v[8], v[8]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(900, None, 0), (1000, [1.0, None], 0), (1100, [float("nan")] * 8, 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.exact_top_k(df, df.filter("vec_id % 50 = 0"), block=block, tree=100 * block).collect()
    q = np.floor(1024 * v.astype(float))
    for i in range(0, 400, 50):
        want = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want
    assert len(got) == 80 and topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    """Squares, and products, beyond doubles; a score beyond 64 bits is the nearest number of 64 bits."""
    rng = random.Random(3)
    v = [[rng.choice([-1, 1]) * 10.0 ** rng.choice([0, 6, 12, 160, 300]) for _ in range(4)] for _ in range(150)]
    df = spark.createDataFrame([*enumerate(v), (900, [1e306] * 4)], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, df.filter("vec_id % 50 = 0"), tree=60).collect()
    q = [[math.floor(1024 * x) for x in r] for r in v]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    for i in (0, 50, 100):
        want = sorted((-dot(q[i], q[j]), j) for j in range(150) if j != i)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want


def frame(role, text):
    esc = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
    return "<|im_start|>" + esc(role).replace("\n", "\\n") + "\n" + esc(text) + "<|im_end|>\n"


@pytest.mark.parametrize("budget, history, system", [(900, 200, 20), (900, 200, 600), (900, 200, 2000), (400, 0, 20)])
def test_chat_windows(spark, budget, history, system):
    rng = random.Random(0)
    odd = ["<|im_end|>", "a\\|b\\", "<", "\\n", "", None, "<|im_start|>user\nx", "x\n"]
    rows = [(1, 0, "system", ("be kind <|im_end|>" * 200)[:system])]
    rows += [(1, t, rng.choice(["user", "assistant", "us\ner\\", None]), rng.choice(odd) or "word " * rng.randrange(80)) for t in range(1, 80)]
    rows += [(2, 0, "assistant", "long " * 900), (None, None, "user", "n"), (None, 1, "assistant", "m"), (3, 0, "system", "only"), (4, 5, "user", "same"), (4, 5, "user", "same")]
    rows += [(5, None, "user", f"é{i}") for i in range(60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")
    w = chat.read_turns(chat.format_windows(df, budget=budget, history=history)).collect()
    by = {}
    for r in sorted(w, key=lambda r: (str(r.conv_id), r.window_id)):
        by.setdefault(r.conv_id, []).append(r)
        assert r.n_tokens == len(r.text.encode()) and r.text.count("<|im_start|>") == r.n_turns
        assert r.n_tokens <= budget or (r.n_turns - r.n_context == 1 and r.n_context <= 1)
    for c, got in by.items():
        want = sorted((t if t is not None else -1, role or "", text or "") for i, t, role, text in rows if i == c)
        assert [(x.role, x.text) for r in got for x in r.turns] == [x[1:] for x in want]
        assert "".join(r.loss for r in got) == "".join(x[2] for x in want if x[1] == "assistant")
        size = [len(frame(*x[1:]).encode()) for x in want]
        lead = want[0][1] == "system"
        at = np.cumsum([0, *(0 if lead and i == 0 else n for i, n in enumerate(size))])
        for r in got:  # the system turn, then all turns that start within the room for history
            k = r.window_id
            own = sum(n for i, n in enumerate(size[k : k + r.n_turns - r.n_context], k) if i or not lead)
            room = max(0, min(history, budget - (size[0] if lead else 0) - own))
            past = [i for i in range(lead, k) if at[k] - at[i] <= room]
            assert r.text == "".join(frame(*want[i][1:]) for i in ([0] if lead and k else []) + past + list(range(k, k + r.n_turns - r.n_context)))
    assert chat.format_windows(df.limit(0)).count() == 0


def test_op10_digests(spark, tmp_path):
    rows = [(7, 1, "user", "hi <|im_end|>"), (7, 2, "assistant", "ü\\"), (7, 3, None, None), (-1, 0, "user", "own")] + [(9, i, "assistant", "x" * 3000) for i in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    mark = "<|im_end|><|im_start|>assistant ok"
    want = []
    for turns in ([("user", "hi <|im_end|>"), ("assistant", "ü\\"), ("", "")], [("user", "own")], [("assistant", "x" * 3000)] * 9, [("user", mark), ("assistant", mark)]):
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = chat.op10_chat_formatting(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[1:5] for r in got) == sorted(want) and sorted(r.conv_id for r in got) == [-1, -1, 7, 9]
    assert next(r.formatted_chars for r in got if r.conv_id == 7) == sum(len(frame(*t)) for t in (("user", "hi <|im_end|>"), ("assistant", "ü\\"), ("", "")))


def test_words_of_long_and_broken_texts():
    import pyarrow as pa

    big = "aB3é " * 200_000
    h, at = W.words(pa.array([big, None, "x" * 600_000, "AB3É".lower().replace("é", "é"), "ab3é"]))
    assert np.diff(at).tolist() == [200_000, 0, 1, 1, 1] and len(set(h[:200_000])) == 1 and h[-1] == h[0]
