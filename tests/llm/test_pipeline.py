"""Each stage of the pipeline against a plain version, and the queries with SQL against it."""

import zlib

import duckdb
import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from gridloom.llm import decontaminate, language, near_dup, packing, queries, toxicity  # noqa: E402
from gridloom.llm import token_ids  # noqa: E402
from gridloom.llm.common import least_by_hash  # noqa: E402

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long"
EN = "the house and the garden with some water and a very long way to go home "
DE = "das haus und der garten mit etwas wasser und ein sehr langer weg nach hause "


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", None, "clash", 1) for i, t in rows], DOCS)


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    got = queries.queries()[name](spark, DIR)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == sorted(map(repr, cur.fetchall()))


def test_language_stage(spark):
    m = language.fit(["de", "en"], [("en", EN * 3), ("de", DE * 3)] * 5, chains=256)
    data = [(1, EN), (1, EN), (2, DE * 400), (None, DE), (3, None), (4, ""), (5, "12 !"), (6, "é")]
    d = frame(spark, data)
    kept = language.filter_rows(d, spark.sparkContext.broadcast(m), 0.5)
    label = {i: language.label(m, [t]) for i, (_, t) in enumerate(data)}
    assert kept.columns == d.columns
    assert rows(kept) == sorted(((i, t) for k, (i, t) in enumerate(data) if label[k][0][0] != "und" and label[k][1][0] >= 0.5), key=str)
    assert {(3, None), (4, ""), (5, "12 !")}.isdisjoint(rows(kept)) and (1, EN) in rows(kept)
    assert language.filter_rows(d.limit(0), spark.sparkContext.broadcast(m), 0.5).count() == 0
    mixed = frame(spark, [(1, "".join(x + y for x, y in zip(EN.split(), DE.split(), strict=False))), (2, EN + DE), (3, "7 ?")])
    assert [i for i, _ in rows(language.filter_rows(mixed, spark.sparkContext.broadcast(m), 0.0))] == [1, 2]


def test_least_by_hash(spark):
    data = [(i % 7 == 0, i, i % 3) for i in range(-400, 400)] * 2 + [(True, 9, 5), (True, 9, 4), (None, 3, 1)]
    d = spark.createDataFrame(data, "y boolean, doc_id long, h long")
    key = {r.doc_id: r.x for r in d.selectExpr("doc_id", "xxhash64(doc_id) as x").collect()}
    for k in (1, 30, 1000):
        want = []
        for y in (False, True):
            own = sorted({r for r in data if r[0] is y}, key=lambda r: (key[r[1]], r[1], r[2]))
            want += [(*r, n) for n, r in enumerate(own[:k], 1)]
        assert sorted(map(tuple, least_by_hash(d.filter("y is not null"), "y", k).collect())) == sorted(want)
    assert least_by_hash(d.limit(0), "y", 5).count() == 0


def test_language_training_is_repeatable_and_whole(spark):
    data = [(i, f"w{i} " * 5, f"l{i % 70}") for i in range(280)] + [(0, "w0 " * 5, "l0")] * 3 + [(None, "x", "l1"), (999, None, "l1"), (998, "y", None)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    m = language.train(d)
    assert len(m.langs) == 70  # no language is left out
    again = language.train(d.repartition(3))
    assert again.langs == m.langs and (again.table == m.table).all()
    assert language.train(d.limit(0)).langs == []


def test_toxicity_stage(spark):
    import random

    rng = random.Random(0)
    base = lambda: " ".join(rng.choice("the of and to in is was that for on".split()) for _ in range(60))
    texts = [(i, base() + (" vile brute scum rotten" if i % 2 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts] + [(0, 0), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.train(frame(spark, texts), labels)
    assert len(m.keys) == len(toxicity.train(frame(spark, texts[::-1]).repartition(3), labels).keys) > 0
    data = [*texts[:6], texts[1], (None, texts[3][1]), (900, None), (901, ""), (902, base() * 300)]
    d = frame(spark, data)
    kept = toxicity.filter_rows(d, spark.sparkContext.broadcast(m), 0.7)
    score = {(r.doc_id, r.n): r.score for r in toxicity.score_documents(d, m).selectExpr("doc_id", "score", "0 as n").collect()}
    assert rows(kept) == sorted(((i, t) for i, t in data if score[i, 0] < 0.7), key=str)
    assert (1, texts[1][1]) not in rows(kept) and (0, texts[0][1]) in rows(kept) and (900, None) in rows(kept)
    none = toxicity.train(frame(spark, []), labels)
    assert toxicity.filter_rows(d.limit(0), spark.sparkContext.broadcast(none), 0.7).count() == 0


def test_near_duplicate_stage(spark):
    words = [f"v{i}" for i in range(100)]
    near = " ".join(words[:99] + ["other"])
    data = [(5, " ".join(words)), (3, near), (9, " ".join(words).upper()), (7, "lone text of its own here"), (None, near), (11, None), (12, ""), (12, ""), (4, "one text"), (4, "other text")]
    kept = rows(near_dup.keep_one(frame(spark, data)))
    assert [i for i, _ in kept].count(3) == 1 and {5, 9}.isdisjoint(i for i, _ in kept)
    assert {(7, "lone text of its own here"), (11, None), (12, ""), (4, "one text"), (4, "other text"), (None, near)} <= set(kept)
    assert near_dup.keep_one(frame(spark, [])).count() == 0


def test_near_duplicates_are_found_at_the_threshold(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(200):  # pairs with a similarity from 0.8 to 0.85
        w = [f"x{v}" for v in rng.integers(0, 10**6, 500)]
        v = w.copy()
        v[: int(rng.integers(36, 50))] = [f"y{v}" for v in rng.integers(0, 10**6, 1)] * 1
        data += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t in data}
    alike = [i for i in range(0, 400, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, data)).collect()}
    assert len(alike) > 150 and sum(got[i + 1] == i for i in alike) >= 0.99 * len(alike)


def test_decontamination_stage(spark):
    item = " ".join(f"b{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    data = [(1, "a " * 500 + item), (2, item), (2, item), (3, "a " * 700 + item), (None, item + " x"), (4, None), (5, "")]
    kept = rows(decontaminate.keep_clean(frame(spark, data), bench))
    assert kept == sorted([data[3], (4, None), (5, "")], key=str)  # 30 of 730 words are under a twentieth


def test_packing_stage(spark):
    data = [(3, "some words, more"), (3, "some words, more"), (None, "x <|endoftext|> y"), (4, None), (5, "é " * 4000)]
    got = packing.piece_rows(frame(spark, data).repartition(2)).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_ids.default_tokenizer())
    ids = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in data]
    assert sum(r.length for r in got) == sum(map(len, ids)) and sum(r.start == 0 for r in got) == len(data)
    want = {(i, len(x)): x for (i, _), x in zip(data, ids, strict=True)}
    for r in got:
        assert zlib.crc32(want[r.doc_id, r.doc_tokens][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[:2] == ((a[0], a[1] + a[2]) if a[1] + a[2] < 2048 else (a[0] + 1, 0)) for a, b in zip(places, places[1:], strict=False))


def test_languages_are_packed_apart(spark, tmp_path):
    """The language that the first stage finds decides which sequence a text goes to."""
    docs = [(i, (EN, DE)[i % 2] * (3 + i % 40), ("en", "de")[i % 2], "s", 1, 1) for i in range(200)]
    d = written(spark, tmp_path / "a", docs, [])
    known = language.keep_known(spark, spark.read.parquet(f"{d}/documents.parquet").repartition(3), d)
    assert known.columns[-1] == "lang_pred"
    lang = {r.doc_id: r.lang_pred for r in known.collect()}
    assert lang == {i: l for i, _, l, *_ in docs}
    got = corpus_pipeline.pack(spark, known, d).collect()
    of = {}
    for r in got:
        of.setdefault(r.sequence_id, set()).add(lang[r.doc_id])
    assert len(of) > 4 and all(len(x) == 1 for x in of.values()) and set().union(*of.values()) == {"de", "en"}
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    cuts = [(a, b) for a, b in zip(places, places[1:], strict=False) if b[:2] != ((a[0], a[1] + a[2]) if a[1] + a[2] < 2048 else (a[0] + 1, 0))]
    assert [b[:2] == (a[0] + 1, 0) for a, b in cuts] == [True]  # one border, between the languages
    sizes = {}
    for r in got:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert len(sizes) == 200 and all(sizes[r.doc_id] == r.doc_tokens for r in got)


def test_pipeline_runs_whole(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "decontamination", "packing"]
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 100


def written(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, h long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_op5_query_learns_only_from_its_rows(spark, tmp_path):
    """Columns by plain Python; labels, languages and sources of held-out rows change nothing."""
    import random

    rng = random.Random(1)
    base = {l: [f"{l}{rng.randrange(10**4)}" for _ in range(80)] for l in ("alpha", "beta")}
    bad = {"alpha": [f"vile{i}" for i in range(5)], "beta": [f"schurk{i}" for i in range(5)]}
    docs, labels = [], []
    for i in range(900):
        l, toxic = ("beta" if i % 4 == 0 else "alpha"), int(rng.random() < 0.12)
        w = [rng.choice(base[l]) for _ in range(rng.choice([5, 40, 200]))]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad[l]))
        docs.append((i, " ".join(w), l, "s", 1, 1))
        labels.append((i, 1, toxic))
    truth = dict((i, y) for i, _, y in labels)
    docs += [(2000, None, "alpha", None, None, 1), (2001, "", None, "s", 0, 1), (None, docs[0][1], None, "s", 1, 1), docs[3], (2002, docs[1][1] + " word" * 60_000, "alpha", "s", 1, 1)]
    out = lambda r: zlib.crc32(str(r).encode()) % 3 == 1 if r is not None else False
    got = toxicity.op5_toxicity(spark, written(spark, tmp_path / "a", docs, [*labels, (None, 1, 1), (5000, 1, 1), (2001, 0, None)])).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d[0] for d in docs), key=repr)
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    for l in ("alpha", "beta"):
        hard = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth and docs[r.doc_id][2] == l]
        assert sum(y and p for y, p in hard) >= 0.8 * sum(y for y, _ in hard) > 0
        assert sum(p and not y for y, p in hard) <= 0.05 * len(hard)
    other = [(i, 1 - q, 1 - y if out(i) else y) for i, q, y in labels]
    again = toxicity.op5_toxicity(spark, written(spark, tmp_path / "b", [(i, t, "x", "y", 7, 2) for i, t, *_ in docs], other)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_op6_query_learns_only_from_its_rows(spark, tmp_path):
    import random

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice((EN, DE)[i % 2].split()) for _ in range(rng.choice([3, 30, 300]))), ("en", "de")[i % 2], "s", 1, 1) for i in range(400)]
    docs += [(900, None, "en", "s", 1, 1), (901, "12 ?!", "de", "s", 1, 1), (902, "", None, None, 0, 1), (None, EN, None, "s", 1, 1), docs[7], (903, DE * 4000, None, "s", 1, 1)]
    out = lambda r: zlib.crc32(str(r).encode()) % 5 == 0 if r is not None else False
    got = language.op6_language_id(spark, written(spark, tmp_path / "a", docs, [])).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((d[0] for d in docs), key=repr)
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    assert {i for i, l in pred.items() if l == "und"} == {900, 901, 902} and pred[903] == "de" and pred[None] == "en"
    assert all(pred[i] == l for i, _, l, *_ in docs[:400] if out(i))
    other = [(i, t, {"en": "de", "de": "en", None: "en"}[l] if out(i) else l, "z", 2, 3) for i, t, l, *_ in docs]
    again = language.op6_language_id(spark, written(spark, tmp_path / "b", other, [])).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_queries_and_pipeline_of_empty_tables(spark, tmp_path):
    d = written(spark, tmp_path / "e", [], [])
    assert toxicity.op5_toxicity(spark, d).count() == language.op6_language_id(spark, d).count() == 0
    assert queries.queries()["op8_token_counts"](spark, d).count() == 0
    assert corpus_pipeline.run(spark, d).count() == 0
