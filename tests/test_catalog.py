"""Names and records at their limits."""

from pyspark.sql import functions as F

from gridloom.functions import names as N
from gridloom.operators.order import numbered
from gridloom.plans import catalog


def test_many_equal_names(spark, tmp_path):
    urls = [f"http://{'a' if i % 5 else 'b'}.com/" + ("" if i % 7 else ["IMG05", "I", "charger12", "charger13", "9x"][i % 5]) for i in range(20_000)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.unique_name for r in catalog.unique_names(spark, str(tmp_path)).collect()}
    assert len(got) == len(urls) and len({(u[7], got[i]) for i, u in enumerate(urls)}) == len(urls)
    taken = {"a": set(), "b": set()}
    for i, u in enumerate(urls[:1500]):
        s = u.rpartition("/")[2].upper()
        want = N.unique_name(("I" + s if s[:1].isdigit() else s)[:8] or "IMG", taken[u[7]])
        taken[u[7]].add(want)
        assert got[i] == want


def test_long_text_is_rejected_whole(spark, tmp_path):
    word = "x" * 57
    spark.createDataFrame([(1, " ".join([word] * 127)), (2, " ".join([word] * 128)), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: tuple(r[1:]) for r in catalog.nfo_roundtrip(spark, str(tmp_path)).collect()}
    assert got == {1: (127, 128 * 160, True, False), 2: (128, 0, False, True), 3: (0, 160, True, False)}


def test_positions_without_a_task_of_all_rows(spark):
    rows = [(i * 7919 % 10_007, "abc"[i % 3]) for i in range(10_007)] + [(None, "a"), (-5, None)]
    d = spark.createDataFrame(rows, "v long, letter string")
    for by in (["v"], [F.desc("v")], ["letter", F.desc("v")], [F.col("v") % 5, "v"]):
        want = [tuple(r) for r in d.orderBy(*by).collect()]
        for n in (1, 7):
            got = numbered(d, by, "place", n)
            assert "SinglePartition" not in got._jdf.queryExecution().toString()
            assert [tuple(r) for r in got.orderBy("place").select("v", "letter").collect()] == want
            assert [r.place for r in got.orderBy("place").collect()] == list(range(1, len(rows) + 1))
    same = spark.createDataFrame([(1,)] * 500, "v long")  # one value for all rows
    assert sorted(r.position for r in numbered(same, ["v"]).collect()) == list(range(1, 501))
    assert numbered(d.limit(0), ["v"]).count() == 0
