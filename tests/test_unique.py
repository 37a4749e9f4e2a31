"""Names made unique for all rows at once, against the row by row definition."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.names import unique_name
from gridloom.operators import unique as U


def one_by_one(rows):
    """Names of (folder, short) in order."""
    taken, last, out = {}, {}, []
    for f, s in rows:
        t = taken.setdefault(f, set())
        out.append(None if s is None else unique_name(s, t, last.setdefault(f, {})))
        t.add(out[-1])
    return out


def check(spark, rows, small=U.SMALL):
    d = spark.createDataFrame([(i, f, s) for i, (f, s) in enumerate(rows)], "i long, folder string, short string").repartition(5)
    got = {r.i: r.unique_name for r in U.unique_names(d, ["folder"], "short", ["i"], small=small).collect()}
    assert [got[i] for i in range(len(rows))] == one_by_one(rows)


def test_folders_of_many_shapes(spark):
    """Groups of over 30 rows in rounds, others in a task each; then all in a task each."""
    rng = random.Random(1)
    rows = [(None, "A"), ("", "A"), (None, "A"), ("", None), ("", None), ("", "A")]
    rows += [("same beginnings", "CHARGE" + rng.choice(["R1", "RS", "D"])) for _ in range(60)]
    rows += [("counters in names", rng.choice(["IMG", "IMG01", "IMG0101", "IMG99"])) for _ in range(40)]
    rows += [("full pool", f"PHOTO0{i:02d}") for i in range(100)] + [("full pool", "PHOTO0AB") for _ in range(10)]
    rows += [("camera", f"DSC{rng.randrange(20):05d}") for _ in range(28)]
    rows += [("mixed", "".join(rng.choice("A0_") for _ in range(rng.randint(1, 8)))) for _ in range(60)]
    rows = rows[:6] + sorted(rows[6:], key=lambda r: (r[0] == "full pool" and r[1] == "PHOTO0AB", r[1]))
    check(spark, rows, 30)
    rng.shuffle(rows)
    check(spark, rows)


def test_a_hot_name_is_many_tasks(spark, monkeypatch):
    rows = [("hot", "IMG05" if i % 9000 == 7 else "IMG") for i in range(20_000)]
    shares = []
    wanted = U._wanted

    def seen(s):
        if not shares:
            shares.append(max(r["count"] for r in s.repartitionByRange(4, *U.GROUP, "at").groupBy(F.spark_partition_id()).count().collect()) / s.count())
        return wanted(s)

    monkeypatch.setattr(U, "_wanted", seen)
    check(spark, rows, 1000)
    assert max(shares) < 0.4  # of four ranges


def test_empty_and_full(spark, monkeypatch):
    d = spark.createDataFrame([], "i long, short string, at string, low string, name string, f string")
    got = U.unique_names(d, [], "short", ["i"], "new")
    assert got.columns == [*d.columns, "new"] and got.count() == 0
    full = spark.createDataFrame([(i, "ABC", "x", "y", "z", "w") for i in range(1000)], d.schema)
    monkeypatch.setattr(U, "LENGTH", 3)  # ABC, A01 to A99; no place for a third digit
    with pytest.raises(ValueError):
        U.unique_names(full, [], "short", ["i"], "new", 10)
    some = U.unique_names(full.limit(100), [], "short", ["i"], "new", 10)
    assert sorted(r.new for r in some.collect()) == sorted(["ABC", *[f"A{i:02d}" for i in range(1, 100)]])
    assert {(r.at, r.low, r.name, r.f) for r in some.collect()} == {("x", "y", "z", "w")}
