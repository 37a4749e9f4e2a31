"""Every query with SQL gives the rows of that SQL in DuckDB."""

import duckdb
import pytest

from gridloom import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()
SLOW = {n for n in Q.queries() if "pack" in n or "dither" in n or "diffusion" in n}


def plain(v):
    if v is None or v is not None and v != v:
        return None
    if isinstance(v, str):
        return v
    return int(v) if float(v) == int(v) else round(float(v), 5)


@pytest.mark.parametrize("name", sorted(set(Q.oracle_sql()) - SLOW) + ["auto_pack", "fidelity_pack", "error_diffusion_floyd", "ordered_dither_bayer4"])
def test_query(spark, name):
    got = Q.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    cur = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    rows = lambda rs: sorted(repr([plain(v) for v in r]) for r in rs)
    assert rows(got.select(*cols).collect()) == rows(cur.fetchall())
