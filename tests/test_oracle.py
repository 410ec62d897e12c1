"""Every query against its DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"

from proselab import queries as library  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_same_rows(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    r = duck.execute(library.SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(cols)
    theirs = sorted(repr([plain(row[cols.index(c)]) for c in sorted(cols)]) for row in r.fetchall())
    mine = sorted(repr([plain(row[c]) for c in sorted(cols)]) for row in df.collect())
    assert mine == theirs


def test_signals_vary(spark):
    from proselab.functions import lexicon

    rows = library.QUERIES["fingerprint"](spark, SF).collect()
    for name, _ in lexicon.WEIGHTS:
        assert len({r[name] for r in rows}) >= 3, name
    assert all(0 <= r["aggregate"] <= 1 for r in rows)
