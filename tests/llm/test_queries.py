"""The queries of the training-data operators against their DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from proselab.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    r = c.execute(queries.SQL[name])
    cols = sorted(d[0] for d in r.description)
    at = [[d[0] for d in r.description].index(n) for n in cols]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted(repr([x[n] for n in cols]) for x in df.collect()) == sorted(repr([row[k] for k in at]) for row in r.fetchall())
