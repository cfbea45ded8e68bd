import glob
import os

import duckdb
import pytest

from sondage.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    if name in SQL:
        cur = db.execute(SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        other = [dict(zip(columns, r)) for r in cur.fetchall()]

        def key(r):
            return repr([r[c] for c in sorted(columns)])

        assert sorted(map(key, rows)) == sorted(map(key, other))
