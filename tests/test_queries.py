import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sondage.operators.vector_search import MOST_QUERIES
from sondage.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def _rows(names, rows):
    return sorted(repr([None if isinstance(x, float) and x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in (r[n] for n in names)]) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    assert df.columns
    if name in SQL:
        cur = db.execute(SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        other = [dict(zip(columns, r)) for r in cur.fetchall()]
        assert _rows(sorted(columns), rows) == _rows(sorted(columns), other)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_recall_of_more_queries_than_are_sent_to_all_tasks(spark, tmp_path):
    n = MOST_QUERIES + 100
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((60, 64))[rng.integers(0, 60, n)] + rng.standard_normal((n, 64)) * 0.3).astype(np.float32)
    rows = pa.table({"chunk_id": pa.array(np.arange(n) * 50), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    pq.write_table(pa.concat_tables([rows, rows.slice(0, 50)]), tmp_path / "vectors.parquet")
    assert [r.enough for r in QUERIES["knn_recall"](spark, str(tmp_path)).collect()] == [True]
