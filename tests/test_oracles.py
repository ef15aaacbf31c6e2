"""Every core query against its SQL, run by DuckDB on the same tables."""

import duckdb
import pytest

from stagelens.plans import advice_queries, incident_queries, log_queries, more_queries  # noqa: F401  (they register their queries)
from stagelens.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_rows(spark, db, sf_dir, name):
    got = Q.QUERIES[name](spark, sf_dir)
    want = db.execute(Q.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), names)
