"""Every registered plan query against its SQL, over whole tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from planlens import more_queries, queries, review_queries, structure_queries, workflow_queries  # noqa: E402, F401
from planlens.registry import ORACLES, QUERIES  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order) for r in records), key=repr)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for g, e in zip(got, expected, strict=True):
        assert g == pytest.approx(e) if any(isinstance(x, float) for x in g) and None not in g and not any(isinstance(x, str) for x in g) else g == e
