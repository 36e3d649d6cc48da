"""Registered queries against their SQL on the smallest tables (all of them with OFFICELAKE_ALL=1)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = (
    "s4 s7 s12 s15 p1 p3 p6 j5 j12_key a1 a3 a5 w2 w5 w6 w8 p15 k2 k3 k15 k17 k20 c2 m2 m5 x8 x10 e1 e2_apply "
    "r4 t6_receive e2e0 e2e2_documents e2e3"
).split()
NAMES = [n for n in entry.oracle_sql() if os.environ.get("OFFICELAKE_ALL") or any(n.startswith(q + "_") or n == q for q in QUICK)]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow().to_pylist()
    want = con.execute(entry.oracle_sql()[name]).to_arrow_table().to_pylist()
    shape = lambda rows: sorted(tuple(str(r[k]) for k in sorted(r)) for r in rows)
    assert shape(got) == shape(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
