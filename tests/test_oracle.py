"""Every registered query against its DuckDB twin, at the smallest size."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from millrace.plans.registry import ORACLE_SQL, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple("NaN" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


#: DuckDB's names of Spark's types.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    want = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {r[0]: r[1] for r in oracle.execute(f"DESCRIBE {ORACLE_SQL[name]}").fetchall()}
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    want = oracle.execute(ORACLE_SQL[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, want.fetchall())
