"""Every query with SQL gives DuckDB's rows; the others run and give rows."""

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def needs_larger(name):  # draws of 25 rows a class need more orders than the smallest scale has
    return name.startswith(("sample_", "ablation_ladder"))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    if needs_larger(name) and duck.sql("SELECT min(n) FROM (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY o_orderpriority)").fetchall()[0][0] < 25:
        with pytest.raises(ValueError):
            catalog.queries()[name](spark, SF)
        return
    df = catalog.queries()[name](spark, SF)
    rows = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows == sorted(want.project(", ".join(f'"{c}"' for c in sorted(want.columns))).fetchall(), key=str)
