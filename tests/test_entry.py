"""The driver contract, with or without the optional subpackage."""

import duckdb
import pytest

import __spark_entry__
from tessella.plans.registry import TABLE


def test_every_query_with_sql_is_registered():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(TABLE) <= set(queries) and set(sql) <= set(queries)


@pytest.mark.parametrize("name", ["out_degree", "tile_offsets", "stripe_order", "bfs_parents", "sssp_weighted", "pagerank_5", "connected_components", "betweenness", "tile_size_advisor"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("lineitem", "orders", "part", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    query, sql = TABLE[name]
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
