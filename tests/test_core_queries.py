"""Every core query against its SQL, order and engine aside."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry
from tessera.sources.fixtures import BASE

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{sf_dir}/{b}.parquet'")
    return con


def shape(frame):
    cols = sorted(frame.columns)
    one = lambda v: "" if pd.isna(v) else str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return cols, sorted([one(x) for x in r] for r in frame[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).fetchdf()
    assert shape(got) == shape(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.fixture(scope="module")
def wide_dir(spark, sf_dir, tmp_path_factory):
    """Tables of a cluster of 10,500 nodes."""
    path = str(tmp_path_factory.mktemp("wide"))
    spark.range(10_500).selectExpr("id AS s_suppkey", "cast(id % 25 AS int) AS s_nationkey").toPandas().to_parquet(f"{path}/supplier.parquet")
    spark.range(12_000).selectExpr("id AS p_partkey").toPandas().to_parquet(f"{path}/part.parquet")
    for name in ("nation", "region"):
        pd.read_parquet(f"{sf_dir}/{name}.parquet").to_parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", ["c11_update_placements", "j11_destinations"])
def test_query_over_many_nodes_matches_sql(spark, wide_dir, name):
    con = duckdb.connect()
    for b in ("supplier", "part", "nation", "region"):
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{wide_dir}/{b}.parquet'")
    got, want = QUERIES[name](spark, f"file://{wide_dir}").toPandas(), con.sql(SQL[name]).fetchdf()
    assert len(got) and shape(got) == shape(want)
