"""Every core query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.operators import folds
from tidemark.plans import catalogue, catalogue_more, catalogue_sources  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "events", "embeddings", "documents", "supplier"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows: pd.DataFrame) -> list[tuple]:
    def shown(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "-"
        return str(v) if isinstance(v, str) else f"{float(v):.6f}"

    return sorted(tuple(shown(v) for v in r) for r in rows[sorted(rows.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_a_fold_collects_every_row_once(spark):
    """Rows of several parts, in order."""
    rows = spark.range(1000).selectExpr("id % 2 AS k", "cast(id AS double) AS t")
    got = folds.spaced(rows, ["k"], ["t"], "t", 0.0, strict=True, carry=[]).collect()
    assert sorted((r.k, r.t) for r in got) == sorted((i % 2, float(i)) for i in range(1000))
