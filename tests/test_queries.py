"""Every registered query of the core against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from verispark import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = E.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    result = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted([plain(r[names.index(c)]) for c in cols] for r in result.fetchall())
    assert sorted(names) == cols and got == want


def test_refresh_with_a_version_that_starts_now(spark, sf, tmp_path):
    """An old version that starts at the very time of the refresh is no new row."""
    for t in ("events", "documents"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors.withColumn("vec_id", vectors.vec_id + 8700).write.parquet(f"{tmp_path}/embeddings.parquet")  # number 8784 starts on 2025-01-01
    got = sorted(tuple(r) for r in E.queries()["refresh_embeddings"](spark, str(tmp_path)).collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.execute(f"SELECT subject_id, success, error, vector FROM ({E.oracle_sql()['refresh_embeddings']}) ORDER BY 1").fetchall()
    assert got == want


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_registry_without_subpackage(monkeypatch):
    monkeypatch.setattr(E, "_HAS_LLM", False)
    monkeypatch.setattr(E, "_HAS_PIPELINE", False)
    assert set(E.queries()) == set(core.QUERIES) and set(E.oracle_sql()) == set(core.ORACLE_SQL)
