"""Every registered time-series query against its SQL oracle in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from lumenspan.plans import catalogue, long_records  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(r[c] for c in columns) for r in frame.collect())
    relation = db.sql(catalogue.ORACLES[name])
    order = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    assert got == sorted(tuple(r[i] for i in order) for r in relation.fetchall())
    assert got


def test_every_query_has_an_oracle():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()


@pytest.mark.parametrize("name", ["das_fk_filter", "das_taper_channels", "das_integrate_channels"])
def test_sees_every_channel(spark, name):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert entry.queries()[name](spark, SF).select("channel").distinct().count() == rows


def test_entry(spark):
    assert entry.entry(spark).count() == 200
