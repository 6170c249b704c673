"""Queries that SQL can express, against DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumenspan.llm import queries

TABLES = ("documents", "pages", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_oracle(spark, name, sf):
    compare(spark, name, f"/root/testdata/{sf}", TABLES)


def compare(spark, name, folder, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, folder)
    relation = db.sql(queries.ORACLES[name])
    assert sorted(relation.columns) == sorted(frame.columns)
    order = [relation.columns.index(c) for c in frame.columns]
    got = sorted((tuple(r) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=repr)


ODD = [
    None, "", " ", "\n\n", "a\na\n a\nb\na", "x y z u v x y z u v x y z", "# * % | <a> &&", "w " * 30 + "\n" + "w " * 30, "ü\r\nü\r\nü", "one\u00a0two\u2028three four",
    "me@x.org@y.net, a.b+c@d-e.f.g. @x.y a@b", "😀 q@r.st 😀 1.2.3.4 😀", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3 9.9.9.99999999999999999999999999999999999999999999",
    "4111 1111 1111 1111, 4111-1111-1111-1112; 378282246310005 5500000000000004 1", "0 " * 15, "+1 (555) 010-9999 +44 20 7946 0958 0001 1111 +1-2 +123456789012345678", "12.0.0.1@x.org +49.30.1234567.8",
]


@pytest.mark.parametrize("name", ["language_folds", "quality_base", "byte_bpe_round_trip", "personal_data_base"])
def test_base_columns_of_odd_texts(spark, tmp_path, name):
    ids = [*range(len(ODD)), None, 3, -5, 10**12]
    texts = [*ODD, "no id", ODD[3], "below zero", "far"]
    columns = {"doc_id": pa.array(ids, pa.int64()), "source": ["s"] * len(ids), "lang": ["en", None] * (len(ids) // 2) + ["de"] * (len(ids) % 2), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "text": texts}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    compare(spark, name, str(tmp_path), ["documents"])
