"""Every query with SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return [norm(x) for x in value]
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(range(len(names)), key=lambda k: names[k])
    expected = sorted(repr([norm(row[k]) for k in order]) for row in found.fetchall())
    assert sorted(repr([norm(row[c]) for c in sorted(names)]) for row in got.collect()) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["chunk_contents", "page_sections", "page_chunks", "extractive_answers", "extracted_entities", "extracted_graph", "document_chunks"])
def test_queries_without_sql_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
