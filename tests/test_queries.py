"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from quantaloom.plans import catalog, training_queries
from tools.check_oracle import TABLES, compare

# trained codebooks are covered by the operator tests; the rest runs here
SLOW = {n for n, f in catalog.QUERIES.items() if f.__module__ == training_queries.__name__ and "training" in n}


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, con, sf_dir, name):
    line = compare(spark, con, name, sf_dir)
    assert line.startswith(("ok", "rows")), line
    assert "TYPES" not in line, line


def test_entry(spark):
    out = spark_entry.entry(spark)
    assert out.count() == 3
