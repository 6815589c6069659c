"""Every registered query against its SQL twin, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, duck, small, name):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    relation = duck.sql(catalogue.ORACLE[name])
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    key = lambda row: tuple(repr(plain(v)) for v in row)
    assert sorted(key([r[c] for c in columns]) for r in df.collect()) == sorted(key([r[i] for i in place]) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11)) and rows[0].vec_id == 0 and rows[0].score == 1.0


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; import lodestone.plans.catalogue; sys.exit(any(m.startswith('lodestone.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
