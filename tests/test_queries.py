import duckdb
import pytest

import __spark_entry__ as entry
from corvane import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)


def agree(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns, sorted(columns)) == canonical(got.fetchall(), columns, sorted(columns))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    agree(spark, sf_dir, name)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
