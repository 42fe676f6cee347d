import duckdb
import pandas as pd
import pytest

import __spark_entry__
from scorefold.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels pages".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if pd.isna(x):
            return ""
        return str(x) if isinstance(x, (str, bool)) else f"{float(x):.6f}"

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
