"""Every query with SQL must give the SQL's rows; the others must give rows."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

from stacklore.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = registry.all_queries()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, pd.Timestamp):
        return str(x)
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 6) if isinstance(x, (int, float)) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return Counter(tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    own, its = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(own.columns) == sorted(its.columns)
    assert rows(own) == rows(its)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_letters_without_one_capital(spark, tmp_path):
    texts = [(1, "ßa line\nplain"), (2, "ﬁrst\nŉ x"), (3, "été")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = QUERIES["distill_pages"](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(own) == rows(c.sql(SQL["distill_pages"]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
