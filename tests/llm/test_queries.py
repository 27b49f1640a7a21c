"""Registered queries beside their DuckDB counterparts."""

import re

import duckdb
import pytest

import __spark_entry__ as registered
from compare import differences, duck, type_differences
from meterlake.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries()) and set(ORACLE_SQL) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, name):
    rows, want = QUERIES[name](spark, FOLDER), duck(FOLDER).execute(ORACLE_SQL[name])
    types = {d[0]: str(d[1]) for d in want.description}
    assert type_differences(dict(rows.dtypes), types) is None
    assert differences(rows.toPandas(), want.df()) is None


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_on_odd_texts(spark, tmp_path, name):
    """Every kind of blank, lines of blanks only, null and empty texts, null ids and sources, repeated rows."""
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " \r\n", "a\x0bb\x0cc\rd" * 30, "one\r\n\r\none\r\n \x0b\none\n" * 9, passage, passage, passage.upper() + "\x85 # $", "é 中文 " * 50]
    rows = [(i if i else None, t, None if i % 4 == 0 else f"s{i % 3}", "en" if i % 2 else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [("b1", passage[:200]), ("b2", "A b"), (None, None), ("b3", "")]
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert differences(QUERIES[name](spark, str(tmp_path)).toPandas(), db.execute(ORACLE_SQL[name]).df()) is None
