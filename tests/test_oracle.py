"""Every registered query equals its DuckDB counterpart on the sample tables."""

import os
import pathlib
import re

import pytest

import __spark_entry__ as registered
from compare import differences, duck, type_differences

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


# Text operators have tests of their own.
NAMES = [n for n in registered.queries() if not re.match(r"op\d+_|pipeline$", n)]


def test_every_query_has_a_counterpart():
    assert set(NAMES) <= set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    rows = registered.queries()[name](spark, FOLDER)
    want = connection.execute(registered.oracle_sql()[name])
    assert type_differences(dict(rows.dtypes), {d[0]: str(d[1]) for d in want.description}) is None
    assert differences(rows.toPandas(), want.df()) is None


def test_entry(spark):
    assert registered.entry(spark).count() > 0
