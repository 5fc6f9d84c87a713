import pytest

import __spark_entry__
from leafmill.plans import catalog
from tests.helpers import compare

#: These find nothing on tables as small as these.
MAY_BE_EMPTY = {"repeated_margins"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLES:
        n = compare(df, duck.sql(catalog.ORACLES[name]))
    else:
        n = df.count()
    assert n > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["source", "chunk", "n_paragraphs", "n_words", "first_id"]
    assert df.count() > 0


def test_all_but_one_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"pack_with_byte_budget"}


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
