"""Every query against its SQL on the smallest tables; queries without SQL must run and return rows."""

from __future__ import annotations

import compare
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from emberlake.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    assert compare.compare(QUERIES[name](spark, SMALL), duck, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_samples_take_the_whole_panel(spark):
    from emberlake.plans import catalog

    whole = catalog.panel(spark, SMALL)
    assert QUERIES["smote"](spark, SMALL).where("rare = 0").count() == whole.where("part % 97 <> 5").count()
    p, donors = catalog._donors(spark, SMALL)
    usable = p.where(sum(F.col(c).isNull().cast("int") for c in ("a", "b", "c", "e")) <= 1).count()  # gaps of 0.4 of four features
    assert donors.count() == usable > 500
