import os

import pytest
from oracle import check

from sparkloom import catalog

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    check(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", ["recon_mint", "fc_ets", "fc_theta", "fc_arima", "fc_harmonic"])
def test_models_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_models_read_the_texts_once(spark):
    """What the classifiers go over again and again is a settled table of numbers, in as many parts as there are cores at least."""
    from pyspark.sql import functions as F

    rows = catalog._quality(spark, SF)
    plan = rows._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "parquet" not in plan.lower()
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    labels = catalog.read(spark, SF, "labels").join(catalog.read(spark, SF, "documents"), "doc_id")
    assert rows.count() == labels.count() and rows.select(F.count_distinct("fold")).first()[0] == 3
