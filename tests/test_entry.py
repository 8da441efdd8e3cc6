"""Driver contract and partition-count invariance."""

import __spark_entry__ as E
from panelspark.plans.all import QUERIES, SQL
from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "gini_source" in df.columns


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_results_equal_for_one_and_many_shuffle_partitions(spark):
    a = sorted(tuple(r) for r in QUERIES["coalesce_provenance"](spark, SF_SMALL).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(tuple(r) for r in QUERIES["coalesce_provenance"](spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_size_shuffles_scales_with_input(spark):
    from panelspark.session import size_shuffles

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        small = size_shuffles(spark, 10 * 1024 * 1024)
        big = size_shuffles(spark, 100 * 1024**4)
        assert small == spark.sparkContext.defaultParallelism * 2
        assert big == 100 * 1024**4 // (256 * 1024**2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
