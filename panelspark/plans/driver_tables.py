"""The driver's TPC-H-like tables in the roles of the panel pipeline.

Entity = customer (``o_custkey``), time = order year; ``o_orderstatus``
plays three statistical sources with priority F > O > P (worldbank, oecd,
eurostat); nation and region are the entity dimension (income group =
nation name, region = region name); the account balance is the static
per-entity measure; events are the service-metric stream.

Only columns a query needs are selected, so scans carry a pruned
``ReadSchema`` and pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import to_number
from ..operators.panel import source_factor
from ..schemas import DEFAULT_ROLES as R

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

GINI_INDICATORS = ["gini_index", "gini_index_oecd", "gini_index_eurostat"]
OTHER_INDICATORS = ["priority_level", "urgent_share"]
ALL_INDICATORS = OTHER_INDICATORS + GINI_INDICATORS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def status_source(status):
    return F.when(status == "F", F.lit("worldbank")).when(status == "O", F.lit("oecd")).otherwise(F.lit("eurostat"))


def status_indicator(status):
    return (
        F.when(status == "F", F.lit("gini_index"))
        .when(status == "O", F.lit("gini_index_oecd"))
        .otherwise(F.lit("gini_index_eurostat"))
    )


def _source_name(status, name):
    """Each source spells the entity name its own way."""
    return (
        F.when(status == "F", name)
        .when(status == "O", F.lower(name))
        .otherwise(F.concat(name, F.lit(" (P)")))
    )


def orders_observations(spark: SparkSession, sf_dir: str, rescale: bool = True) -> DataFrame:
    """Long observations landed from orders, without names.

    Three indicator families per order: a Gini variant by status (the OECD
    variant arrives on a 0-1 scale and is rescaled x100 by its source
    factor, as the OECD Gini is), the priority level parsed from text, and
    an urgent flag.  One scan, then a generator (no 3-way union).
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    st = F.col("o_orderstatus")
    price = F.col("o_totalprice")
    gini_value = F.when(st == "O", price / F.lit(1000000.0)).otherwise(price / F.lit(10000.0))
    if rescale:
        gini_value = gini_value * source_factor(status_source(st))
    prio = F.col("o_orderpriority")
    obs = F.array(
        F.struct(status_indicator(st).alias("i"), gini_value.alias("v")),
        F.struct(F.lit("priority_level").alias("i"), to_number(F.substring(prio, 1, 1)).alias("v")),
        F.struct(
            F.lit("urgent_share").alias("i"),
            F.when(prio.startswith("1-"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("v"),
        ),
    )
    return o.select(
        F.col("o_custkey").alias(R.entity),
        F.year("o_orderdate").cast("int").alias(R.time),
        status_source(st).alias(R.source),
        st.alias("_status"),
        F.explode(obs).alias("_o"),
    ).select(R.entity, R.time, F.col("_o.i").alias(R.indicator), F.col("_o.v").alias(R.value), R.source, "_status")


def orders_long(spark: SparkSession, sf_dir: str, rescale: bool = True) -> DataFrame:
    """The full long table: observations with the name each source gives the entity.

    The name lookup is a row-level join with customer (sort-merge on the
    customer key; AQE splits a hot key since nothing downstream depends on
    the join's partitioning).
    """
    obs = orders_observations(spark, sf_dir, rescale)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = obs.join(c, obs[R.entity] == c.c_custkey, "left")
    return j.select(
        R.entity,
        _source_name(F.col("_status"), F.col("c_name")).alias(R.entity_name),
        R.time,
        R.indicator,
        R.value,
        R.source,
    )


def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, entity_name, source, time) per distinct entity, source and time.

    Feeds the name priority (A6) without a row-level join: the distinct pairs
    are pre-aggregated map-side before they meet the customer table.
    """
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderdate")
    pairs = o.groupBy(
        F.col("o_custkey").alias(R.entity), F.col("o_orderstatus").alias("_status")
    ).agg(F.min(F.year("o_orderdate").cast("int")).alias(R.time))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    j = pairs.join(c, pairs[R.entity] == c.c_custkey, "left")
    return j.select(
        R.entity,
        _source_name(F.col("_status"), F.col("c_name")).alias(R.entity_name),
        status_source(F.col("_status")).alias(R.source),
        R.time,
    )


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second panel for J1: line items per customer and ship year."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey, "inner")
        .groupBy(F.col("o_custkey").alias(R.entity), F.year("l_shipdate").cast("int").alias(R.time))
        .agg(F.avg("l_quantity").alias("avg_quantity"), F.count(F.lit(1)).alias("n_lines"))
    )


def entity_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot dimension: customer -> nation name (income group), region name,
    and the static measure (account balance), from one customer scan."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation and region are fixed-size code lists (25 / 5 rows): safe to broadcast.
    nr = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    return c.join(F.broadcast(nr), c.c_nationkey == nr.n_nationkey, "left").select(
        F.col("c_custkey").alias(R.entity),
        F.col("n_name").alias("income_group"),
        F.col("r_name").alias("region"),
        F.col("c_acctbal").alias("acctbal"),
    )


def static_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static per-entity measure: the account balance."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(R.entity), F.col("c_acctbal").alias("acctbal")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
