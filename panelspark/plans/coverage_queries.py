"""A2 and J6 from stored bit maps: one map per order status, as if each were a load of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.coverage import covered, merged, seen
from ..params import MIN_YEARS_REQUIRED
from ..schemas import DEFAULT_ROLES as R
from ..session import scratch_path
from . import driver_tables as D
from .catalog import query
from .oracle import SQL


@query("coverage_bitmap")
def q_coverage_bitmap(spark, sf_dir):
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias(R.entity), F.year("o_orderdate").alias(R.time), "o_orderstatus")
    folder = scratch_path(spark, "coverage")
    for n, load in enumerate((F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O", ~F.col("o_orderstatus").isin("F", "O"))):
        seen(orders.filter(load)).write.parquet(f"{folder}/load={n}")
    return covered(merged(spark.read.parquet(folder).drop("load")), MIN_YEARS_REQUIRED)


SQL["coverage_bitmap"] = f"""SELECT o_custkey AS entity, count(DISTINCT year(o_orderdate)) AS n_times FROM orders
WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY o_custkey HAVING count(DISTINCT year(o_orderdate)) >= {MIN_YEARS_REQUIRED}"""
