"""A3, A4 from stored sketches and D2, D5 from stored daily histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.summaries import PSI_MAX_BINS, daily, merged_quantile, sketched, window_psi
from ..session import scratch_path
from . import driver_tables as D
from .catalog import DRIFT_NUMERIC, query, rounded
from .oracle import SQL, r4


@query("sketch_medians")
def q_sketch_medians(spark, sf_dir):
    """Medians per customer, merged from sketches of single years."""
    orders = D.table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    path = scratch_path(spark, "sketches")
    sketched(orders, ["o_custkey", "year"], ["o_totalprice"]).write.parquet(path)
    return rounded(merged_quantile(spark.read.parquet(path), ["o_custkey"]).select("o_custkey", "n", F.col("value").alias("median")))


SQL["sketch_medians"] = f"""SELECT o_custkey, count(*) AS n, {r4("quantile_disc(CAST(o_totalprice AS DOUBLE), 0.5)")} AS median
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_custkey"""


@query("drift_window")
def q_drift_window(spark, sf_dir):
    """Shipments of spring 1998 against those of the year before, from histograms of single days."""
    items = D.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), *DRIFT_NUMERIC)
    path = scratch_path(spark, "histograms")
    daily(items, "day", DRIFT_NUMERIC).write.parquet(path)
    days = spark.read.parquet(path)
    before = days.filter(F.year("day") == 1997)
    return rounded(window_psi(before, days.filter("day between date'1998-03-01' and date'1998-05-31'")))


SQL["drift_window"] = f"""
WITH cells AS (SELECT day, feature, x FROM (SELECT CAST(l_shipdate AS DATE) AS day, unnest([{", ".join(f"{{'feature': '{c}', 'x': CAST({c} AS DOUBLE)}}" for c in DRIFT_NUMERIC)}], recursive := true) FROM lineitem)
    WHERE x IS NOT NULL AND (year(day) = 1997 OR day BETWEEN DATE '1998-03-01' AND DATE '1998-05-31')),
ends AS (SELECT day, feature, min(x) AS lo, max(x) AS hi FROM cells GROUP BY ALL),
widths AS (SELECT feature, CAST(max(greatest(CASE WHEN hi > lo THEN ceil(log2(hi / 127 - lo / 127)) ELSE -1000 END,
        CASE WHEN greatest(abs(lo), abs(hi)) > 0 THEN floor(log2(greatest(abs(lo), abs(hi)))) - 50 ELSE -1000 END)) AS INT) AS e FROM ends GROUP BY feature),
fine AS (SELECT year(day) = 1997 AS old, feature, CAST(floor(x / pow(2.0, e)) AS BIGINT) AS b FROM cells JOIN widths USING (feature)),
steps AS (SELECT feature, min(s) AS s FROM (SELECT feature, min(b) AS lo, max(b) AS hi FROM fine GROUP BY feature), range(0, 64) AS x(s)
    WHERE floor(hi / pow(2.0, s)) - floor(lo / pow(2.0, s)) < {PSI_MAX_BINS} GROUP BY feature),
bins AS (SELECT feature, floor(b / pow(2.0, s)) AS b, count(*) FILTER (old) AS q, count(*) FILTER (NOT old) AS p FROM fine JOIN steps USING (feature) GROUP BY ALL),
shares AS (SELECT feature, sum(q) OVER one AS n_reference, sum(p) OVER one AS n_current, greatest(q / sum(q) OVER one, 1e-4) AS q, greatest(p / sum(p) OVER one, 1e-4) AS p
    FROM bins WINDOW one AS (PARTITION BY feature))
SELECT feature, CAST(n_reference AS BIGINT) AS n_reference, CAST(n_current AS BIGINT) AS n_current, {r4("sum((p - q) * ln(p / q))")} AS psi,
    sum((p - q) * ln(p / q)) >= 0.2 AS drifted
FROM shares WHERE n_reference > 0 AND n_current > 0 GROUP BY feature, n_reference, n_current"""
