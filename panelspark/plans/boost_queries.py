"""M2 and M5 with the L2 penalty: boosted trees on line items, on a fixed binning (a few rounds, so that SQL can follow)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.boosting import fit, predict
from . import driver_tables as D
from .catalog import query, rounded

ROUNDS, DEPTH, RATE, PENALTY = 2, 2, 0.3, 1.0
PARAMS = {"n_estimators": ROUNDS, "max_depth": DEPTH, "learning_rate": RATE, "reg_lambda": PENALTY}
FEATURES = ["quantity", "discount", "ship_month"]
EDGES = [[10.0, 20.0, 30.0, 40.0], [0.015, 0.035, 0.055, 0.075], [12.0, 24.0, 36.0, 42.0, 48.0, 60.0]]


def _rows(spark, sf_dir):
    li = D.table(spark, sf_dir, "lineitem")
    month = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"),
        month.cast("double").alias("ship_month"), (F.col("l_extendedprice") / 1000).cast("double").alias("price"), F.col("l_returnflag").alias("flag"),
    )


@query("boost_regress")
def q_boost_regress(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = fit(rows, FEATURES, "price", PARAMS, EDGES)
    return rounded(predict(model, rows).select("l_orderkey", "l_linenumber", "prediction"))


@query("boost_classify")
def q_boost_classify(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = fit(rows, FEATURES, "flag", PARAMS, EDGES, classify=True)
    out = predict(model, rows, "predicted_flag")
    return rounded(out.select("l_orderkey", "l_linenumber", "predicted_flag", F.get(F.map_values("probabilities"), F.lit(0)).alias("p_first")))
