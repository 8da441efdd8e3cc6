"""M6 on a stream: boosted prices of line items shipped after the training years, with stored medians and category codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.boosting import fit
from ..operators.features import category_maps, encode, median_map
from ..operators.registry import append_run, gates_table, version_stages
from ..session import scratch_path
from ..streaming.rates import event_stream
from ..streaming.scoring import read_version, score_stream, served_version, write_version
from . import driver_tables as D
from .boost_queries import PARAMS
from .boost_sql import boosted
from .catalog import query, rounded
from .oracle import SQL

LAST_YEAR = 1996
NUMERIC, CATEGORICAL = ["quantity", "discount"], ["flag"]
EDGES = [[10.0, 20.0, 30.0, 40.0], [0.015, 0.035, 0.055, 0.075], [0.5, 1.5]]


def _rows(li):
    """Feature rows; every tenth order lacks its discount, every seventh its flag."""
    return li.select(
        "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"), F.col("l_quantity").cast("double").alias("quantity"),
        F.when(F.col("l_orderkey") % 10 != 0, F.col("l_discount").cast("double")).alias("discount"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")).alias("flag"), (F.col("l_extendedprice") / 1000).cast("double").alias("price"),
    )


def train_version(spark, train, folder: str, version: int, params=PARAMS) -> None:
    """Fits, lands and registers a version that passes its gate."""
    medians, maps = median_map(train, NUMERIC), category_maps(train, CATEGORICAL)
    filled = train.fillna({r["feature"]: r["median"] for r in medians.collect()})  # a row per feature
    model = fit(encode(filled, maps, CATEGORICAL), [*NUMERIC, "flag_code"], "price", params, EDGES)
    write_version(spark, f"{folder}/models", "price", version, model, maps, medians)
    runs = spark.createDataFrame([("price", version, "r2", 1.0)], "target string, version int, metric string, value double")
    append_run(version_stages(runs, gates_table(spark, {"price": ("r2", 0.4)})), f"{folder}/registry", version)


@query("stream_score")
def q_stream_score(spark, sf_dir):
    root = scratch_path(spark, "stream-score")
    train_version(spark, _rows(D.table(spark, sf_dir, "lineitem")).filter(F.col("year") <= LAST_YEAR), root, 1)
    stream = _rows(event_stream(spark, sf_dir, "lineitem.parquet")).filter(F.col("year") > LAST_YEAR)
    scored = score_stream(
        stream, lambda: served_version(spark, f"{root}/registry", "price"), lambda v: read_version(spark, f"{root}/models", "price", v, NUMERIC, CATEGORICAL), f"{root}/out"
    )
    return rounded(scored.select("l_orderkey", "l_linenumber", "discount", "flag_code", "prediction", "model_version"))


_LI = f"""
raw AS (SELECT row_number() OVER () AS i, l_orderkey, l_linenumber, year(l_shipdate) <= {LAST_YEAR} AS train, CAST(l_quantity AS DOUBLE) AS quantity,
    CASE WHEN l_orderkey % 10 <> 0 THEN CAST(l_discount AS DOUBLE) END AS d, coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END, 'UNKNOWN') AS c,
    CAST(l_extendedprice / 1000 AS DOUBLE) AS price FROM lineitem),
codes AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM (SELECT DISTINCT c FROM raw WHERE train)),
li AS MATERIALIZED (SELECT raw.*, coalesce(d, (SELECT median(d) FROM raw WHERE train)) AS discount, coalesce(code, -1) AS flag_code FROM raw LEFT JOIN codes USING (c))"""

SQL["stream_score"] = f"""WITH {boosted(False, _LI, ["quantity", "discount", "flag_code"], EDGES)}
SELECT l_orderkey, l_linenumber, round(discount * 1e4) / 1e4 AS discount, CAST(flag_code AS INTEGER) AS flag_code, round(m * 1e4) / 1e4 AS prediction, CAST(1 AS INTEGER) AS model_version
FROM state JOIN li USING (i, l_orderkey, l_linenumber) WHERE NOT li.train"""
