"""Merge stage: pivot, coalesce with provenance, names, lags, latest values."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import panel as P
from panelspark.schemas import LONG
from tests.conftest import rows


def long_df(spark, data):
    return spark.createDataFrame(data, LONG)


def test_pivot_mean_averages_duplicates_and_drops_empty_cells(spark):
    df = long_df(
        spark,
        [
            ("FRA", "France", 2020, "gdp", 1.0, "worldbank"),
            ("FRA", "France", 2020, "gdp", 3.0, "oecd"),
            ("FRA", "France", 2021, "gdp", None, "worldbank"),
            ("DEU", "Germany", 2020, "pop", 5.0, "worldbank"),
        ],
    )
    out = P.pivot_mean(df, ["gdp", "pop"])
    assert rows(out, "entity", "time", "gdp", "pop") == [("DEU", 2020, None, 5.0), ("FRA", 2020, 2.0, None)]


def test_coalesce_priority_and_provenance_b1(spark):
    # B1: all three variants / OECD (rescaled) + Eurostat / Eurostat only
    df = long_df(
        spark,
        [
            ("A", None, 2020, "gini_index", 30.0, "worldbank"),
            ("A", None, 2020, "gini_index_oecd", 0.31, "oecd"),
            ("A", None, 2020, "gini_index_eurostat", 32.0, "eurostat"),
            ("B", None, 2020, "gini_index_oecd", 0.307, "oecd"),
            ("B", None, 2020, "gini_index_eurostat", 33.0, "eurostat"),
            ("C", None, 2020, "gini_index_eurostat", 34.0, "eurostat"),
        ],
    )
    wide = P.pivot_mean(P.rescale_by_source(df), ["gini_index", "gini_index_oecd", "gini_index_eurostat"])
    out = P.coalesce_with_provenance(wide)
    got = {r["entity"]: (round(r["gini_index"], 6), r["gini_source"]) for r in out.collect()}
    assert got == {
        "A": (30.0, "gini_index"),
        "B": (30.7, "gini_index_oecd"),
        "C": (34.0, "gini_index_eurostat"),
    }


def test_coalesce_uses_only_present_columns(spark):
    wide = spark.createDataFrame([("A", 2020, None, 2.0)], "entity string, time int, gini_index double, gini_index_eurostat double")
    out = P.coalesce_with_provenance(wide).first()
    assert out["gini_index"] == 2.0 and out["gini_source"] == "gini_index_eurostat"


def test_row_lag_is_a_row_lag_not_year_minus_one_b2(spark):
    df = spark.createDataFrame([("E", 2010, "A"), ("E", 2012, "B"), ("E", 2013, "C")], "entity string, time int, g string")
    out = P.row_lag(df, "g")
    assert rows(out, "time", "g_lag1") == [(2010, None), (2012, "A"), (2013, "B")]


def test_latest_nonnull_skips_nulls_per_column_b3(spark):
    df = spark.createDataFrame([("E", 1, 5.0, "x"), ("E", 2, None, None)], "entity string, time int, v double, s string")
    out = P.latest_nonnull(df, "entity", "time", ["v", "s"]).first()
    assert (out["v"], out["s"]) == (5.0, "x")


def test_entity_names_follow_source_priority(spark):
    df = long_df(
        spark,
        [
            ("FRA", "France (oecd)", 2019, "x", 1.0, "oecd"),
            ("FRA", "France", 2020, "x", 1.0, "worldbank"),
            ("USA", None, 2020, "x", 1.0, "worldbank"),
            ("USA", "US (wid)", 2020, "x", 1.0, "wid"),
        ],
    )
    got = dict(rows(P.entity_names(df), "entity", "entity_name"))
    assert got == {"FRA": "France", "USA": "US (wid)"}


def test_attach_rejects_duplicate_dimension_keys(spark):
    panel = spark.createDataFrame([("A", 2020)], "entity string, time int")
    dim = spark.createDataFrame([("A", "x"), ("A", "y")], "entity string, region string")
    with pytest.raises(ValueError):
        P.attach(panel, dim, "entity", ["region"])


def test_attach_absent_dimension_gives_null_columns(spark):
    panel = spark.createDataFrame([("A", 2020)], "entity string, time int")
    out = P.attach(panel, None, "entity", ["intergen_income_elasticity"], null_type="double")
    assert out.schema["intergen_income_elasticity"].dataType.typeName() == "double"
    assert out.first()["intergen_income_elasticity"] is None


def test_merge_workflow_a5(spark):
    """One full source and three empty ones -> 6-row panel with Gini, lag of the group."""
    wb = [
        ("FRA", "France", y, "gini_index", v, "worldbank") for y, v in [(2018, 32.4), (2019, 32.1), (2020, 31.9)]
    ] + [("USA", "United States", y, "gini_index", v, "worldbank") for y, v in [(2018, 41.5), (2019, 41.2), (2020, 41.0)]]
    frames = [long_df(spark, wb)] + [spark.createDataFrame([], LONG) for _ in range(3)]
    long = P.union_sources(frames)
    dim = spark.createDataFrame(
        [("FRA", "High income", "Europe"), ("USA", "High income", "North America")],
        "entity string, income_group string, region string",
    )
    panel = P.build_panel(long, ["gini_index"], dimension=dim)
    assert panel.count() == 6
    assert panel.filter(F.col("gini_index").isNull()).count() == 0
    lags = rows(panel.filter(F.col("entity") == "FRA"), "time", "income_group_lag1")
    assert lags == [(2018, None), (2019, "High income"), (2020, "High income")]
    assert set(panel.columns) >= {"entity_name", "gini_source", "intergen_income_elasticity"}
