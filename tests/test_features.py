"""Feature stage: coverage, two-level impute, medians, encoding, validation."""

from pyspark.sql import functions as F

from panelspark.operators import features as FE
from panelspark.operators.quality import panel_rules, validate
from panelspark.operators.quantiles import exact_medians, exact_quantiles
from tests.conftest import rows


def a3_panel(spark):
    return spark.createDataFrame(
        [
            ("FRA", 2015, 40000.0, "Europe"),
            ("FRA", 2016, None, "Europe"),
            ("FRA", 2017, 42000.0, None),
            ("TUV", 2018, 5000.0, "Pacific"),
        ],
        "entity string, time int, gdp_per_capita_ppp double, region string",
    )


def test_build_features_a3(spark):
    feats, maps, meds = FE.build_features(
        a3_panel(spark), 2015, 2024, 2, ["gdp_per_capita_ppp"], ["region"]
    )
    assert {r["entity"] for r in feats.collect()} == {"FRA"}
    assert feats.filter(F.col("gdp_per_capita_ppp").isNull()).count() == 0
    assert "region_code" in feats.columns
    assert dict(rows(meds, "feature", "median"))["gdp_per_capita_ppp"] == 41000.0
    got = dict(rows(maps.filter("feature = 'region'"), "category", "code"))
    assert got == {"Europe": 0, "UNKNOWN": 1}


def test_validation_a4_drops_only_bad_rows(spark):
    panel = spark.createDataFrame(
        [("FRA", 2015, 30.0, 40000.0), ("FRA", 1800, 31.0, 41000.0), ("DEU", 2016, 250.0, 42000.0)],
        "entity string, time int, gini_index double, gdp_per_capita_ppp double",
    )
    kept, failures = validate(panel, panel_rules(1990, 2024), keys=["entity", "time"])
    assert rows(kept, "entity", "time") == [("FRA", 2015)]
    assert sorted(r["rule"] for r in failures.collect()) == ["gini_index_range", "year_range"]


def test_validation_never_changes_values_and_coercion_fails(spark):
    panel = spark.createDataFrame(
        [("FRA", 2015, "12.5"), ("FRA", 2016, "abc")], "entity string, time int, unemployment_rate string"
    )
    kept, failures = validate(panel, panel_rules(1990, 2024), keys=["entity", "time"])
    assert rows(kept, "unemployment_rate") == [("12.5",)]
    assert rows(failures, "rule", "value") == [("unemployment_rate_range", "abc")]


def test_impute_all_null_entity_and_all_null_column_b8(spark):
    panel = spark.createDataFrame(
        [("A", 1, 1.0, None), ("A", 2, 3.0, None), ("B", 1, None, None), ("C", 1, 10.0, None)],
        "entity string, time int, x double, y double",
    )
    filled, meds = FE.impute_two_level(panel, ["x", "y"])
    got = dict(((r["entity"], r["time"]), r["x"]) for r in filled.collect())
    # A filled by its own median, B (all null) by the global median of the entity-filled column
    assert got[("B", 1)] == 3.0
    assert filled.filter(F.col("y").isNotNull()).count() == 0
    stored = dict(rows(FE.median_map(filled, ["x", "y"]), "feature", "median"))
    assert stored["y"] == 0.0


def test_encode_scoring_b9(spark):
    train = spark.createDataFrame([("X ",), ("Y",), (None,)], "c string")
    maps = FE.category_maps(train, ["c"])
    score = spark.createDataFrame([(1, ""), (2, None), (3, "Z"), (4, "X ")], "id int, c string")
    out = FE.encode(score, maps, ["c"], scoring=True)
    codes = dict(rows(out, "id", "c_code"))
    unknown = dict(rows(maps, "category", "code"))["UNKNOWN"]
    assert codes == {1: unknown, 2: unknown, 3: -1, 4: dict(rows(maps, "category", "code"))["X "]}


def test_coverage_filter(spark):
    panel = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "entity string, time int")
    assert rows(FE.coverage_filter(panel, 2), "entity") == [("A",), ("A",)]


def test_exact_median_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    vals = rng.lognormal(size=3001).tolist() + [None] * 5
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_medians(df, ["x"])["x"]
    assert got == float(np.median([v for v in vals if v is not None]))
    q = exact_quantiles(df, ["x"], 0.95)["x"]
    assert abs(q - float(np.quantile([v for v in vals if v is not None], 0.95))) < 1e-12


def test_exact_median_even_count_and_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (7.0,)], "x double")
    assert exact_medians(df, ["x"])["x"] == 2.0
    df2 = spark.createDataFrame([(1.0,), (4.0,)], "x double")
    assert exact_medians(df2, ["x"])["x"] == 2.5


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=60))
def test_exact_median_property(spark, vals):
    import numpy as np

    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_medians(df, ["x"])["x"]
    assert abs(got - float(np.median(vals))) <= 1e-9 * max(1.0, abs(float(np.median(vals))))


def test_category_codes_dense_per_feature_over_many_ranges(spark):
    from panelspark.operators.features import category_maps

    data = [(f"r{i % 300:03d}", f"g{i % 7}") for i in range(900)]
    panel = spark.createDataFrame(data, "region string, income_group_lag1 string")
    got = {(r["feature"], r["category"]): r["code"] for r in category_maps(panel, ["region", "income_group_lag1"]).collect()}
    for feature, cats in (("region", {r for r, _ in data}), ("income_group_lag1", {g for _, g in data})):
        want = {(feature, c): i for i, c in enumerate(sorted(cats))}
        assert {k: v for k, v in got.items() if k[0] == feature} == want


def test_quantiles_of_infinite_and_extreme_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0,), (2.0,), (inf,), (float("nan"),), (None,)], "x double")
    assert exact_medians(df, ["x"])["x"] == 2.0
    ends = spark.createDataFrame([(1.7e308,), (-1.7e308,), (5.0,), (-inf,), (inf,)], "x double")
    assert exact_medians(ends, ["x"])["x"] == 5.0


def test_a_code_listed_twice_raises(spark):
    import pytest

    from panelspark.operators.codes import map_codes

    df = spark.createDataFrame([("FR",)], "c string")
    twice = spark.createDataFrame([("FR", "FRA"), ("FR", "FRX")], "code string, entity string")
    with pytest.raises(ValueError, match="not unique"):
        map_codes(df, "c", twice)
