"""Sources and sinks: long sink, absent sources, sniffed CSV, JSON flatteners, code map."""

import json
import os

import pytest
from pyspark.sql import functions as F

from panelspark.operators.codes import map_codes_dict
from panelspark.params import GEO_OVERRIDES
from panelspark.schemas import LONG
from panelspark.sources import files as SF
from panelspark.sources import long as SL
from panelspark.sources import payloads as PL
from tests.conftest import rows


def test_long_sink_order_nulls_and_missing_column_a1(spark, tmpdir_path):
    df = spark.createDataFrame(
        [("worldbank", 32.4, "gini_index", 2020, "France", "FRA"), ("worldbank", None, "gini_index", 2020, "United States", "USA")],
        "source string, value double, indicator string, year int, country_name string, country_code string",
    ).withColumnsRenamed({"country_code": "entity", "country_name": "entity_name", "year": "time"})
    checked = SL.check_long(df)
    assert checked.columns == ["entity", "entity_name", "time", "indicator", "value", "source"]
    assert checked.count() == 1
    SL.write_long(df, f"{tmpdir_path}/long")
    back = SL.read_long(spark, f"{tmpdir_path}/long")
    assert rows(back, "entity", "value") == [("FRA", 32.4)]
    with pytest.raises(ValueError):
        SL.check_long(df.select("entity", "value"))


def test_absent_source_is_empty_with_schema(spark, tmpdir_path):
    out = SL.read_long(spark, f"{tmpdir_path}/nothing_here")
    assert out.count() == 0 and out.schema == LONG
    first = SL.first_existing(
        spark, [f"{tmpdir_path}/manual.csv", f"{tmpdir_path}/also_missing"], lambda p: spark.read.csv(p), LONG
    )
    assert first.count() == 0
    df, status = SL.best_effort(spark, lambda: spark.read.parquet(f"{tmpdir_path}/gone"))
    assert df.count() == 0 and status.startswith("failed")


def test_sniffed_csv_both_separators_keep_na_b7(spark, tmpdir_path):
    for sep in [";", ","]:
        d = os.path.join(tmpdir_path, f"wid{ord(sep)}")
        os.makedirs(d)
        with open(os.path.join(d, "part.csv"), "w") as f:
            f.write(sep.join([" Country ", "Year", "Value"]) + "\n")
            f.write(sep.join(["NA", "2020", "0.5"]) + "\n")
            f.write(sep.join(["FR", "2020", "0.3"]) + "\n")
        out = SF.read_delimited(spark, d, required=["country", "year", "value"])
        assert out.columns == ["country", "year", "value"]
        assert rows(out, "country") == [("FR",), ("NA",)]


def test_paged_json_b4(spark):
    page = '[{"pages":1},[{"countryiso3code":"FRA","country":{"value":"France"},"date":"2020","value":1.5},' \
        '{"countryiso3code":"USA","country":{"value":"US"},"date":"2020","value":null}]]'
    end = '[{"pages":1},null]'
    out = PL.flatten_paged(spark.createDataFrame([(page,), (end,)], "value string"))
    assert rows(out) == [("FRA", "France", 2020, 1.5)]


def test_sdmx_b5(spark):
    payload = {
        "data": {
            "dataSets": [{"series": {"0:1": {"observations": {"0": [0.3], "1": [0.4]}}}}],
            "structures": [
                {
                    "dimensions": {
                        "series": [
                            {"id": "REF_AREA", "values": [{"id": "FRA", "name": "France"}]},
                            {"id": "MEASURE", "values": [{"id": "X", "name": "x"}, {"id": "GINI", "name": "Gini"}]},
                        ],
                        "observation": [{"id": "TIME_PERIOD", "values": [{"id": "2019"}, {"id": "2020"}]}],
                    }
                }
            ],
        }
    }
    out = PL.flatten_sdmx(spark.createDataFrame([(json.dumps(payload),)], "value string"))
    got = rows(
        out.select(
            F.element_at("dimensions", F.lit("REF_AREA")),
            F.element_at("labels", F.lit("REF_AREA")),
            F.element_at("dimensions", F.lit("MEASURE")),
            "time_period",
            "value",
        )
    )
    assert got == [("FRA", "France", "GINI", "2019", 0.3), ("FRA", "France", "GINI", "2020", 0.4)]


def test_jsonstat_map_and_array_forms_b6(spark):
    dims = {
        "geo": {"category": {"index": {"B": 1, "A": 0}, "label": {"A": "Aland", "B": "Bland"}}},
        "time": {"category": {"index": ["2019", "2020", "2021"]}},
    }
    as_map = {"id": ["geo", "time"], "size": [2, 3], "dimension": dims, "value": {"0": 1.0, "5": 2.0}}
    as_arr = dict(as_map, value=[1.0, None, None, None, None, 2.0])
    df = spark.createDataFrame([(json.dumps(as_map),), (json.dumps(as_arr),)], "value string")
    out = PL.flatten_jsonstat(df).select(
        F.element_at("codes", F.lit("geo")), F.element_at("labels", F.lit("geo")), F.element_at("codes", F.lit("time")), "value"
    )
    got = rows(out)
    assert got == sorted([("A", "Aland", "2019", 1.0), ("B", "Bland", "2021", 2.0)] * 2)


def test_code_map_overrides_a2(spark):
    standard = {"FR": "FRA", "DE": "DEU", "GR": "GRC", "GB": "GBR"}
    df = spark.createDataFrame([("FR",), ("DE",), ("EL",), ("UK",), ("EU27_2020",), ("EA20",)], "code string")
    mapped, dropped = map_codes_dict(df, "code", standard, GEO_OVERRIDES)
    assert rows(mapped, "code", "entity") == [("DE", "DEU"), ("EL", "GRC"), ("FR", "FRA"), ("UK", "GBR")]
    assert rows(dropped, "code") == [("EA20",), ("EU27_2020",)]
    mapped2, dropped2 = map_codes_dict(df, "code", standard)
    assert ("EL",) in rows(dropped2, "code")


def test_entity_metadata_drops_aggregates(spark, tmpdir_path):
    lines = [
        {"id": "FRA", "name": "France", "incomeLevel": {"value": "High income"}, "region": {"value": "Europe "}},
        {"id": "EUU", "name": "EU", "incomeLevel": {"value": "Aggregates"}, "region": {"value": ""}},
        {"id": "", "name": "blank", "incomeLevel": {"value": "Low income"}, "region": {"value": "x"}},
        {"id": "XXX", "name": "none", "incomeLevel": {"value": None}, "region": {"value": "x"}},
    ]
    p = os.path.join(tmpdir_path, "meta.json")
    with open(p, "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    out = SF.read_entity_metadata(spark, p)
    assert rows(out) == [("FRA", "France", "High income", "Europe ")]


def test_cohort_file_requires_columns(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cohort.csv")
    with open(p, "w") as f:
        f.write("code,country,BETA\nFRA,France,0.4\n")
    with pytest.raises(ValueError):
        SF.read_cohorts(spark, p, {"code": "entity", "cohort": "birth_cohort", "BETA": "b"})


def test_artifacts_round_trip_and_scoring_a7(spark, tmpdir_path):
    from panelspark.operators.features import category_maps, median_map
    from panelspark.sources.artifacts import prepare_scoring, read_artifacts, write_artifacts

    train = spark.createDataFrame([(1.0, "Europe"), (3.0, "Asia"), (None, None)], "gdp double, region string")
    write_artifacts(category_maps(train, ["region"]), median_map(train, ["gdp"]), tmpdir_path)
    maps, meds = read_artifacts(spark, tmpdir_path)
    assert meds == {"gdp": 2.0}
    score = spark.createDataFrame([(None, None), (5.0, "Mars"), (None, "Asia")], "gdp double, region string")
    out = prepare_scoring(score, ["gdp", "pop"], ["region"], maps, meds)
    got = sorted((r["gdp"], r["pop"], r["region_code"]) for r in out.collect())
    codes = {r["category"]: r["code"] for r in maps.collect()}
    assert got == sorted([(2.0, 0.0, codes["UNKNOWN"]), (5.0, 0.0, -1), (2.0, 0.0, codes["Asia"])])
    # no artifacts at all: everything still scores (no null reaches the model)
    m2, med2 = read_artifacts(spark, f"{tmpdir_path}/none")
    out2 = prepare_scoring(score, ["gdp"], ["region"], m2, med2)
    assert out2.filter("gdp IS NULL OR region_code IS NULL").count() == 0


def test_separator_is_found_per_file(spark, tmpdir_path):
    from panelspark.sources.files import read_delimited

    import os

    os.makedirs(f"{tmpdir_path}/mixed")
    for name, text in (("a.csv", "Country;Year;Value\nNA;2020;1\n"), ("b.csv", "Country,Year,Value\nDE,2021,2\n"), ("c.csv", "")):
        with open(f"{tmpdir_path}/mixed/{name}", "w") as f:
            f.write(text)
    got = sorted(tuple(r) for r in read_delimited(spark, f"{tmpdir_path}/mixed").select("country", "year", "value").collect())
    assert got == [("DE", "2021", "2"), ("NA", "2020", "1")]


def test_odd_observations_do_not_empty_a_payload(spark):
    import json

    from panelspark.sources.payloads import flatten_sdmx

    dims = {"series": [{"id": "REF_AREA", "values": [{"id": "FRA", "name": "France"}]}], "observation": [{"id": "TIME", "values": [{"id": str(2000 + i)} for i in range(5)]}]}
    obs = {"0": [0.3], "1": 0.4, "2": ["0.5"], "3": [0.6, "A"], "4": [None, 1]}
    payload = {"data": {"dataSets": [{"series": {"0": {"observations": obs}}}], "structures": [{"dimensions": dims}]}}
    out = flatten_sdmx(spark.createDataFrame([(json.dumps(payload),)], "value string"))
    got = {r.time_period: r.value for r in out.collect()}
    assert got == {"2000": 0.3, "2001": 0.4, "2002": 0.5, "2003": 0.6, "2004": None}


def test_index_positions_may_begin_anywhere(spark):
    import json

    from panelspark.sources.payloads import flatten_jsonstat

    cube = {"id": ["geo"], "size": [2], "dimension": {"geo": {"category": {"index": {"B": 2, "A": 1}, "label": {"A": "a", "B": "b"}}}}, "value": {"0": 1.0, "1": 2.0}}
    out = flatten_jsonstat(spark.createDataFrame([(json.dumps(cube),)], "value string"))
    assert {r.codes["geo"]: r.value for r in out.collect()} == {"A": 1.0, "B": 2.0}


def test_a_source_that_fails_while_it_is_read(spark, tmpdir_path):
    import os

    os.makedirs(f"{tmpdir_path}/broken")
    with open(f"{tmpdir_path}/broken/part-0.parquet", "wb") as f:
        f.write(b"PAR1 not parquet PAR1")
    df, status = SL.best_effort(spark, lambda: spark.read.schema("entity string").parquet(f"{tmpdir_path}/broken"))
    assert status.startswith("failed") and df.count() == 0


def test_damaged_artifacts_raise_and_absent_ones_do_not(spark, tmpdir_path):
    import os

    import pytest

    from panelspark.sources.artifacts import read_artifacts

    assert read_artifacts(spark, f"{tmpdir_path}/none") == (None, {})
    os.makedirs(f"{tmpdir_path}/bad/feature_medians")
    with open(f"{tmpdir_path}/bad/feature_medians/part-0.parquet", "wb") as f:
        f.write(b"nothing")
    with pytest.raises(Exception):  # noqa: B017
        read_artifacts(spark, f"{tmpdir_path}/bad")


def test_years_written_as_decimals(spark):
    from panelspark.functions.columns import to_int

    df = spark.createDataFrame([("2021.0",), ("2021",), ("20x",), (None,), ("1e99",)], "y string")
    assert [r[0] for r in df.select(to_int("y")).collect()] == [2021, 2021, None, None, None]
