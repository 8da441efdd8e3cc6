from __future__ import annotations

from panelspark.operators.coverage import covered, merged, seen


def test_maps_of_loads_merge_and_a_repeated_load_changes_nothing(spark):
    schema = "entity string, time int, value double"
    first = [("a", 1990, 1.0), ("a", 1990, 2.0), ("a", 2015, 1.0), ("b", 2000, None), (None, 2000, 1.0), ("c", None, 1.0), ("d", -5, 1.0), ("d", 0, 1.0)]
    second = [("a", 1990, 3.0), ("a", 1953, 3.0), ("b", 2001, 1.0), ("b", 2064, 1.0)]
    one, two = (seen(spark.createDataFrame(rows, schema)) for rows in (first, second))
    counts = lambda *maps: {r["entity"]: r["n_times"] for r in covered(merged(*maps), 1).collect()}
    assert counts(one) == {"a": 2, "b": 1, "d": 2}
    assert counts(one, two) == counts(two, one, one, two) == {"a": 3, "b": 3, "d": 2}
    assert [r["entity"] for r in covered(merged(one, two), 3).orderBy("entity").collect()] == ["a", "b"]
    assert counts(seen(spark.createDataFrame([], schema))) == {}
