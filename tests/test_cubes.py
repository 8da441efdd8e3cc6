from __future__ import annotations

import json
import os
import random

import pytest

from panelspark.sources.cubes import read_jsonstat
from panelspark.sources.payloads import flatten_jsonstat

DIMS = {
    "geo": {"category": {"index": {'B"{,': 1, "A\\": 0, "C": 2}, "label": {"A\\": "A ] land", 'B"{,': 'B: "value": {'}}},
    "time": {"category": {"index": [str(y) for y in range(1990, 2030)]}},
    "unit": {"category": {"label": {"x": "Ex"}}},
}


def cube(dense: bool, rng: random.Random) -> dict:
    cells = {i: rng.choice([None, 1.5, -2e-7, 3.0, rng.random()]) for i in range(120)}
    value = list(cells.values()) if dense else {str(i): cells[i] for i in rng.sample(range(120), 70)}
    return {"id": ["geo", "time", "unit"], "size": [3, 40, 1], "dimension": DIMS, "value": value, "note": 'a "]} \\', "extension": {"value": {"0": 9.0}}}


def told(df):
    return sorted(((sorted(r.codes.items()), sorted(r.labels.items()), r.value) for r in df.collect()), key=str)


@pytest.mark.parametrize("step", [61, 1000, 1 << 20])
def test_ranges_of_any_size_give_the_cells_of_the_whole_payload(spark, tmp_path, step):
    rng = random.Random(step)
    texts = []
    for n in range(2 if step == 61 else 4):
        members = list(cube(n % 2 == 0, rng).items())
        rng.shuffle(members)  # value may come before what describes it
        texts.append(json.dumps(dict(members), indent=None if n < 2 else 1, ensure_ascii=n != 1))
        (tmp_path / f"{n}.json").write_text(texts[-1])
    want = told(flatten_jsonstat(spark.createDataFrame([(t,) for t in texts], "value string")))
    assert want and told(read_jsonstat(spark, str(tmp_path), step)) == want


def test_files_without_cells(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text('{"id": ["geo"], "size": [3], "dimension": {}}')
    (tmp_path / "c.json").write_text(json.dumps({"id": ["t"], "size": [2], "dimension": {"t": {"category": {"index": ["1", "2"]}}}, "value": {}}))
    assert read_jsonstat(spark, str(tmp_path)).collect() == []
    os.remove(tmp_path / "c.json")
    (tmp_path / "d.json").write_text(json.dumps({"id": ["t"], "size": [2], "dimension": {"t": {"category": {"index": ["1", "2"]}}}, "value": [None, 4, 5]}))
    assert [(r.flat, r.codes, r.value) for r in read_jsonstat(spark, str(tmp_path)).collect()] == [(1, {"t": "2"}, 4.0)]  # the third has no place


def test_many_small_ranges_share_tasks(spark, tmp_path):
    rng = random.Random(2)
    for n in range(12):
        (tmp_path / f"{n}.json").write_text(json.dumps(cube(n % 2 == 0, rng)))
    assert read_jsonstat(spark, str(tmp_path), 61).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
