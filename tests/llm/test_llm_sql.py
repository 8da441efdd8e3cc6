"""Operators with an SQL form, against DuckDB on awkward rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from panelspark.llm import sql
from panelspark.llm.decontaminate import clean_documents, judge, without_spans
from panelspark.llm.mixing import mix, targets
from panelspark.llm.quality import apply_rules
from tests.llm import corpus


def same(spark_df, query: str, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=_schema(df)))
    want = con.sql(query).arrow()
    want = (want.read_all() if hasattr(want, "read_all") else want).to_pylist()
    cols = spark_df.columns
    assert want == [] or set(want[0]) == set(cols)
    key = lambda r: tuple((r[c] is None, str(r[c])) for c in sorted(cols))
    got = sorted([r.asDict() for r in spark_df.collect()], key=key)
    assert got == sorted(want, key=key)


def _schema(df):
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in df.schema])


@pytest.mark.parametrize("data", [None, []])
def test_quality_rules(spark, data):
    docs = corpus.frame(spark, data)
    out = apply_rules(docs, keep=["doc_id"])
    same(out, sql.ORACLE_SQL["op1_quality_rules"], documents=docs)


def test_quality_keeps_other_columns(spark):
    docs = corpus.clashing(spark)
    out = apply_rules(docs)
    assert out.count() == docs.count()
    assert dict(out.dtypes)["kept"] == "boolean" and "a.b" in out.columns


def test_quality_small_groups_take_the_fences_of_more_rows(spark):
    data = [(i, "word " * 3 + f"text number {i} with some more words in it now", "en", "big" if i < 300 else f"s{i}", 0) for i in range(310)]
    data.append((999, "### $$$ %%% &&& *** <<< >>> ||| ### $$$ %%% text", "en", "alone", 0))
    out = {r.doc_id: r for r in apply_rules(corpus.frame(spark, data), keep=["doc_id"]).collect()}
    assert out[999].failed_rules.startswith("symbols") and out[305].kept


@pytest.mark.parametrize("data", [None, [], [(1, None, "en", "s", 0), (2, "", None, None, 0)]])
def test_mixing(spark, data):
    docs = corpus.frame(spark, data)
    same(mix(docs, keep=["doc_id"]), sql.ORACLE_SQL["op4_mixing"], documents=docs)


def test_mix_comes_near_its_targets(spark):
    data = [(i, "w " * (1 + i % 37), "en", f"s{i % 5}" if i % 3 else "hot", 0) for i in range(3000)]
    out = mix(corpus.frame(spark, data)).toPandas()
    by = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert ((by.taken - by.target).abs() <= 20).all()
    assert (out.taken <= 3 * out["size"]).all()
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6


def test_targets_reshare_what_small_sources_cannot_take(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in targets(sizes).collect()}
    assert got["a"] == 3.0 and got[None] == 0.0
    assert got["b"] == 300.0 and got["c"] == 1101 - 303


def test_mix_keeps_clashing_columns(spark):
    out = mix(corpus.clashing(spark))
    assert dict(out.dtypes)["size"] == "bigint" and out.count() == len(corpus.rows())


@pytest.mark.parametrize(("data", "items"), [(None, None), ([], None), (None, [])])
def test_decontamination(spark, data, items):
    docs, bench = corpus.frame(spark, data), corpus.benchmark(spark, items)
    out = judge(docs, bench, keep=["doc_id"]).drop("hit_spans")
    if items is None:  # a null item id is the text of no id
        bench = bench.fillna({"item_id": -1})
        out = judge(docs, bench, keep=["doc_id"]).drop("hit_spans")
    same(out, sql.ORACLE_SQL["op9_decontamination"], documents=docs, benchmark=bench)


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    from panelspark.llm import decontaminate

    docs, bench = corpus.frame(spark), corpus.benchmark(spark)
    key = lambda r: str(r)
    want = sorted(judge(docs, bench, keep=["doc_id"]).drop("hit_spans").collect(), key=key)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 1)
    assert sorted(judge(docs, bench, keep=["doc_id"]).drop("hit_spans").collect(), key=key) == want
    # a beginning that holds most places, and documents that come twice
    many = [(i % 300, "one two " * 200 + f"w{i % 300}", "en", "s", 1) for i in range(400)]
    same(judge(corpus.frame(spark, many), bench, keep=["doc_id"]).drop("hit_spans"), sql.ORACLE_SQL["op9_decontamination"], documents=corpus.frame(spark, many), benchmark=bench.fillna({"item_id": -1}))


def test_the_shuffle_beyond_the_bound_carries_no_words(spark):
    from panelspark.llm import decontaminate

    docs = corpus.frame(spark).selectExpr("doc_id as d", "xxhash64(text) as x", "split(text, ' ') as w")
    at = docs.selectExpr("d", "x", "w", "posexplode_outer(transform(w, y -> xxhash64(y))) as (i, h)").selectExpr("d", "x", "i", "size(w) as n", "h")
    keys = spark.range(1000).selectExpr("id as h", "13 as m")
    plan = decontaminate._dealt(at, keys)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = [part.split("Input [", 1)[1].splitlines()[0] for part in plan.split("\n\n") if ") Exchange" in part and "Input [" in part]
    assert dealt and not any("w#" in columns or "text#" in columns for columns in dealt)


def test_clean_documents_are_left_as_they_are(spark):
    docs, bench = corpus.clashing(spark), corpus.benchmark(spark)
    bad = judge(corpus.frame(spark), bench).filter("contaminated").count()
    clean = clean_documents(docs, bench)
    assert bad > 0 and clean.count() == docs.count() - bad and clean.columns == docs.columns


def test_spans_are_cut_from_texts(spark):
    bench = spark.createDataFrame([(1, "two, Three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "One two three; four"), (2, "two"), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in without_spans(docs, bench).collect()} == {1: "One; four", 2: "two", 3: None}


def test_salted_join_gives_the_same_rows(spark):
    from panelspark.llm.common import join_small

    docs = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(50)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), (None, 2)], "k string, v int")
    few = sorted(map(tuple, join_small(docs, small, ["k"]).collect()), key=str)
    many = sorted(map(tuple, join_small(docs, small, ["k"], max_rows=1).collect()), key=str)
    assert few == many and len(few) == 50 and pd.Series([r[2] for r in few]).notna().all()
