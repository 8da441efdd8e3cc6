"""Registered queries for sources and sinks.

Payloads (paged JSON, SDMX-JSON, JSON-stat) are built from orders with
``to_json`` in bounded pages / blocks (at most 100 orders per page, 100
customers per cube), then flattened back; the oracle is the plain
aggregate on orders.  Round trips write to a fresh folder under the
cluster's checkpoint folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import panel as P
from ..schemas import DEFAULT_ROLES as R
from ..schemas import long_schema
from ..session import scratch_path
from ..sources import files as SF
from ..sources import long as SL
from ..sources import payloads as PL
from . import driver_tables as D
from .catalog import coalesced_panel, query, rounded

PAGE = 100  # rows per landed page / customers per cube


def _orders_named(spark, sf_dir) -> DataFrame:
    o = D.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey, "left")


def paged_payloads(spark, sf_dir) -> DataFrame:
    """Orders as ``[meta, rows]`` pages of at most 100 rows, plus one end page (null rows)."""
    o = _orders_named(spark, sf_dir)
    page = F.floor(F.col("o_orderkey") / F.lit(PAGE)).cast("long")
    item = F.struct(
        F.col("o_custkey").cast("string").alias("countryiso3code"),
        F.struct(F.col("c_name").alias("value")).alias("country"),
        F.year("o_orderdate").cast("string").alias("date"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias(
            "value"
        ),
    )
    pages = o.groupBy(page.alias("page")).agg(F.collect_list(item).alias("rows"))
    body = F.concat(
        F.lit("["),
        F.to_json(F.struct(F.col("page").alias("page"))),
        F.lit(","),
        F.to_json(F.col("rows"), {"ignoreNullFields": "false"}),
        F.lit("]"),
    )
    data = pages.select(body.alias("value"))
    end = data.limit(1).select(F.lit('[{"page": -1}, null]').alias("value"))
    return data.unionByName(end)


@query("flatten_paged")
def q_flatten_paged(spark, sf_dir):
    return rounded(PL.flatten_paged(paged_payloads(spark, sf_dir)))


def _cells(spark, sf_dir, by_status: bool) -> DataFrame:
    o = _orders_named(spark, sf_dir)
    keys = [F.col("o_custkey"), F.col("c_name")] + ([F.col("o_orderstatus")] if by_status else [])
    return o.groupBy(*keys, F.year("o_orderdate").cast("int").alias("year")).agg(F.avg("o_totalprice").alias("v"))


def _years(spark, sf_dir) -> list[int]:
    # the distinct order years: bounded by the time span
    rows = D.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct().collect()
    return sorted(r["y"] for r in rows)


def _blocked_customers(spark, sf_dir) -> DataFrame:
    """Customers with orders, in blocks of at most 100, with their position in the block."""
    cust = _cells(spark, sf_dir, False).select("o_custkey", "c_name").distinct()
    cust = cust.withColumn("block", F.floor(F.col("o_custkey") / F.lit(PAGE)).cast("long"))
    w = Window.partitionBy("block").orderBy("o_custkey")  # <= 100 rows per block
    return cust.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def sdmx_payloads(spark, sf_dir) -> DataFrame:
    years = _years(spark, sf_dir)
    ylist = F.array(*[F.lit(str(y)) for y in years])
    cells = _cells(spark, sf_dir, True)
    cust = _blocked_customers(spark, sf_dir)
    j = cells.join(cust.select("o_custkey", "block", "pos"), on="o_custkey", how="inner")
    st_idx = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    t_idx = (F.array_position(ylist, F.col("year").cast("string")) - 1).cast("string")
    series = j.groupBy("block", "pos", st_idx.alias("st")).agg(
        F.map_from_entries(F.collect_list(F.struct(t_idx, F.array(F.col("v"))))).alias("observations")
    )
    series = series.groupBy("block").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("st").cast("string")),
                    F.struct(F.col("observations").alias("observations")),
                )
            )
        ).alias("series")
    )
    values = cust.groupBy("block").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "o_custkey", "c_name"))),
            lambda x: F.struct(x["o_custkey"].cast("string").alias("id"), x["c_name"].alias("name")),
        ).alias("area_values")
    )
    status_dim = F.struct(
        F.lit("STATUS").alias("id"),
        F.array(*[F.struct(F.lit(s).alias("id"), F.lit(s).alias("name")) for s in ["F", "O", "P"]]).alias("values"),
    )
    time_dim = F.struct(
        F.lit("TIME_PERIOD").alias("id"),
        F.array(*[F.struct(F.lit(str(y)).alias("id"), F.lit(str(y)).alias("name")) for y in years]).alias("values"),
    )
    doc = series.join(values, on="block", how="inner").select(
        F.to_json(
            F.struct(
                F.struct(
                    F.array(F.struct(F.col("series").alias("series"))).alias("dataSets"),
                    F.array(
                        F.struct(
                            F.struct(
                                F.array(
                                    F.struct(F.lit("REF_AREA").alias("id"), F.col("area_values").alias("values")),
                                    status_dim,
                                ).alias("series"),
                                F.array(time_dim).alias("observation"),
                            ).alias("dimensions")
                        )
                    ).alias("structures"),
                ).alias("data")
            )
        ).alias("value")
    )
    return doc


@query("flatten_sdmx")
def q_flatten_sdmx(spark, sf_dir):
    flat = PL.flatten_sdmx(sdmx_payloads(spark, sf_dir))
    return rounded(
        flat.select(
            F.element_at("dimensions", F.lit("REF_AREA")).alias("entity"),
            F.element_at("labels", F.lit("REF_AREA")).alias("entity_name"),
            F.element_at("dimensions", F.lit("STATUS")).alias("status"),
            F.col("time_period").cast("int").alias("time"),
            "value",
        )
    )


def jsonstat_payloads(spark, sf_dir) -> DataFrame:
    years = _years(spark, sf_dir)
    ylist = F.array(*[F.lit(str(y)) for y in years])
    n_time = len(years)
    cells = _cells(spark, sf_dir, False)
    cust = _blocked_customers(spark, sf_dir)
    j = cells.join(cust.select("o_custkey", "block", "pos"), on="o_custkey", how="inner")
    flat = (F.col("pos") * F.lit(n_time) + F.array_position(ylist, F.col("year").cast("string")) - 1).cast("string")
    vals = j.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct(flat, F.col("v")))).alias("value"))
    # index map given in reverse key order: order must come from the positions, not the keys
    geo = cust.groupBy("block").agg(
        F.map_from_entries(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("o_custkey").cast("string"), "pos"))))).alias("index"),
        F.map_from_entries(F.collect_list(F.struct(F.col("o_custkey").cast("string"), "c_name"))).alias("label"),
        F.count(F.lit(1)).cast("int").alias("n_geo"),
    )
    doc = vals.join(geo, on="block", how="inner").select(
        F.to_json(
            F.struct(
                F.array(F.lit("geo"), F.lit("time")).alias("id"),
                F.array(F.col("n_geo"), F.lit(n_time)).alias("size"),
                F.struct(
                    F.struct(F.struct(F.col("index").alias("index"), F.col("label").alias("label")).alias("category")).alias(
                        "geo"
                    ),
                    F.struct(F.struct(ylist.alias("index")).alias("category")).alias("time"),
                ).alias("dimension"),
                F.col("value").alias("value"),
            )
        ).alias("value")
    )
    return doc


@query("flatten_jsonstat")
def q_flatten_jsonstat(spark, sf_dir):
    flat = PL.flatten_jsonstat(jsonstat_payloads(spark, sf_dir))
    return rounded(
        flat.select(
            F.element_at("codes", F.lit("geo")).alias("entity"),
            F.element_at("labels", F.lit("geo")).alias("entity_name"),
            F.element_at("codes", F.lit("time")).cast("int").alias("time"),
            "value",
        )
    )


# ---------------------------------------------------------------- round trips


@query("long_roundtrip")
def q_long_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "long")
    SL.write_long(D.orders_long(spark, sf_dir), path)
    back = SL.read_long(spark, path, long_schema(entity_type=T.LongType()))
    return rounded(back.select(*R.long_columns))


@query("panel_roundtrip")
def q_panel_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "panel")
    panel = coalesced_panel(spark, sf_dir)
    SL.write_panel(panel, path)
    back = spark.read.parquet(path)
    return rounded(back.select(R.entity, R.time, "priority_level", "urgent_share", "gini_index", "gini_source"))


@query("absent_source")
def q_absent_source(spark, sf_dir):
    schema = long_schema(entity_type=T.LongType())
    present = D.orders_long(spark, sf_dir)
    missing = SL.read_long(spark, f"{sf_dir.rstrip('/')}/no_such_source.parquet", schema)
    failed, _ = SL.best_effort(spark, lambda: spark.read.schema(schema).parquet(f"{sf_dir}/also_missing"), schema)
    u = P.union_sources([present, missing, failed])
    return rounded(u.groupBy(R.source).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(R.value).alias("total_value")))


# ---------------------------------------------------------------- file sources


@query("entity_dimension")
def q_entity_dimension(spark, sf_dir):
    dim = D.entity_dimension(spark, sf_dir)
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    rows = c.join(dim, c.c_custkey == dim[R.entity], "inner").select(
        F.to_json(
            F.struct(
                F.col("c_custkey").cast("string").alias("id"),
                F.col("c_name").alias("name"),
                F.struct(
                    F.when(F.col("c_acctbal") < 0, F.lit("Aggregates")).otherwise(F.col("income_group")).alias("value")
                ).alias("incomeLevel"),
                F.struct(F.col("region").alias("value")).alias("region"),
            )
        ).alias("value")
    )
    path = scratch_path(spark, "entities")
    rows.write.text(path)
    out = SF.read_entity_metadata(spark, path)
    return out.withColumn("entity", F.col("entity").cast("long"))


@query("sniffed_csv")
def q_sniffed_csv(spark, sf_dir):
    n = D.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias(" N_NationKey "), F.col("n_name").alias("N_Name"), F.col("n_regionkey").alias("N_RegionKey ")
    )
    path = scratch_path(spark, "nation-csv")
    # two files with their own separators in one folder
    for sep, part in ((";", "n_nationkey % 2 = 0"), (",", "n_nationkey % 2 = 1")):
        n.filter(F.expr(part.replace("n_nationkey", "` N_NationKey `"))).write.mode("append").option("header", True).option("sep", sep).csv(path)
    back = SF.read_delimited(spark, path, required=["n_nationkey", "n_name"])
    return back.select(
        F.col("n_nationkey").try_cast("int").alias("n_nationkey"),
        "n_name",
        F.col("n_regionkey").try_cast("int").alias("n_regionkey"),
    )


COHORT_COLUMNS = {
    "code": "entity",
    "country": "entity_name",
    "cohort": "birth_cohort",
    "BETA": "intergen_income_elasticity",
    "COR": "intergen_rank_correlation",
}


@query("cohort_csv")
def q_cohort_csv(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # nation is a fixed 25-row code list
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "inner").select(
        F.col("n_name").alias("code"),
        F.col("n_name").alias("country"),
        F.col("c_custkey").alias("cohort"),
        (F.col("c_acctbal") / F.lit(10000.0)).alias("BETA"),
        (F.col("c_acctbal") / F.lit(20000.0)).alias("COR"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("father")).otherwise(F.lit("avg")).alias("parent"),
        F.lit("all").alias("child"),
    )
    path = scratch_path(spark, "cohorts")
    rows.write.option("header", True).csv(path)
    back = SF.pooled(SF.read_cohorts(spark, path, COHORT_COLUMNS))
    typed = back.select(
        "entity",
        F.col("birth_cohort").try_cast("long").alias("birth_cohort"),
        F.col("intergen_income_elasticity").try_cast("double").alias("intergen_income_elasticity"),
        F.col("intergen_rank_correlation").try_cast("double").alias("intergen_rank_correlation"),
    ).dropna(subset=["entity"])
    latest = P.latest_nonnull(typed, "entity", "birth_cohort", ["intergen_income_elasticity", "intergen_rank_correlation"])
    return rounded(latest)
