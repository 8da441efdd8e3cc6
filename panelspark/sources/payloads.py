"""Flatten landed JSON payloads to long rows (S3 paged JSON, S4 SDMX-JSON,
S5 JSON-stat), with expressions only: ``parse_json`` to VARIANT,
``variant_get`` / ``try_variant_get`` for the polymorphic parts, ``explode``
for the nesting.  Each payload is one row (a landed document); its cells
are generated by the task that reads it, never by the driver.

JSON-stat cubes stay sparse: only the present cells of ``value`` are
exploded; a cell's coordinates are ``(flat div stride_i) mod size_i``, so
no cartesian product of the dimensions is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS_TYPE = "map<string,struct<category:struct<index:variant,label:map<string,string>>>>"


def _payload(df: DataFrame, column: str) -> Column:
    return F.parse_json(F.col(column))


def flatten_paged(pages: DataFrame, column: str = "value") -> DataFrame:
    """S3: ``[meta, rows]`` pages -> (entity, entity_name, time, value).

    A page whose rows element is null contributes nothing (the end of the
    paging); rows with a null value are skipped; ``date`` becomes an int.
    """
    v = pages.select(_payload(pages, column).alias("v"))
    rows = v.select(F.explode(F.try_variant_get(F.col("v"), "$[1]", "array<variant>")).alias("e"))
    return rows.select(
        F.variant_get("e", "$.countryiso3code", "string").alias("entity"),
        F.variant_get("e", "$.country.value", "string").alias("entity_name"),
        F.try_variant_get("e", "$.date", "int").alias("time"),
        F.try_variant_get("e", "$.value", "double").alias("value"),
    ).filter(F.col("value").isNotNull() & F.col("entity").isNotNull() & (F.col("entity") != ""))


SDMX_TYPE = (
    "struct<data:struct<dataSets:array<struct<series:map<string,struct<observations:map<string,variant>>>>>,"
    "structures:array<struct<dimensions:struct<"
    "series:array<struct<id:string,values:array<struct<id:string,name:string>>>>,"
    "observation:array<struct<id:string,values:array<struct<id:string,name:string>>>>>>>>>"
)


def flatten_sdmx(payloads: DataFrame, column: str = "value") -> DataFrame:
    """SDMX-JSON series/observations -> one row per observation.

    Output: ``dimensions`` (dimension id -> value id), ``labels`` (dimension
    id -> value name), ``time_period`` and ``value`` (first element of the
    observation).  Pick dimensions with ``element_at(dimensions, 'REF_AREA')``.
    """
    p = payloads.select(F.from_json(F.col(column), SDMX_TYPE).alias("p"))
    p = p.select(
        F.try_element_at("p.data.dataSets", F.lit(1)).alias("ds"),
        F.try_element_at("p.data.structures", F.lit(1)).alias("st"),
    )
    series = p.select(
        F.explode("ds.series").alias("series_key", "series_val"),
        F.col("st.dimensions.series").alias("sdims"),
        F.try_element_at("st.dimensions.observation", F.lit(1)).alias("odim"),
    )
    idx = F.transform(F.split("series_key", ":"), lambda s: s.cast("int"))
    picked = F.transform(
        F.arrays_zip(F.col("sdims").alias("d"), idx.alias("i")),
        lambda z: F.struct(
            z["d"]["id"].alias("id"),
            F.try_element_at(z["d"]["values"], z["i"] + 1)["id"].alias("code"),
            F.try_element_at(z["d"]["values"], z["i"] + 1)["name"].alias("label"),
        ),
    )

    def observed(e: Column) -> Column:
        t_index = F.split(e["key"], ":").getItem(0).try_cast("int")
        # an observation is a value, or a list of its value and attributes
        value = F.coalesce(F.try_variant_get(e["value"], "$[0]", "double"), F.try_variant_get(e["value"], "$", "double"))
        return F.struct(F.try_element_at(F.col("odim.values"), t_index + 1)["id"].alias("time_period"), value.alias("value"))

    # coordinates once per series, before its observations are taken apart
    cells = series.select(
        F.map_from_arrays(F.transform(picked, lambda x: x["id"]), F.transform(picked, lambda x: x["code"])).alias("dimensions"),
        F.map_from_arrays(F.transform(picked, lambda x: x["id"]), F.transform(picked, lambda x: x["label"])).alias("labels"),
        F.transform(F.map_entries("series_val.observations"), observed).alias("obs"),
    )
    return cells.select("dimensions", "labels", F.explode_outer("obs").alias("o")).filter(F.col("o").isNotNull()).select(
        "dimensions", "labels", "o.time_period", "o.value"
    )


def flatten_jsonstat(payloads: DataFrame, column: str = "value") -> DataFrame:
    """JSON-stat 2.0 cube -> one row per present cell.

    Category order follows the ``index`` map (code -> position) or list;
    without an index, the label keys.  ``value`` may be an object
    ``{flat index: v}`` or a dense array; null cells are skipped.  Output:
    ``codes`` and ``labels`` (dimension id -> code / label) and ``value``.
    """
    v = payloads.select(_payload(payloads, column).alias("v"))
    v = v.select(
        F.variant_get("v", "$.id", "array<string>").alias("ids"),
        F.variant_get("v", "$.size", "array<int>").alias("sizes"),
        F.variant_get("v", "$.dimension", DIMS_TYPE).alias("dims"),
        F.try_variant_get("v", "$.value", "map<string,double>").alias("vmap"),
        F.try_variant_get("v", "$.value", "array<double>").alias("varr"),
    )
    n = F.size("ids")

    def dim_info(d, i):
        cat = F.try_element_at(F.col("dims"), d)["category"]
        idx_map = F.try_variant_get(cat["index"], "$", "map<string,int>")
        idx_arr = F.try_variant_get(cat["index"], "$", "array<string>")
        size_i = F.try_element_at(F.col("sizes"), i + 1)
        # codes in the order of their positions, wherever these begin
        in_order = F.array_sort(F.transform(F.map_entries(idx_map), lambda e: F.struct(e["value"].alias("at"), e["key"].alias("code"))))
        by_pos = F.coalesce(
            F.transform(in_order, lambda e: e["code"]),
            idx_arr,
            F.map_keys(cat["label"]),
        )
        stride = F.aggregate(
            F.slice(F.col("sizes"), i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(1).cast("long"), lambda acc, x: acc * x
        )
        return F.struct(
            d.alias("id"), size_i.cast("long").alias("size"), stride.alias("stride"), by_pos.alias("codes"),
            cat["label"].alias("label_map"),
        )

    v = v.withColumn("dinfo", F.transform("ids", dim_info))
    cells = F.coalesce(
        F.transform(F.map_entries("vmap"), lambda e: F.struct(e["key"].cast("long").alias("flat"), e["value"].alias("x"))),
        F.transform("varr", lambda x, i: F.struct(i.cast("long").alias("flat"), x.alias("x"))),
    )
    c = v.select("dinfo", F.explode(cells).alias("cell")).filter(F.col("cell.x").isNotNull())
    coords = F.transform(
        "dinfo",
        lambda d: F.struct(
            d["id"].alias("id"),
            F.try_element_at(d["codes"], (F.floor(F.col("cell.flat") / d["stride"]) % d["size"]).cast("int") + 1).alias("code"),
            d["label_map"].alias("label_map"),
        ),
    )
    c = c.select(coords.alias("co"), F.col("cell.x").alias("value"))
    return c.select(
        F.map_from_arrays(F.transform("co", lambda x: x["id"]), F.transform("co", lambda x: x["code"])).alias("codes"),
        F.map_from_arrays(
            F.transform("co", lambda x: x["id"]),
            F.transform("co", lambda x: F.coalesce(F.try_element_at(x["label_map"], x["code"]), x["code"])),
        ).alias("labels"),
        "value",
    )
