"""What a run stores and reads back: the first source there is (S8), models (S12), metric rows (S13), the list of features (P10), cubes in files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.boosting import fit, load_boosted, predict, save_boosted
from ..operators.evaluation import regression_metrics
from ..operators.features import category_maps, encode
from ..params import PanelParams
from ..schemas import METRICS
from ..session import scratch_path
from ..sources.cubes import read_jsonstat
from ..sources.long import append_metrics, first_existing
from . import driver_tables as D
from .boost_queries import EDGES, FEATURES, PARAMS, _rows
from .boost_sql import boosted
from .catalog import query, rounded
from .oracle import SQL, r4
from .source_queries import jsonstat_payloads


@query("first_existing")
def q_first_existing(spark, sf_dir):
    """Nations by a file that overrides them where there is one, else by the table."""
    nation = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    override = scratch_path(spark, "override")
    nation.filter("n_nationkey % 2 = 0").write.parquet(override)
    default = f"{sf_dir.rstrip('/')}/nation.parquet"
    picked = [first_existing(spark, [p, default], lambda p: spark.read.parquet(p).select("n_nationkey", "n_name"), nation.schema) for p in (override, override + "-absent")]
    none = first_existing(spark, [override + "-absent"], spark.read.parquet, nation.schema)
    parts = [df.withColumn("picked", F.lit(name)) for df, name in zip([*picked, none], ("override", "default", "none"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL["first_existing"] = """SELECT n_nationkey, n_name, 'override' AS picked FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, n_name, 'default' FROM nation"""


def _loaded(spark, sf_dir):
    """The boosted model, stored and read back."""
    path = scratch_path(spark, "boosted")
    save_boosted(spark, fit(_rows(spark, sf_dir), FEATURES, "price", PARAMS, EDGES), path)
    return load_boosted(spark, path)


@query("load_and_score")
def q_load_and_score(spark, sf_dir):
    return rounded(predict(_loaded(spark, sf_dir), _rows(spark, sf_dir)).select("l_orderkey", "l_linenumber", "prediction"))


SQL["load_and_score"] = SQL["boost_regress"]


@query("metrics_table")
def q_metrics_table(spark, sf_dir):
    """Metrics of two versions (the second judged on returned items), appended one after the other."""
    path = scratch_path(spark, "metrics")
    scored = predict(_loaded(spark, sf_dir), _rows(spark, sf_dir))
    for version, rows in ((1, scored), (2, scored.filter("flag = 'R'"))):
        of = regression_metrics(rows, "price", "prediction").first().asDict()
        append_metrics(spark, [("price", version, m, None if of[m] is None else float(of[m])) for m in ("r2", "mae", "n_test")], path)
    return rounded(spark.read.schema(METRICS).parquet(path))


SQL["metrics_table"] = f"""
WITH {boosted(False)},
scored AS (SELECT t, m, flag FROM state JOIN li USING (i)),
versions AS (SELECT 1 AS version, t, m FROM scored UNION ALL SELECT 2, t, m FROM scored WHERE flag = 'R'),
told AS (SELECT version, unnest([{{'metric': 'r2', 'value': 1 - sum((t - m) * (t - m)) / (count(*) * var_pop(t))}}, {{'metric': 'mae', 'value': avg(abs(t - m))}},
    {{'metric': 'n_test', 'value': CAST(count(*) AS DOUBLE)}}], recursive := true) FROM versions GROUP BY version)
SELECT 'price' AS target, version, metric, {r4("value")} AS value FROM told"""


@query("feature_columns")
def q_feature_columns(spark, sf_dir):
    """The features of a model in their order, numeric ones before codes, with the sum of each."""
    params = PanelParams(numeric_features=["l_quantity", "l_tax"], categorical_features=["l_linestatus", "l_returnflag"])
    items = D.table(spark, sf_dir, "lineitem").select(*params.numeric_features, *params.categorical_features)
    features = encode(items, category_maps(items, params.categorical_features), params.categorical_features)
    columns = params.feature_columns()
    sums = features.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("total")) for i, c in enumerate(columns)])
    return rounded(sums.select(F.inline(pairs)))


SQL["feature_columns"] = f"""
WITH codes AS (SELECT l_quantity, l_tax, dense_rank() OVER (ORDER BY coalesce(l_linestatus, 'UNKNOWN')) - 1 AS a, dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'UNKNOWN')) - 1 AS b FROM lineitem)
SELECT position, feature, {r4("CAST(total AS DOUBLE)")} AS total FROM (
    SELECT 0 AS position, 'l_quantity' AS feature, sum(CAST(l_quantity AS DOUBLE)) AS total FROM codes UNION ALL SELECT 1, 'l_tax', sum(CAST(l_tax AS DOUBLE)) FROM codes
    UNION ALL SELECT 2, 'l_linestatus_code', sum(a) FROM codes UNION ALL SELECT 3, 'l_returnflag_code', sum(b) FROM codes)"""


@query("read_jsonstat_partitioned")
def q_read_jsonstat_partitioned(spark, sf_dir):
    """The cubes of ``flatten_jsonstat`` as files, a file a cube, read by ranges of 16 KB."""
    path = scratch_path(spark, "cubes")
    jsonstat_payloads(spark, sf_dir).write.option("maxRecordsPerFile", 1).text(path)
    cells = read_jsonstat(spark, path, 16 * 1024)
    at = lambda of, d: F.element_at(of, F.lit(d))
    return rounded(cells.select(at("codes", "geo").alias("entity"), at("labels", "geo").alias("entity_name"), at("codes", "time").cast("int").alias("time"), "value"))


SQL["read_jsonstat_partitioned"] = SQL["flatten_jsonstat"]
