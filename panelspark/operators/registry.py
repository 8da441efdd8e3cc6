"""Model registry as tables.

Versions: per target, a new version per training run.  Stage by the gate
(C10): gate present, metric present and metric >= min -> Production, else
Staging.  A passing version archives the older Production versions; a
failing one leaves them as they are.  Expressed over the whole version
history at once: a Production version becomes Archived when a later version
of the same target passed (window over the target's versions, which are few).

Storage: a parquet table partitioned by ``run`` with the whole state after
each run; the current state is the newest run (partition pruning).  One writer,
and a replayed run replaces its own folder, so a lost executor or a failed job
never leaves a half-written current state.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import gate_passed, gate_stage
from ..params import PROMOTION_GATES


def gates_table(spark: SparkSession, gates: Mapping[str, tuple[str, float]] = PROMOTION_GATES) -> DataFrame:
    rows = [(t, m, float(v)) for t, (m, v) in gates.items()]
    return spark.createDataFrame(rows, "target string, metric string, min double")


EXTRA_METRICS = ("mae", "macro_f1", "n_train", "n_test")


def version_stages(
    runs: DataFrame, gates: DataFrame, prefix: str = "panel_", extra: tuple[str, ...] = EXTRA_METRICS
) -> DataFrame:
    """M8 + C10 + J8: ``runs`` has (target, version, metric, value) in long form.

    Returns one row per (target, version): registered name, gate metric and
    value, gate min, passed flag, the resulting stage, and the ``extra``
    metrics as columns (one aggregation over the runs, read once).
    """
    g = gates.select(F.col("target"), F.col("metric").alias("gate_metric"), F.col("min").alias("gate_min"))
    # gates: one row per target
    t = (
        runs.join(F.broadcast(g), on="target", how="left")
        .groupBy("target", "version")
        .agg(
            F.first("gate_metric", ignorenulls=True).alias("gate_metric"),
            F.first("gate_min", ignorenulls=True).alias("gate_min"),
            F.max(F.when(F.col("metric") == F.col("gate_metric"), F.col("value"))).alias("metric_value"),
            *[F.max(F.when(F.col("metric") == F.lit(m), F.col("value"))).alias(f"_m_{m}") for m in extra],
        )
    )
    t = t.withColumn("passed", gate_passed("metric_value", "gate_min"))
    w_later = Window.partitionBy("target").orderBy("version").rowsBetween(1, Window.unboundedFollowing)
    later_pass = F.max(F.col("passed").cast("int")).over(w_later)
    stage = F.when(F.col("passed") & (F.coalesce(later_pass, F.lit(0)) == 1), F.lit("Archived")).otherwise(
        gate_stage("passed")
    )
    return t.select(
        "target",
        F.concat(F.lit(prefix), F.col("target")).alias("registered_name"),
        F.col("version").cast("int").alias("version"),
        stage.alias("stage"),
        F.col("gate_metric").alias("metric"),
        "metric_value",
        "gate_min",
        "passed",
        *[F.col(f"_m_{m}").alias(m) for m in extra],
    )


def next_version(existing: DataFrame | None, target: str) -> int:
    """max(version) + 1 of a target (1 for the first)."""
    if existing is None:
        return 1
    v = existing.filter(F.col("target") == F.lit(target)).agg(F.max("version")).first()[0]
    return int(v or 0) + 1


def upsert_status(status: DataFrame, new_rows: DataFrame, key: str = "target") -> DataFrame:
    """M9: only the targets in ``new_rows`` change; the others stay untouched."""
    return status.join(new_rows.select(key), on=key, how="left_anti").unionByName(new_rows)


def run_status(outcomes: DataFrame, run: str = "run", ok: str = "ok") -> DataFrame:
    """Per run, all targets ok -> success, some -> partial_success, none -> failed."""
    agg = outcomes.groupBy(run).agg(
        F.sum(F.col(ok).cast("int")).alias("n_ok"), F.count(F.lit(1)).alias("n_targets")
    )
    status = (
        F.when(F.col("n_ok") == F.col("n_targets"), F.lit("success"))
        .when(F.col("n_ok") > 0, F.lit("partial_success"))
        .otherwise(F.lit("failed"))
    )
    return agg.withColumn("status", status)


def run_targets(spark: SparkSession, run: int, jobs: Mapping[str, "callable"]) -> DataFrame:
    """Run every target's job (sequentially, on the driver: one Spark job
    graph each); a failing target does not stop the others.  Returns the
    outcome rows (run, target, ok, error) for ``run_status``."""
    rows = []
    for target, job in jobs.items():
        try:
            job()
            rows.append((int(run), target, True, None))
        except Exception as exc:  # noqa: BLE001 - record and go on with the next target
            rows.append((int(run), target, False, f"{type(exc).__name__}: {exc}"))
    return spark.createDataFrame(rows, "run int, target string, ok boolean, error string")


def serving_versions(stages: DataFrame, serve: str = "production") -> DataFrame:
    """the version each target serves.

    ``'latest'``: the newest version whatever its stage (a gated-out model is
    still served, as the original code does); ``'production'``: the newest
    Production version, no row for a target without one (as documented).
    """
    if serve not in ("latest", "production"):
        raise ValueError("serve must be 'latest' or 'production'")
    rows = stages if serve == "latest" else stages.filter(F.col("stage") == F.lit("Production"))
    return latest_per_target(rows).select("target", "version", "stage")


def latest_per_target(df: DataFrame, order: str = "version") -> DataFrame:
    """Newest row per target (A5 form over whole rows: versions per target are few)."""
    w = Window.partitionBy("target").orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def performance_view(stages: DataFrame) -> DataFrame:
    """M11 + T7: latest version per target with main metric, second metric
    (mae or macro_f1), counts, gate, stage and the model-quality alert."""
    out = latest_per_target(stages)
    return out.select(
        "target",
        "version",
        "stage",
        "metric",
        "metric_value",
        F.coalesce(F.col("mae"), F.col("macro_f1")).alias("second_metric"),
        F.when(F.col("mae").isNotNull(), F.lit("mae")).when(F.col("macro_f1").isNotNull(), F.lit("macro_f1")).alias(
            "second_metric_name"
        ),
        F.col("n_train").cast("long").alias("n_train"),
        F.col("n_test").cast("long").alias("n_test"),
        "gate_min",
        (F.col("metric_value") < F.col("gate_min")).alias("quality_alert"),
    )


def _state_before(spark: SparkSession, path: str, run: int | None = None) -> DataFrame | None:
    """State of the newest run (before ``run``); None without one."""
    try:
        t = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if run is not None:
        t = t.filter(F.col("run") < F.lit(int(run)))
    newest = t.agg(F.max("run")).first()[0]
    return None if newest is None else t.filter(F.col("run") == F.lit(newest)).drop("run")


def append_run(df: DataFrame, path: str, run: int) -> None:
    """Registry write (M9): the state after ``run``, its targets replaced and the others
    as they were, in the run's own folder; a replayed run replaces that folder."""
    before = _state_before(df.sparkSession, path, run)
    state = df if before is None else upsert_status(before, df)
    state.write.mode("overwrite").parquet(f"{path}/run={int(run)}")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """Current registry state: every target as its last run left it."""
    state = _state_before(spark, path)
    if state is None:
        raise ValueError(f"no registry at {path}")
    return state
