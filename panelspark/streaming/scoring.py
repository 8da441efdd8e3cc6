"""M6 on a stream: arriving rows are scored with what the registry serves.

Every micro-batch reads the version that the registry serves for the target, takes that version's model, medians and
category maps (kept by version while the query runs) and writes its rows to the batch's own folder.  The version of a
batch is noted before it is scored: a batch that runs again, after a failure or a restart, takes the noted version and replaces its
own folder, so rows are neither lost nor doubled, and a promotion changes the rows of later batches only.

Defined results: omitted or null numbers take the stored median, else 0.0; unseen categories are -1, null and empty ones
UNKNOWN; a target without a served version raises; a batch without rows writes an empty folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boosting import Boosted, load_boosted, predict, save_boosted
from ..operators.registry import read_current, serving_versions
from ..sources.artifacts import prepare_scoring, read_artifacts, write_artifacts

Scorer = Callable[[DataFrame], DataFrame]


def write_version(spark: SparkSession, folder: str, target: str, version: int, model: Boosted, maps: DataFrame, medians: DataFrame) -> None:
    """Lands a version's model and maps, before the registry names it."""
    save_boosted(spark, model, f"{folder}/{target}/v{version}/model")
    write_artifacts(maps, medians, f"{folder}/{target}/v{version}")


def read_version(spark: SparkSession, folder: str, target: str, version: int, numeric: Sequence[str], categorical: Sequence[str]) -> Scorer:
    """Scoring with a landed version; adds ``prediction`` (and ``probabilities`` for classes)."""
    path = f"{folder}/{target}/v{version}"
    model = load_boosted(spark, f"{path}/model")
    maps, medians = read_artifacts(spark, path)
    return lambda df: predict(model, prepare_scoring(df, numeric, categorical, maps, medians))


def served_version(spark: SparkSession, registry: str, target: str, serve: str = "production") -> int:
    row = serving_versions(read_current(spark, registry), serve).filter(F.col("target") == target).first()  # a row per target
    if row is None:
        raise ValueError(f"the registry serves no version of {target}")
    return int(row["version"])


def _noted(spark: SparkSession, path: str) -> int | None:
    try:
        return int(spark.read.parquet(path).first()["version"])
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def batch_scorer(version_now: Callable[[], int], load: Callable[[int], Scorer], root: str) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: scores a micro-batch into ``root/scored/batch=<id>`` with ``model_version``."""
    loaded: dict[int, Scorer] = {}

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        note = f"{root}/versions/batch={epoch}"
        version = _noted(spark, note)
        if version is None:
            version = version_now()
            spark.createDataFrame([(version,)], "version int").write.mode("overwrite").parquet(note)
        if version not in loaded:
            loaded.clear()
            loaded[version] = load(version)
        scored = loaded[version](batch).withColumn("model_version", F.lit(version))
        scored.write.mode("overwrite").parquet(f"{root}/scored/batch={epoch}")

    return write


def score_stream(stream: DataFrame, version_now: Callable[[], int], load: Callable[[int], Scorer], root: str) -> DataFrame:
    """Scores what is available and returns the scored table (run again with the same ``root``: goes on there)."""
    spark = stream.sparkSession
    writer = stream.writeStream.foreachBatch(batch_scorer(version_now, load, root)).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{root}/scored").parquet(f"{root}/scored/batch=*")
