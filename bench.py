"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full into Spark's ``noop`` sink (no collect to
the driver).  Prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
Model training queries are left out of the
headline set; set BENCH_MODELS=1 to include them.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.plans.all import QUERIES  # noqa: E402
from panelspark.session import build_session, size_shuffles  # noqa: E402

MODEL_QUERIES = {"boost_classify", "boost_regress", "load_and_score", "metrics_table", "stream_score", "gbt_regress", "rf_regress", "rf_classify", "model_metrics", "attribution_topn"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    with_models = os.environ.get("BENCH_MODELS", "0") == "1"
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus * 2, 8), app="panelspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    input_bytes = sum(
        os.path.getsize(os.path.join(root, f)) for root, _, files in os.walk(sf_dir) for f in files if f.endswith(".parquet")
    )
    partitions = size_shuffles(spark, input_bytes)
    if os.environ.get("BENCH_SHUFFLE_PARTITIONS"):
        partitions = int(os.environ["BENCH_SHUFFLE_PARTITIONS"])
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    names = only or [q for q in QUERIES if with_models or q not in MODEL_QUERIES]
    # warm-up (JVM, codegen caches): not timed
    QUERIES["pivot_mean"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001 - report and go on
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "shuffle_partitions": partitions,
        "n_queries": len(timings),
    }
    if failed:
        out["failed"] = failed
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
