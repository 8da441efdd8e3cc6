"""Feature drift of scored rows against the training table.

PSI per column: ranges and totals of all columns on both sides are one
aggregate (one row, read as scalars); every value then gets a bin (10
equal-width bins; categorical codes and strings bin by value), counts per
(column, bin) with a column per side are partially aggregated, and
``sum((p - q) * ln(p / q))`` follows with shares floored at 1e-4.  Two passes
over each side, whatever the number of features; nothing per row leaves Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clean_double, report_stamp
from .joins import lookup
from ..schemas import DRIFT_REPORT
from ..params import DATASET_DRIFT_SHARE, DRIFT_PSI_THRESHOLD, MAX_REPORTS_KEPT, PSI_BINS, PSI_FLOOR


def availability(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null count per column (one aggregate over all columns), long form."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("n_nonnull")) for c in columns]
    return row.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def eligibility(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column present on both sides with at least one non-null value on each."""
    both = [c for c in columns if c in reference.columns and c in current.columns]
    ref = availability(reference, both).withColumnRenamed("n_nonnull", "n_reference")
    cur = availability(current, both).withColumnRenamed("n_nonnull", "n_current")
    return ref.join(cur, on="feature", how="inner").withColumn(
        "eligible", (F.col("n_reference") > 0) & (F.col("n_current") > 0)
    )


def eligible_columns(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> list[str]:
    rows = eligibility(reference, current, columns).filter("eligible").select("feature").collect()
    keep = {r["feature"] for r in rows}
    return [c for c in columns if c in keep]


def _stack(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], side: str, keep: Sequence[str] = ()
) -> DataFrame:
    parts = [
        F.struct(F.lit(c).alias("feature"), clean_double(c).alias("x"), F.lit(None).cast("string").alias("cat"))
        for c in numeric
    ] + [
        F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("x"), F.col(c).cast("string").alias("cat"))
        for c in categorical
    ]
    return (
        df.select(*keep, F.explode(F.array(*parts)).alias("s"))
        .select(*keep, F.lit(side).alias("side"), "s.feature", "s.x", "s.cat")
        .filter(F.col("x").isNotNull() | F.col("cat").isNotNull())
    )


def side_stats(reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> dict:
    """One aggregate over both sides: rows per side, and per column the values per side
    and the range of the finite ones on either side and on the reference (one row)."""
    cols = [*numeric, *categorical]
    both = reference.select(*cols, F.lit(True).alias("_ref")).unionByName(current.select(*cols, F.lit(False).alias("_ref")))
    aggs = [F.count_if("_ref").alias("rows_ref"), F.count_if(~F.col("_ref")).alias("rows_cur")]
    for i, c in enumerate(cols):
        v = clean_double(c) if c in numeric else F.col(c)
        aggs += [F.count(F.when(F.col("_ref"), v)).alias(f"n_ref_{i}"), F.count(F.when(~F.col("_ref"), v)).alias(f"n_cur_{i}")]
        if c in numeric:
            finite = F.when(F.abs(v) < F.lit(float("inf")), v)
            for end, f in (("lo", F.min), ("hi", F.max)):
                aggs += [f(finite).alias(f"{end}_{i}"), f(F.when(F.col("_ref"), finite)).alias(f"{end}_ref_{i}")]
    row = both.agg(*aggs).first().asDict()
    per = {c: {k[: -len(str(i)) - 1]: v for k, v in row.items() if k.endswith(f"_{i}")} for i, c in enumerate(cols)}
    return {"rows_ref": row["rows_ref"], "rows_cur": row["rows_cur"], "columns": per}


def psi(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    bins: int = PSI_BINS,
    floor: float = PSI_FLOOR,
    threshold: float = DRIFT_PSI_THRESHOLD,
    edges: str = "joint",
    stats: dict | None = None,
) -> DataFrame:
    """(column, psi, drifted) per column.

    ``edges='joint'`` bins over the min-max of both sides (default);
    ``'reference'`` over the reference only, current values clamped into the
    edge bins (used by the count-window stream, whose reference is fixed).
    NaN is no value; infinite values fall into the edge bins and do not
    stretch the range.  Two passes over each side: ``side_stats`` (ranges and
    totals, one row) and one count by (feature, bin) with a column per side.
    """
    stats = stats or side_stats(reference, current, numeric, categorical)
    ends = ("lo", "hi") if edges == "joint" else ("lo_ref", "hi_ref")
    names = [*numeric, *categorical]

    def entry(c: str):
        if c not in numeric:
            return F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("bin"))
        lo, hi = (stats["columns"][c][e] for e in ends)
        x = clean_double(c)
        at = F.when(x.isNotNull(), F.lit(0))
        if lo is not None and hi > lo:
            width = float(hi) - float(lo)
            place = F.floor((x - F.lit(float(lo))) / F.lit(width) * F.lit(float(bins))).cast("double")
            at = F.when(x.isNotNull(), F.greatest(F.least(place, F.lit(bins - 1.0)), F.lit(0.0)).cast("int"))
        return F.struct(F.lit(c).alias("feature"), at.cast("string").alias("bin"))

    sides = reference.select(*names, F.lit(True).alias("_ref")).unionByName(current.select(*names, F.lit(False).alias("_ref")))
    stacked = sides.select("_ref", F.explode(F.array(*map(entry, names))).alias("s")).select("_ref", "s.feature", "s.bin")
    counts = stacked.filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(
        F.count_if("_ref").alias("q"), F.count_if(~F.col("_ref")).alias("p")
    )

    def share(side: str, total: str):
        of = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(float(max(stats["columns"][c][total], 1))))])
        return F.greatest(F.col(side) / of[F.col("feature")], F.lit(floor))

    p, q = share("p", "n_cur"), share("q", "n_ref")
    out = counts.groupBy("feature").agg(F.sum((p - q) * F.log(p / q)).alias("psi"))
    return out.withColumn("drifted", F.col("psi") >= F.lit(threshold))


def reference_profile(
    reference: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    bins: int = PSI_BINS,
    floor: float = PSI_FLOOR,
) -> tuple[DataFrame, DataFrame]:
    """Bin edges (one row per numeric feature) and floored shares per reference bin.

    Both tables are small (features; bins x features + categories), so a
    stream can compute them once and reuse them for every micro-batch.
    """
    ref_stack = _stack(reference, numeric, categorical, "reference")
    ranges = ref_stack.filter(F.abs("x") < F.lit(float("inf"))).groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ref = _binned(ref_stack, ranges, bins).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    fl = F.lit(floor)
    totals = ref.groupBy("feature").agg(F.sum("n").alias("_total"))  # one row per feature column
    ref = ref.join(F.broadcast(totals), on="feature", how="inner")
    ref = ref.withColumn("q", F.greatest(F.col("n") / F.col("_total"), fl))
    ref = ref.withColumn("_absent", (fl - F.col("q")) * F.log(fl / F.col("q"))).select("feature", "bin", "q", "_absent")
    return ranges, ref


def _binned(stacked: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    width = F.col("hi") - F.col("lo")
    raw = F.floor((F.col("x") - F.col("lo")) / width * F.lit(float(bins))).cast("double")
    num_bin = F.when(width > 0, F.greatest(F.least(raw, F.lit(bins - 1.0)), F.lit(0.0)).cast("int")).otherwise(F.lit(0))
    # one row per feature column: bounded by the feature list
    return stacked.join(F.broadcast(ranges), on="feature", how="left").withColumn(
        "bin", F.when(F.col("x").isNotNull(), num_bin.cast("string")).otherwise(F.col("cat"))
    )


def psi_grouped(
    reference: DataFrame | None,
    current: DataFrame,
    by: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    bins: int = PSI_BINS,
    floor: float = PSI_FLOOR,
    threshold: float = DRIFT_PSI_THRESHOLD,
    profile: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """D2 for many current groups (reports) against one reference at once.

    Bins come from the reference range (current values clamped).  A bin
    missing from a group contributes ``(floor - q) ln(floor / q)``; that sum
    is taken once per feature over all reference bins and corrected for the
    bins the group has, so no (group x bin) product is ever built.  A
    precomputed ``profile`` (``reference_profile``) replaces the reference.
    """
    ranges, ref = profile if profile is not None else reference_profile(reference, numeric, categorical, bins, floor)
    fl = F.lit(floor)
    absent_all = ref.groupBy("feature").agg(F.sum("_absent").alias("_absent_all"))
    cur_stack = _stack(current.withColumn("_g", F.col(by)), numeric, categorical, "current", keep=["_g"])
    cur = _binned(cur_stack, ranges, bins).groupBy(F.col("_g").alias(by), "feature", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    # one row per report and feature, summed before it is joined: no window over all categories of a feature
    totals = cur.groupBy(by, "feature").agg(F.sum("n").alias("_total"))
    cur = lookup(cur, totals, [by, "feature"]).withColumn("p", F.greatest(F.col("n") / F.col("_total"), fl))
    # reference bins: bins x features plus the distinct categories
    j = lookup(cur, ref, ["feature", "bin"], "left")
    q = F.coalesce(F.col("q"), fl)
    per = j.groupBy(by, "feature").agg(
        F.sum((F.col("p") - q) * F.log(F.col("p") / q)).alias("_present"),
        F.sum(F.coalesce(F.col("_absent"), F.lit(0.0))).alias("_absent_seen"),
    )
    out = per.join(F.broadcast(absent_all), on="feature", how="left").select(
        by,
        "feature",
        (F.col("_present") + F.col("_absent_all") - F.col("_absent_seen")).alias("psi"),
    )
    return out.withColumn("drifted", F.col("psi") >= F.lit(threshold))


def dataset_drift(psi_df: DataFrame, share_cut: float = DATASET_DRIFT_SHARE) -> DataFrame:
    """D3: share of drifted columns and the dataset flag (one row)."""
    return psi_df.agg(
        F.count(F.lit(1)).cast("int").alias("n_columns"),
        F.sum(F.col("drifted").cast("int")).cast("int").alias("n_drifted"),
        F.avg(F.col("drifted").cast("double")).alias("share_of_drifted_columns"),
    ).withColumn("dataset_drift", F.coalesce(F.col("share_of_drifted_columns") >= F.lit(share_cut), F.lit(False)))


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    report_ts=None,
    stamp: str | None = None,
) -> DataFrame:
    """One report row for what is buffered; refusal (empty) when nothing is buffered.

    Columns not eligible on both sides (D1) are left out.  ``stamp`` names the
    report (``yyyymmddThhmmssZ``) instead of the report time.
    """
    num, cat = ([c for c in cs if c in reference.columns and c in current.columns] for cs in (numeric, categorical))
    stats = side_stats(reference, current, num, cat)
    cols = [c for c, n in stats["columns"].items() if n["n_ref"] > 0 and n["n_cur"] > 0]
    num, cat = [c for c in num if c in cols], [c for c in cat if c in cols]
    n_cur = stats["rows_cur"]
    spark = current.sparkSession
    if n_cur == 0 or not cols:
        schema = DRIFT_REPORT
        return spark.createDataFrame([], schema)
    ts = F.current_timestamp() if report_ts is None else F.lit(report_ts).cast("timestamp")
    d = dataset_drift(psi(reference, current, num, cat, stats=stats))
    return d.select(
        ts.alias("report_ts"),
        F.concat(F.lit("drift_report_"), F.lit(stamp) if stamp else report_stamp(ts), F.lit(".html")).alias(
            "report_name"
        ),
        F.lit(n_cur).cast("long").alias("n_current"),
        "n_columns",
        "n_drifted",
        "share_of_drifted_columns",
        "dataset_drift",
    )


def gauges(reports: DataFrame, ts: str = "report_ts") -> DataFrame:
    """Drift gauges = the newest report row (one partially aggregated row)."""
    row = F.struct(
        F.col("share_of_drifted_columns").alias("drift_share_of_columns"),
        F.col("dataset_drift").cast("int").alias("drift_dataset_detected"),
        F.col("report_name"),
    )
    newest = reports.agg(F.max_by(row, F.struct(F.col(ts), F.col("report_name"))).alias("r"))
    return newest.filter(F.col("r").isNotNull()).select("r.*")


def retention(reports: DataFrame, keep: int = MAX_REPORTS_KEPT, ts: str = "report_ts") -> DataFrame:
    """K4: newest ``keep`` reports, newest first (rank 1 = newest)."""
    order = [F.col(ts).desc(), F.col("report_name").desc()]
    newest = reports.orderBy(*order).limit(keep)  # keep rows from here on
    return newest.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
