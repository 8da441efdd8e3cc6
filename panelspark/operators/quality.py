"""Row constraints (Q1-Q3), leakage check (Q4) and the run report.

A rule table becomes one boolean check per rule.  Kept rows pass one
filter over the OR of the checks (whole-stage codegen, no lambda); the
failure table takes the failing rows only and explodes one (rule, value)
entry per failed rule, with the row keys.  Validation only drops rows, it
never changes values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One constraint.  ``kind``: 'range' (lo <= x <= hi), 'ge' (x >= lo),
    'length' (lo <= length(x) <= hi).  Bounds inclusive; null passes unless
    ``nullable`` is False; ``coerce`` makes a non-numeric text a failure."""

    name: str
    column: str
    kind: str
    lo: float | None = None
    hi: float | None = None
    nullable: bool = True
    required: bool = False
    coerce: bool = True


def panel_rules(start_year: int, end_year: int, entity: str = "entity", time: str = "time") -> list[Rule]:
    """The panel constraints of the original pipeline, as a rule table."""
    # fixed values: constrained columns and their bounds
    pct = [
        "gini_index",
        "unemployment_rate",
        "urban_population_pct",
        "social_spending_pct_gdp",
        "tax_revenue_pct_gdp",
    ]
    nonneg = ["gdp_per_capita_ppp", "population_total"]
    rules = [
        Rule("key_length", entity, "length", 3, 3, nullable=False, required=True, coerce=False),
        Rule("year_range", time, "range", start_year, end_year, nullable=False, required=True),
    ]
    rules += [Rule(f"{c}_range", c, "range", 0, 100) for c in pct]
    rules += [Rule(f"{c}_nonneg", c, "ge", 0) for c in nonneg]
    return rules


def _check(rule: Rule, raw: Column) -> Column:
    """True when the row fails the rule."""
    if rule.kind == "length":
        x = F.length(raw.cast("string"))
        ok = (x >= F.lit(rule.lo)) & (x <= F.lit(rule.hi))
        coerce_fail = F.lit(False)
    else:
        x = raw.try_cast("double") if rule.coerce else raw
        coerce_fail = raw.isNotNull() & x.isNull() if rule.coerce else F.lit(False)
        # NaN is no value: it passes and fails as null does
        nan = F.coalesce(F.isnan(raw.try_cast("double")), F.lit(False))
        raw = F.when(~nan, raw)
        coerce_fail = coerce_fail & ~nan
        if rule.kind == "range":
            ok = (x >= F.lit(rule.lo)) & (x <= F.lit(rule.hi))
        elif rule.kind == "ge":
            ok = x >= F.lit(rule.lo)
        else:
            raise ValueError(f"unknown rule kind {rule.kind}")
    null_fail = raw.isNull() if not rule.nullable else F.lit(False)
    return null_fail | coerce_fail | (raw.isNotNull() & ~F.coalesce(ok, F.lit(True)) & ~coerce_fail)


def active_rules(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Optional rules on absent columns are skipped; a required absent column raises (F9, own choice)."""
    out = []
    for r in rules:
        if r.column in df.columns:
            out.append(r)
        elif r.required:
            raise ValueError(f"required column {r.column!r} missing for rule {r.name!r}")
    return out


def failed_rules(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """Array of the names of the rules a row fails (Q2: all failures, not the first)."""
    flags = [F.when(_check(r, F.col(r.column)), F.lit(r.name)) for r in rules]
    if not flags:
        return F.array().cast("array<string>")
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def any_failure(rules: Sequence[Rule], checks: Sequence[Column] | None = None) -> Column:
    """True when a row fails at least one rule (plain boolean logic, stays in codegen)."""
    checks = list(checks) if checks is not None else [_check(r, F.col(r.column)) for r in rules]
    out = F.lit(False)
    for c in checks:
        out = out | c
    return out


def validate(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Q1 + Q2 + Q3: (kept rows, failures as rule / keys / value).

    Kept rows are one filter over the OR of the rule checks; the failure
    table takes only failing rows, builds one (rule, value) entry per rule
    and explodes them, keeping the non-null ones.
    """
    rules = active_rules(df, rules)
    checks = [_check(r, F.col(r.column)) for r in rules]
    bad = any_failure(rules, checks)
    kept = df.filter(~bad)
    keys = list(keys) if keys else [c for c in df.columns]
    entries = [
        F.when(c, F.struct(F.lit(r.name).alias("rule"), F.col(r.column).cast("string").alias("value")))
        for r, c in zip(rules, checks)
    ]
    failures = (
        df.filter(bad)
        .select(*keys, F.explode(F.array(*entries)).alias("f"))
        .filter(F.col("f").isNotNull())
        .select(F.col("f.rule").alias("rule"), *keys, F.col("f.value").alias("value"))
    )
    return kept, failures


def leakage_share(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Q4: share of rows where a feature equals the target (null-safe)."""
    return df.agg(
        F.lit(feature).alias("feature"),
        F.lit(target).alias("target"),
        F.avg(F.col(feature).eqNullSafe(F.col(target)).cast("double")).alias("share_equal"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def run_report(parts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """One table of (step, reason, key, n) from several count frames.

    Each part is (step, reason, frame with columns ``key`` and ``n``).
    """
    out = None
    for step, reason, frame in parts:
        f = frame.select(
            F.lit(step).alias("step"), F.lit(reason).alias("reason"), F.col("key").cast("string"), F.col("n").cast("long")
        )
        out = f if out is None else out.unionByName(f)
    return out
