"""Experiment parameters.

Fixed values that must equal the original pipeline's configuration for the
same results, stated as plain data in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values (pipeline configuration) --------------------------------
START_YEAR = 1990
END_YEAR = 2024
MIN_YEARS_REQUIRED = 5

NUMERIC_FEATURES = [
    "gdp_per_capita_ppp",
    "gdp_growth_pct",
    "unemployment_rate",
    "education_expenditure_pct_gdp",
    "social_spending_pct_gdp",
    "tax_revenue_pct_gdp",
    "urban_population_pct",
    "population_total",
    "top10_income_share",
    "bottom50_income_share",
]
CATEGORICAL_FEATURES = ["region", "income_group_lag1"]

TARGETS = {
    "gini": "gini_index",
    "mobility": "intergen_income_elasticity",
    "mobility_rank": "intergen_rank_correlation",
    "income_group": "income_group",
}

TEST_SIZE = 0.2
RANDOM_SEED = 42

MODEL_GINI = {"n_estimators": 400, "max_depth": 5, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8}
MODEL_MOBILITY = {"n_estimators": 500, "max_depth": 8, "min_samples_leaf": 3}
MODEL_MOBILITY_RANK = {"n_estimators": 500, "max_depth": 8, "min_samples_leaf": 3}
MODEL_INCOME_GROUP = {"n_estimators": 300, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.8}

# target -> (metric, min)
PROMOTION_GATES = {
    "gini": ("r2", 0.4),
    "mobility": ("r2", 0.15),
    "mobility_rank": ("r2", 0.15),
    "income_group": ("accuracy", 0.7),
}

DRIFT_REFERENCE_MIN_ROWS = 20
DRIFT_PSI_THRESHOLD = 0.2
MAX_REPORTS_KEPT = 10

# Gini variants in coalesce priority order, and the source order of names.
GINI_PRIORITY = ["gini_index", "gini_index_oecd", "gini_index_eurostat"]
SOURCE_PRIORITY = ["worldbank", "oecd", "eurostat", "wid"]
# Sources whose values come on a 0-1 scale and are rescaled to 0-100.
SOURCE_SCALE = {"oecd": 100.0}

# Source codes that are not ISO alpha-2 (Eurostat geo dimension).
GEO_OVERRIDES = {"EL": "GRC", "UK": "GBR"}

INTERVAL_Z = 1.28  # ~80% two-sided normal interval
TOP_N_CONTRIBUTIONS = 5
MIN_TARGET_ROWS = 20
# ---- end of fixed values --------------------------------------------------

# Own choices (not pinned down by the original pipeline).
PSI_BINS = 10
PSI_FLOOR = 1e-4
DATASET_DRIFT_SHARE = 0.5


@dataclass(frozen=True)
class PanelParams:
    start_year: int = START_YEAR
    end_year: int = END_YEAR
    min_years: int = MIN_YEARS_REQUIRED
    numeric_features: list[str] = field(default_factory=lambda: list(NUMERIC_FEATURES))
    categorical_features: list[str] = field(default_factory=lambda: list(CATEGORICAL_FEATURES))

    def feature_columns(self) -> list[str]:
        """P10: numeric features, then one ``<cat>_code`` per categorical feature."""
        return list(self.numeric_features) + [c + "_code" for c in self.categorical_features]
