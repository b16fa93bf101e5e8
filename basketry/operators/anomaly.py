"""Anomalies of the product mart: isolation forest, contamination cut, labels, audit views.

The forest itself is in ``forest.py``.  Rows whose score lies strictly above
the exact ``contamination`` quantile (rows at the cut are normal) are
anomalies.  The mart is written once; fit, score, cut and label join read that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import RELIABILITY_SINGLE, RESULT_ANOMALY, RESULT_NORMAL, RESULT_UNSCORED
from ..session import ensure_checkpoint_dir
from . import forest
from .quantile import exact_quantile
from .shared import written_once

FEATURES = ["total_cost_z_score", "total_cost_cv", "freight_share_pct"]
TREES, PSI, SEED = 100, 256, 42


def anomaly_features(df: DataFrame, features: list[str] = FEATURES, key: str = "product_id") -> DataFrame:
    """Model inputs: the feature columns as doubles with missing values set to 0."""
    return df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])


def fit_isolation_forest(
    df: DataFrame,
    features: list[str] = FEATURES,
    key: str = "product_id",
    trees: int = TREES,
    psi: int = PSI,
    seed: int = SEED,
    n: int | None = None,
) -> tuple[DataFrame, int]:
    """Fit the forest; returns (node table, rows a tree).

    The node table is checkpointed and bounded by the parameters (at most
    trees * 511 rows for psi = 256).  It stays dealt by tree: put together in one
    partition, one task would fit all trees, with the sorts of all levels for
    each of their partitions.  ``n`` is the row count when known.
    """
    ensure_checkpoint_dir(df.sparkSession)
    feats = anomaly_features(df, features, key)
    n = feats.count() if n is None else n
    return forest.fit(feats, features, key, n, trees, psi, seed).checkpoint(), min(psi, max(n, 1))


def contamination_cut(scored: DataFrame, contamination: float, score_col: str = "anomaly_score") -> float | None:
    """The exact ``contamination`` quantile of −score (linear interpolation); None without rows."""
    return exact_quantile(scored.select((-F.col(score_col)).alias("x")), "x", contamination)


def _scored(feats: DataFrame, features: list[str], key: str, trees: int, psi: int, seed: int, n: int) -> DataFrame:
    """(key, anomaly_score) of every row of ``feats``, fitted on them; scored once and checkpointed."""
    nodes, psi = fit_isolation_forest(feats, features, key, trees, psi, seed, n)
    rows = forest.scored(anomaly_features(feats, features, key), nodes, features, key, trees, psi)
    return rows.checkpoint()


def isolation_forest_scores(
    df: DataFrame,
    contamination: float = 0.05,
    features: list[str] = FEATURES,
    key: str = "product_id",
    trees: int = TREES,
    psi: int = PSI,
    seed: int = SEED,
) -> DataFrame:
    """Fit on ``df`` and score it: (key, anomaly_score, is_anomaly); ``key`` names a row.

    Rows whose −score is strictly below the ``contamination`` quantile are
    anomalies, so rows that tie at the cut are normal.  An empty frame gives
    no rows; missing features count as 0.
    """
    feats = written_once(df.select(key, *features), "forest-features")
    n = feats.count()
    if not n:
        return feats.select(key, F.lit(0.0).alias("anomaly_score"), F.lit(False).alias("is_anomaly"))
    scored = _scored(feats, features, key, trees, psi, seed, n)
    cut = contamination_cut(scored, contamination)
    return scored.select(key, "anomaly_score", (-F.col("anomaly_score") < F.lit(cut)).alias("is_anomaly"))


def detect_anomalies(
    df: DataFrame,
    contamination: float = 0.05,
    min_rows: int = 11,
    features: list[str] = FEATURES,
    key: str = "product_id",
    seed: int = SEED,
    trees: int = TREES,
    psi: int = PSI,
) -> DataFrame:
    """Label every row: Normal / Anomaly for multi-sale products, 'Single sale - No Analysis'
    for the rest.  With fewer than ``min_rows`` trainable rows nothing is scored.

    ``df`` is computed once and written; key and features of the trainable rows
    are fitted and scored, and their labels joined back to all rows by ``key``.
    ``psi`` rows for each of ``trees`` trees are the algorithm's own subsample;
    every row is scored.
    """
    df = written_once(df, "product-mart")
    feats = df.where(F.col("reliability_score") != RELIABILITY_SINGLE).select(key, *features)
    n = feats.count()
    if n < min_rows:
        return df.withColumn("Result", F.lit(RESULT_UNSCORED))
    scored = _scored(feats, features, key, trees, psi, seed, n)
    cut = contamination_cut(scored, contamination)
    label = F.when(-F.col("anomaly_score") < F.lit(cut), RESULT_ANOMALY).otherwise(RESULT_NORMAL)
    labels = scored.select(key, label.alias("Result"))
    return df.join(labels, key, "left").select(*df.columns, F.coalesce("Result", F.lit(RESULT_UNSCORED)).alias("Result"))


AUDIT_COLUMNS = [
    "product_id",
    "category",
    "Result",
    "is_revenue_workhorse",
    "product_revenue_share_pct",
    "avg_price",
    "total_cost_z_score",
    "sales_count",
    "is_price_rebalanced",
]


def audit_view(df: DataFrame, only_workhorses: bool = False, only_anomalies: bool = False) -> DataFrame:
    """Audit table: 9 columns, optional workhorse/anomaly filters, by revenue share desc."""
    v = df.select(*AUDIT_COLUMNS)
    if only_workhorses:
        v = v.where(F.col("is_revenue_workhorse"))
    if only_anomalies:
        v = v.where(F.col("Result") == RESULT_ANOMALY)
    return v.orderBy(F.desc_nulls_last("product_revenue_share_pct"), F.asc("product_id"))


MAP_COLUMNS = ["product_id", "category", "Result", "avg_price", "avg_freight", "sales_count", *FEATURES]


def outlier_map(df: DataFrame) -> DataFrame:
    """Trained rows only, with price, freight, sales, the three features (missing: 0) and the label."""
    missing = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in FEATURES else F.col(c) for c in MAP_COLUMNS]
    return df.where(F.col("reliability_score") != RELIABILITY_SINGLE).select(*missing)


def above_quantile(df: DataFrame, col: str, q: float, key: str = "product_id") -> DataFrame:
    """(key, col, is_above): rows above the exact ``q`` quantile of a column (NULL values left out)."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.where(F.col(col).isNotNull()).select(key, col).checkpoint()
    cut = exact_quantile(rows, col, q)
    return rows.select(key, col, (F.col(col) > F.lit(cut)).alias("is_above"))


def z_outliers(df: DataFrame, col: str = "total_cost_z_score", cutoff: float = 3.0) -> DataFrame:
    """Rows with |z| above the cutoff (NULL z is not an outlier)."""
    return df.where(F.abs(F.col(col)) > F.lit(float(cutoff)))
