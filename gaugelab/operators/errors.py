"""What a model gets wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.fixed_values import BORDER_HIGH, BORDER_LOW, FEATURES, GROUP, SENSORS
from gaugelab.functions.scalars import count_where, ratio


def error_frame(features: DataFrame, predictions: DataFrame, id_col: str = "id") -> DataFrame:
    """Features joined with one model's predictions by id; adds correct, error_type and, if known, p_bad."""
    kept = predictions.select(
        id_col, F.col("y").alias("y_true"), "y_pred", *([F.col("y_proba").alias("p_bad")] if "y_proba" in predictions.columns else [])
    )
    return outcome_columns(features.drop("y").join(kept, id_col))


def outcome_columns(df: DataFrame) -> DataFrame:
    """Add correct and error_type to a frame with y_true and y_pred."""
    y, pred = F.col("y_true"), F.col("y_pred")
    kind = F.when((y == 1) & (pred == 0), "false_negative").when((y == 0) & (pred == 1), "false_positive").otherwise("correct")
    return df.withColumns({"correct": y == pred, "error_type": kind})


def errors_by_group(errors: DataFrame, key: str = GROUP) -> DataFrame:
    """n, n_errors and error_rate per group, worst first."""
    counted = errors.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), count_where(~F.col("correct")).alias("n_errors"))
    return counted.withColumn("error_rate", F.col("n_errors") / F.col("n")).orderBy(F.desc("error_rate"), key)


def error_feature_profile(errors: DataFrame, features: Sequence[str] = SENSORS) -> DataFrame:
    """Mean and std of each sensor for right and wrong predictions: (correct, feature, mean, std)."""
    wide = errors.groupBy("correct").agg(
        *[F.avg(F.col(f).cast("double")).alias(f"mean_{f}") for f in features], *[F.stddev_samp(F.col(f).cast("double")).alias(f"std_{f}") for f in features]
    )
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean"), F.col(f"std_{f}").alias("std")) for f in features]
    return wide.select("correct", F.inline(F.array(*cells)))


def borderline(errors: DataFrame, low: float = BORDER_LOW, high: float = BORDER_HIGH) -> DataFrame | None:
    """Errors with a probability in [low, high]: n_errors, n_borderline, pct_borderline, mean_error_confidence.

    Without errors the confidence is NULL and the rest zero; without probabilities there is no table.
    """
    if "p_bad" not in errors.columns:
        return None
    wrong, p = ~F.col("correct"), F.col("p_bad")
    row = errors.agg(
        count_where(wrong).alias("n_errors"),
        count_where(wrong & p.between(low, high)).alias("n_borderline"),
        (F.avg(F.when(wrong, F.abs(p - 0.5))) + 0.5).alias("mean_error_confidence"),
    )
    share = F.coalesce(ratio(100.0 * F.col("n_borderline"), F.col("n_errors")), F.lit(0.0))
    return row.select("n_errors", "n_borderline", share.alias("pct_borderline"), "mean_error_confidence")


def misclassified(errors: DataFrame, carry: Sequence[str] = ("id",)) -> DataFrame:
    """The wrong rows: features, y_true, y_pred, error_type and p_bad where known."""
    extra = ["p_bad"] if "p_bad" in errors.columns else []
    return errors.where(~F.col("correct")).select(*[c for c in carry if c in errors.columns], *FEATURES, "y_true", "y_pred", "error_type", *extra)


def error_type_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_type")
