"""Column profiles: moments, quantiles, correlations, outliers, class balance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelab.fixed_values import IQR_REACH, SENSORS, TARGET
from gaugelab.functions.scalars import count_where
from gaugelab.plans.join import settled
from gaugelab.plans.order import values_at_quantiles


def long_values(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide to long: (keep..., feature, value), missing readings dropped."""
    wide = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
    long = wide.unpivot(list(keep), list(features), "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def unstack(row: DataFrame, features: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """One-row frame with columns ``part_feature`` to one row per feature."""
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), *[F.col(f"{p}_{f}").alias(p) for p in parts])
                    for f in features
                ]
            )
        )
    )


def _clean(feature: str) -> Column:
    value = F.col(feature).cast("double")
    return F.when(~F.isnan(value), value)


def _bias_corrected_skewness(value: Column, n: Column) -> Column:
    g1 = F.when(F.var_pop(value) == 0, F.lit(0.0)).otherwise(F.skewness(value))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def _bias_corrected_kurtosis(value: Column, n: Column) -> Column:
    g2 = F.kurtosis(value)
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6.0)
    return F.when(n >= 4, F.when(F.var_pop(value) == 0, F.lit(0.0)).otherwise(adjusted))


def moments(df: DataFrame, features: Sequence[str] = SENSORS) -> DataFrame:
    """count, mean, std, min, max, skew (G1), kurtosis (excess, G2), variance per feature, in one pass."""
    aggregates = []
    for f in features:
        value = _clean(f)
        n = F.count(value).cast("double")
        aggregates += [
            F.count(value).alias(f"count_{f}"),
            F.avg(value).alias(f"mean_{f}"),
            F.stddev_samp(value).alias(f"std_{f}"),
            F.min(value).alias(f"min_{f}"),
            F.max(value).alias(f"max_{f}"),
            _bias_corrected_skewness(value, n).alias(f"skew_{f}"),
            _bias_corrected_kurtosis(value, n).alias(f"kurtosis_{f}"),
            F.var_samp(value).alias(f"variance_{f}"),
        ]
    parts = ["count", "mean", "std", "min", "max", "skew", "kurtosis", "variance"]
    return unstack(df.agg(*aggregates), features, parts)


def quantiles(df: DataFrame, features: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles as rows (keys..., feature, probability, quantile)."""
    long = long_values(df, features, keys)
    return values_at_quantiles(long, [*keys, "feature"], "value", probabilities)


def quantile_lookup(df: DataFrame, features: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float]]:
    """The same as a dict feature -> quantiles (features x probabilities numbers)."""
    rows = quantiles(df, features, probabilities).select("feature", "probability", "quantile").collect()
    found = {(r.feature, r.probability): r.quantile for r in rows}
    return {f: [found[f, float(p)] for p in probabilities] for f in features if (f, float(probabilities[0])) in found}


def descriptive_stats(df: DataFrame, features: Sequence[str] = SENSORS) -> DataFrame:
    """Moments plus quartiles, one row per feature."""
    quartiles = (
        quantiles(df, features, [0.25, 0.5, 0.75])
        .groupBy("feature")
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    )
    return moments(df, features).join(quartiles, "feature", "left")


def stats_by_class(df: DataFrame, features: Sequence[str] = SENSORS, key: str = TARGET) -> DataFrame:
    """mean, std, min, max per class and feature."""
    aggregates = []
    for f in features:
        value = _clean(f)
        aggregates += [F.avg(value).alias(f"mean_{f}"), F.stddev_samp(value).alias(f"std_{f}"), F.min(value).alias(f"min_{f}"), F.max(value).alias(f"max_{f}")]
    wide = df.groupBy(key).agg(*aggregates)
    return wide.select(
        key,
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"{p}_{f}").alias(p) for p in ("mean", "std", "min", "max")]) for f in features])),
    )


def correlation_matrix(df: DataFrame, features: Sequence[str] = SENSORS) -> DataFrame:
    """Pearson correlations as rows (feature_a, feature_b, r), both triangles and the diagonal; NULL with a constant column."""
    pairs = list(combinations(features, 2))

    def correlation(a: str, b: str) -> Column:
        both = _clean(a).isNotNull() & _clean(b).isNotNull()
        x, y = F.when(both, _clean(a)), F.when(both, _clean(b))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(spread > 0, F.covar_pop(x, y) / F.when(spread > 0, spread))

    row = df.agg(*[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [(a, b, F.col(f"r{i}")) for i, (a, b) in enumerate(pairs)]
    cells += [(b, a, r) for a, b, r in cells] + [(f, f, F.lit(1.0)) for f in features]
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), r.alias("r")) for a, b, r in cells])))


def feature_variance(df: DataFrame, features: Sequence[str] = SENSORS) -> DataFrame:
    return unstack(df.agg(*[F.var_samp(_clean(f)).alias(f"variance_{f}") for f in features]), features, ["variance"])


def variance_inflation(df: DataFrame, features: Sequence[str] = SENSORS) -> DataFrame:
    """Variance inflation factors: the diagonal of the inverse correlation matrix.

    The p x p matrix is the only thing that reaches the driver. A constant column
    has no factor (NULL); one that the others determine has an infinite one.
    """
    rows = {(r.feature_a, r.feature_b): r.r for r in correlation_matrix(df, features).collect()}
    varying = [f for f in features if len(features) == 1 or any(rows[f, g] is not None for g in features if g != f)]
    found = dict(zip(varying, vif_from_correlations([[rows[a, b] for b in varying] for a in varying])))
    return df.sparkSession.createDataFrame([(f, found.get(f)) for f in features], "feature string, vif double")


def vif_from_correlations(matrix: Sequence[Sequence[float]]) -> list[float]:
    """1 / (1 - R^2) of each column on the others; infinite where they determine it."""
    whole = np.asarray(matrix, dtype=float)
    if len(whole) and np.linalg.cond(whole) < 1e12:
        return [float(v) for v in np.diag(np.linalg.inv(whole))]
    found = []
    for i in range(len(whole)):
        rest = [j for j in range(len(whole)) if j != i]
        left = 1.0 - float(whole[i, rest] @ np.linalg.pinv(whole[np.ix_(rest, rest)]) @ whole[rest, i])
        found.append(1.0 / left if left > 1e-10 else float("inf"))
    return found


def outlier_fences(quartiles: tuple[float, float]) -> tuple[float, float]:
    reach = IQR_REACH * (quartiles[1] - quartiles[0])
    return quartiles[0] - reach, quartiles[1] + reach


def outlier_summary(df: DataFrame, features: Sequence[str] = SENSORS) -> DataFrame:
    """Readings strictly outside the 1.5 IQR fences, per feature; shares are over all rows."""
    fences = {f: outlier_fences((q[0], q[1])) for f, q in quantile_lookup(df, features, [0.25, 0.75]).items()}
    known = [f for f in features if f in fences]
    aggregates = [F.count(F.lit(1)).cast("double").alias("rows")]
    for f in known:
        low, high = fences[f]
        aggregates.append(count_where((_clean(f) < low) | (_clean(f) > high)).alias(f"n_{f}"))
    return df.agg(*aggregates).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        F.lit(fences[f][0]).alias("lower_fence"),
                        F.lit(fences[f][1]).alias("upper_fence"),
                        F.col(f"n_{f}").alias("n_outliers"),
                        (100.0 * F.col(f"n_{f}") / F.col("rows")).alias("pct_outliers"),
                    )
                    for f in known
                ]
            )
        )
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, ties by value; missing values are not counted."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def class_imbalance(df: DataFrame, key: str = TARGET) -> DataFrame:
    """Count and share per class, and the ratio of the largest to the smallest class."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = settled(counts)
    all_classes = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    return counts.select(
        key,
        "n",
        (F.col("n") / F.lit(all_classes.rows)).alias("proportion"),
        F.lit(all_classes.most / all_classes.least if all_classes.rows else None).cast("double").alias("imbalance_ratio"),
    )


def crosstab(df: DataFrame, x: str, y: str) -> DataFrame:
    """Contingency counts of two columns in long form."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
