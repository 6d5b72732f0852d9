"""The tables behind evaluation and distribution charts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelab.fixed_values import IQR_REACH, SENSORS, TARGET
from gaugelab.operators.metrics import score_table
from gaugelab.operators.profile import long_values, quantiles
from gaugelab.plans.join import join_settled
from gaugelab.plans.order import values_at_quantiles


def roc_points(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, threshold, fpr, tpr): a point per distinct score plus the origin (threshold NULL)."""
    keys = list(keys)
    table = score_table(predictions, keys)
    p, n = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    point = _point("fpr", F.try_divide(n - F.col("before_neg"), n), "tpr", F.try_divide(p - F.col("before_pos"), p))
    return table.select(*keys, F.inline(_with_end(point, "fpr", 0.0, "tpr", 0.0)))


def _point(x_name: str, x: Column, y_name: str, y: Column) -> Column:
    return F.struct(F.col("score").alias("threshold"), x.cast("double").alias(x_name), y.cast("double").alias(y_name))


def _with_end(point: Column, x_name: str, x: float, y_name: str, y: float) -> Column:
    """The point, and after the group's one largest score also the end of the curve (threshold NULL)."""
    end = F.struct(F.lit(None).cast("double").alias("threshold"), F.lit(x).alias(x_name), F.lit(y).alias(y_name))
    return F.when(F.col("next_value").isNull(), F.array(point, end)).otherwise(F.array(point))


def pr_points(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, threshold, recall, precision): a point per distinct score plus the end (0, 1)."""
    keys = list(keys)
    table = score_table(predictions, keys)
    hit = (F.col("total_pos") - F.col("before_pos")).cast("double")
    flagged = hit + F.col("total_neg") - F.col("before_neg")
    point = _point("recall", F.try_divide(hit, F.col("total_pos").cast("double")), "precision", hit / flagged)
    return table.select(*keys, F.inline(_with_end(point, "recall", 0.0, "precision", 1.0)))


def curve_areas(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Trapezoid areas under both curves and the base rate: (keys, roc_area, pr_area, base_rate).

    Each distinct score closes one trapezoid with the point of the next larger
    score, and all four corners follow from the running totals of the row.
    """
    keys = list(keys)
    table = score_table(predictions, keys)
    p, n = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    hit, miss = p - F.col("before_pos"), n - F.col("before_neg")
    hit_above, miss_above = hit - F.col("pos"), miss - F.col("neg")
    roc = (miss - miss_above) / n * (hit + hit_above) / p / 2.0
    precision = hit / (hit + miss)
    precision_above = F.when(hit_above + miss_above == 0, F.lit(1.0)).otherwise(F.try_divide(hit_above, hit_above + miss_above))
    pr = (hit - hit_above) / p * (precision + precision_above) / 2.0
    usable = table.where((F.col("total_pos") > 0) & (F.col("total_neg") > 0))
    return usable.groupBy(*keys).agg(F.sum(roc).alias("roc_area"), F.sum(pr).alias("pr_area"), F.max(p / (p + n)).alias("base_rate"))


def confusion_matrix(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts on the full 2 x 2 grid per group: (keys, y, y_pred, n)."""
    y, pred = F.col("y"), F.col("y_pred")
    counted = predictions.groupBy(*keys).agg(
        *[F.count(F.when((y == a) & (pred == b), F.lit(1))).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    )
    cells = F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("y_pred"), F.col(f"n{a}{b}").alias("n")) for a in (0, 1) for b in (0, 1)])
    return counted.select(*keys, F.inline(cells))


def calibration_points(predictions: DataFrame, keys: Sequence[str] = ("model",), bins: int = 10) -> DataFrame:
    """Mean probability and share of positives per quantile bin; empty bins drop out.

    A probability equal to an edge belongs to the bin below it.
    """
    keys = list(keys)
    scored = predictions.where(F.col("y_proba").isNotNull())
    edges = (
        values_at_quantiles(scored, keys, "y_proba", [i / bins for i in range(1, bins)])
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("quantile")).alias("edges"))
    )
    binned = join_settled(scored, edges, keys).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("y_proba"))))
    return binned.groupBy(*keys, "bin").agg(F.avg("y_proba").alias("mean_probability"), F.avg(F.col("y").cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, features: Sequence[str] = SENSORS, key: str = TARGET) -> DataFrame:
    """Quartiles per class and feature and whiskers at the last reading inside 1.5 IQR of the box."""
    quartiles = (
        quantiles(df, features, [0.25, 0.5, 0.75], [key])
        .groupBy(key, "feature")
        .agg(*[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    )
    reach = IQR_REACH * (F.col("q75") - F.col("q25"))
    inside = (F.col("value") >= F.col("q25") - reach) & (F.col("value") <= F.col("q75") + reach)
    return (
        join_settled(long_values(df, features, [key]), quartiles, [key, "feature"])
        .groupBy(key, "feature", "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count(F.when(~inside, F.lit(1))).alias("n_fliers"),
        )
    )


def _extent(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def density(df: DataFrame, features: Sequence[str] = SENSORS, key: str = TARGET, points: int = 200, cut: float = 3.0, keys_share_grid: bool = True) -> DataFrame:
    """Gaussian kernel density per class and feature on an even grid (Scott bandwidth n^(-1/5) s).

    The grid spans the data plus ``cut`` bandwidths; ``cut=0`` ends it at the
    extremes, as in a violin. Equal readings are combined first, and each then
    meets the fixed number of grid points; sums are combined inside every task.
    """
    long = long_values(df, features, [key])
    stats = _extent(long, "value", [key, "feature"]).withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    lower, upper = F.col("low") - cut * F.col("h"), F.col("high") + cut * F.col("h")
    if keys_share_grid:
        per_feature = W.partitionBy("feature")  # one row per class
        lower, upper = F.min(lower).over(per_feature), F.max(upper).over(per_feature)
    stats = stats.select(key, "feature", "n", "h", lower.alias("start"), upper.alias("stop")).where(F.col("h") > 0)
    distinct = long.groupBy(key, "feature", "value").agg(F.count(F.lit(1)).alias("weight"))
    x = F.col("start") + (F.col("stop") - F.col("start")) * F.col("grid_point") / float(points - 1)
    z = (x - F.col("value")) / F.col("h")
    kernel = F.col("weight") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    return (
        join_settled(distinct, stats, [key, "feature"])
        .withColumn("grid_point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(key, "feature", "grid_point")
        .agg(F.max(x).alias("x"), F.sum(kernel).alias("density"))
    )


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts over each group's own range, last bin closed: (keys, bin, low, high, n)."""
    keys = list(keys)
    narrow = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"))
    extent = narrow.groupBy(*keys).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    # A constant column gets a range of one around it.
    flat = F.col("_min") == F.col("_max")
    extent = extent.select(*keys, F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("start"), F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max")).alias("stop"))
    if keys:
        placed = join_settled(narrow, extent, keys)
    else:
        row = extent.first()
        placed = narrow.withColumns({"start": F.lit(row["start"]).cast("double"), "stop": F.lit(row["stop"]).cast("double")})
    width = (F.col("stop") - F.col("start")) / float(bins)
    number = F.least(F.floor((F.col("value") - F.col("start")) / width), F.lit(bins - 1)).cast("int")
    counted = placed.groupBy(*keys, "start", "stop", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = counted.groupBy(*keys, "start", "stop").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("seen"))
    return grid.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *keys, "bin",
        (F.col("start") + F.col("bin") * width).alias("low"),
        (F.col("start") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce(F.try_element_at("seen", F.col("bin")), F.lit(0)).cast("long").alias("n"),
    )


def pair_points(df: DataFrame, features: Sequence[str] = SENSORS, key: str = TARGET, id_col: str = "id") -> DataFrame:
    """Scatter points of every feature pair, for all rows: (id, class, pair, x, y)."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y_value"))
            for a, b in combinations(features, 2)
        ]
    )
    return df.select(id_col, key, F.inline(cells))


def sorted_series(df: DataFrame, label: str, value: str | Column, ascending: bool = True) -> DataFrame:
    """A bar series: label and value in drawing order, ties by label."""
    column = F.col(value) if isinstance(value, str) else value
    return df.select(label, column.alias("value")).orderBy(F.asc("value") if ascending else F.desc("value"), label)
