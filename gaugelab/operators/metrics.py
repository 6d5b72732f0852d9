"""Classification metrics of a predictions table, many models in one job.

A predictions table is long: group columns (model, fold, scenario, ...), ``y``,
``y_pred`` and, where a model has them, ``y_proba`` and ``y_score``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.fixed_values import METRICS, PROBABILITY_CLIP
from gaugelab.functions.scalars import count_where, ratio, ratio_or_zero
from gaugelab.plans.order import running_totals


def confusion_counts(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, tn, fn per group and the probability losses, in one pass with map-side sums."""
    y, pred = F.col("y"), F.col("y_pred")
    aggregates = [
        count_where((y == 1) & (pred == 1)).alias("tp"),
        count_where((y == 0) & (pred == 1)).alias("fp"),
        count_where((y == 0) & (pred == 0)).alias("tn"),
        count_where((y == 1) & (pred == 0)).alias("fn"),
    ]
    if "y_proba" in predictions.columns:
        p = F.col("y_proba")
        clipped = F.least(F.greatest(p, F.lit(PROBABILITY_CLIP)), F.lit(1.0 - PROBABILITY_CLIP))
        loss = F.when(p.isNotNull(), -F.when(y == 1, F.log(clipped)).otherwise(F.log(1.0 - clipped)))
        aggregates += [F.avg(loss).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier_score")]
    return predictions.groupBy(*keys).agg(*aggregates)


def threshold_metrics(counts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1, MCC, kappa, FNR and FPR from the four counts."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    # Mean recall over the classes that occur.
    balanced = F.when(recall.isNull(), specificity).when(specificity.isNull(), recall).otherwise((recall + specificity) / 2.0)
    mcc = ratio_or_zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    observed = ratio(tp + tn, n)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    return counts.select(
        *keep,
        observed.alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        mcc.alias("mcc"),
        ratio(observed - chance, 1.0 - chance).alias("cohen_kappa"),
        ratio(fn, tp + fn).alias("fnr"),
        ratio(fp, fp + tn).alias("fpr"),
        *[c for c in ("log_loss", "brier_score") if c in counts.columns],
    )


def score_table(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct scores per group, ascending, with positives and negatives at and below each."""
    scored = predictions.select(*keys, "y", _ranking(predictions).alias("score"))
    return running_totals(scored, keys, "score", {"pos": (F.col("y") == 1).cast("long"), "neg": (F.col("y") == 0).cast("long")})


def _ranking(predictions: DataFrame):
    have = [c for c in ("y_score", "y_proba") if c in predictions.columns]
    return F.coalesce(*[F.col(c) for c in have])


def ranking_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC AUC (ties count one half) and step-wise average precision; NULL where only one class occurs."""
    table = score_table(predictions, keys)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    all_pos, all_neg = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    pairs_won = pos * (F.col("before_neg") + neg / 2.0)
    flagged_pos, flagged_neg = all_pos - F.col("before_pos"), all_neg - F.col("before_neg")
    gained = pos * flagged_pos / (flagged_pos + flagged_neg)
    sums = table.groupBy(*keys).agg(
        F.sum(pairs_won).alias("won"), F.sum(gained).alias("gain"), F.max("total_pos").cast("double").alias("p"), F.max("total_neg").cast("double").alias("n")
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        *keys,
        F.when(both, F.try_divide(F.col("won"), F.col("p") * F.col("n"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("gain"), F.col("p"))).alias("pr_auc"),
    )


def metric_suite(predictions: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """All eleven metrics per group; probability metrics are NULL for models without probabilities."""
    keys = list(keys)
    by_threshold = threshold_metrics(confusion_counts(predictions, keys), keys)
    if not {"y_score", "y_proba"} & set(predictions.columns):
        by_threshold = by_threshold.withColumns({"roc_auc": F.lit(None).cast("double"), "pr_auc": F.lit(None).cast("double")})
    else:
        by_threshold = by_threshold.join(ranking_metrics(predictions, keys), keys, "left")
    for missing in ("log_loss", "brier_score"):
        if missing not in by_threshold.columns:
            by_threshold = by_threshold.withColumn(missing, F.lit(None).cast("double"))
    return by_threshold.select(*keys, *METRICS)


def decision_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F1, MCC, missed-risk rate (FNR) and false-alarm rate (FPR) per group."""
    narrow = predictions.select(*keys, "y", "y_pred")
    return threshold_metrics(confusion_counts(narrow, keys), keys).select(*keys, "f1", "mcc", "fnr", "fpr")
