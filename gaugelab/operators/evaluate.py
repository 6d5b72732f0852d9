"""Fitting many models and scoring them into one predictions table."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.fixed_values import CV_FOLDS, FEATURES, METRICS
from gaugelab.models.zoo import TREE_MODELS, fit_model, ordered_model_names
from gaugelab.operators.features import fit_preparation
from gaugelab.operators.metrics import decision_metrics, metric_suite
from gaugelab.operators.nested import bayes_learning_curve
from gaugelab.operators.significance import fold_summary
from gaugelab.operators.split import first_rows, with_folds
from gaugelab.operators.variants import Variant, held_predictions
from gaugelab.storage import cut_lineage, written

# Fits that run at the same time; each is a chain of Spark jobs.
PARALLEL_FITS = 4

PREDICTION = ["model", "id", "y", "y_pred", "y_proba", "y_score"]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def scored_rows(model, rows: DataFrame, name: str, carry: Sequence[str] = (), y: str = "y", id_col: str = "id") -> DataFrame:
    """Rows of the predictions table for one fitted model."""
    scored = model.transform(rows)
    return scored.select(F.lit(name).alias("model"), *carry, F.col(id_col).alias("id"), F.col(y).alias("y"), "y_pred", "y_proba", "y_score")


def cross_validated_predictions(
    train: DataFrame,
    models: Sequence[str] | None = None,
    folds: int = CV_FOLDS,
    columns: Sequence[str] = FEATURES,
    settings: Mapping[str, dict] | None = None,
) -> DataFrame:
    """Held-out predictions of every model on every fold: (model, fold, id, y, y_pred, y_proba, y_score).

    The tree models of all folds are grown by one job per number of bins. For the
    others, preparation is learnt once per fold and shared. The result is written
    to the checkpoint folder, so metrics, ranks and tests reuse it without
    fitting again.
    """
    names, settings = list(models or ordered_model_names()), settings or {}
    trees, others = [n for n in names if n in TREE_MODELS], [n for n in names if n not in TREE_MODELS]
    folded = written(train if "fold" in train.columns else with_folds(train, folds=folds), "folded")
    frames = held_predictions(folded, [Variant((n,), n, settings.get(n, {}), f) for n in trees for f in range(folds)], columns) if trees else []
    if others:
        frames += _one_by_one(folded, others, folds, columns, settings)
    return cut_lineage(union_all(frames))


def _one_by_one(folded: DataFrame, models: Sequence[str], folds: int, columns: Sequence[str], settings: Mapping[str, dict]) -> list[DataFrame]:
    """Held-out predictions, fit by fit, a few at a time."""
    folded = folded.persist()
    try:
        parts = [(f, folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)) for f in range(folds)]
        prepared = {f: fit_preparation(seen, columns) for f, seen, _ in parts}

        def one(task):
            name, (f, seen, held) = task
            fitted = fit_model(name, seen, columns, preparation=prepared[f], **settings.get(name, {}))
            return written(scored_rows(fitted, held, name, ["fold"]), "held")

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            return list(pool.map(one, [(name, part) for name in models for part in parts]))
    finally:
        folded.unpersist()


def cross_validate(train: DataFrame, models: Sequence[str] | None = None, folds: int = CV_FOLDS, **kwargs) -> DataFrame:
    """Mean, std and 95 % interval of all metrics per model: (model, metric, mean, std, ci_low, ci_high, n)."""
    predictions = cross_validated_predictions(train, models, folds, **kwargs)
    return fold_summary(metric_suite(predictions, ["model", "fold"]), METRICS)


def fold_scores(predictions: DataFrame, metric: str = "f1") -> DataFrame:
    """(fold, model, score) for rank tests, from stored predictions."""
    if metric in ("f1", "mcc"):
        per_fold = decision_metrics(predictions, ["model", "fold"])
    else:
        per_fold = metric_suite(predictions, ["model", "fold"])
    return per_fold.select("fold", "model", F.col(metric).alias("score"))


def evaluate_on_test(train: DataFrame, test: DataFrame, models: Sequence[str] | None = None, columns: Sequence[str] = FEATURES, settings: Mapping[str, dict] | None = None):
    """Fit on train, score test: (results best F1 first, fitted models, predictions table).

    Results hold the eleven metrics and the seconds of fitting and of scoring.
    """
    names = list(models or ordered_model_names())
    preparation = fit_preparation(train, columns)
    fitted, frames, times = {}, [], []
    for name in names:
        start = time.perf_counter()
        fitted[name] = fit_model(name, train, columns, preparation=preparation, **(settings or {}).get(name, {}))
        train_seconds = time.perf_counter() - start
        start = time.perf_counter()
        frames.append(written(scored_rows(fitted[name], test, name), "predictions"))  # scored once: timed as it is kept
        times.append((name, train_seconds, time.perf_counter() - start))
    predictions = union_all(frames)
    timed = train.sparkSession.createDataFrame(times, "model string, train_seconds double, predict_seconds double")
    results = metric_suite(predictions, ["model"]).join(timed, "model").orderBy(F.desc("f1"), "model")
    return results, fitted, predictions


def learning_curve(
    train: DataFrame, model: str, steps: int = 8, smallest: float = 0.1, folds: int = CV_FOLDS, columns: Sequence[str] = FEATURES, settings: Mapping | None = None
) -> DataFrame:
    """Training and validation F1 by training size: (step, train_rows, train_f1_mean, train_f1_std, cv_f1_mean, cv_f1_std).

    Sizes nest: each one keeps the first rows of the fold's hashed order. The
    spread is the population one. Gaussian naive Bayes needs no fit per size: its
    moments are summed once (``nested``).
    """
    if model == "GaussianNB":
        folded = train if "fold" in train.columns else with_folds(train, folds=folds)
        return cut_lineage(_curve(bayes_learning_curve(folded, steps, smallest, columns, **(settings or {}))).orderBy("step"))
    folded = (train if "fold" in train.columns else with_folds(train, folds=folds)).persist()
    try:
        frames = []

        def one(task):
            f, step = task
            others = folded.where(F.col("fold") != f)
            size = max(1, int((smallest + (1.0 - smallest) * step / (steps - 1)) * others.count()))
            seen = first_rows(others, size)
            fitted = fit_model(model, seen, columns, **(settings or {}))
            marks = lambda df, part: scored_rows(fitted, df, model).withColumns({"fold": F.lit(f), "step": F.lit(step), "train_rows": F.lit(size), "part": F.lit(part)})
            return marks(seen, "train").unionByName(marks(folded.where(F.col("fold") == f), "cv"))

        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            frames = list(pool.map(one, [(f, s) for f in range(folds) for s in range(steps)]))
        return cut_lineage(_curve(decision_metrics(union_all(frames), ["fold", "step", "train_rows", "part"])).orderBy("step"))
    finally:
        folded.unpersist()


def _curve(scored: DataFrame) -> DataFrame:
    """Mean and population spread over folds, per step and part."""
    return scored.groupBy("step").agg(
        F.max("train_rows").alias("train_rows"),
        *[g(F.when(F.col("part") == part, F.col("f1"))).alias(f"{part}_f1_{label}") for part in ("train", "cv") for g, label in ((F.avg, "mean"), (F.stddev_pop, "std"))],
    )
