"""Results beyond the sizes that tables or loops used to stop at."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gaugelab.operators import features, profile, rules, significance, tuning


def test_t_quantile_of_many_folds(spark):
    rows = [("m", i, float(i % 7)) for i in range(401)]
    got = significance.fold_summary(spark.createDataFrame(rows, "model string, fold int, f1 double"), ["f1"]).first()
    half = (got.ci_high - got.ci_low) / 2
    assert half / (got.std / math.sqrt(401)) == pytest.approx(1.96591, abs=1e-5)


def test_codes_of_many_levels(spark):
    df = spark.range(20000).select("id", F.concat(F.lit("common prefix "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("b"))
    first = features.category_codes(df, "a")
    assert first.where("a_code <> id").count() == 0 and first.columns == [*df.columns, "a_code"]
    second = features.category_codes(df, "b")
    levels = sorted(str(i) for i in range(20000) if i % 3 > 0)
    rows = {r.id: r.b_code for r in second.collect()}
    assert all(rows[i] == -1 for i in range(0, 20000, 3))
    assert all(rows[int(v)] == k for k, v in enumerate(levels))


def test_inflation_of_constant_and_dependent_columns(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") * 2.0 + 1).alias("c"), F.rand(1).alias("d"))
    got = {r.feature: r.vif for r in profile.variance_inflation(df, ["a", "b", "c", "d"]).collect()}
    assert got["b"] is None and got["a"] == got["c"] == float("inf") and 1 <= got["d"] < 2
    cells = {(r.feature_a, r.feature_b): r.r for r in profile.correlation_matrix(df, ["a", "b"]).collect()}
    assert cells["a", "b"] is None and cells["b", "b"] == 1.0


def test_tree_without_limit_ends_pure(spark):
    # Alternating classes along one column leave no pure node before single values.
    df = spark.range(36).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"), F.lit("g").alias("g"))
    *_, (depth, grown) = rules.grow_trees(df, ["g"], None, ["x"])
    assert grown.where("guess <> y").count() == 0 and grown.select("node").distinct().count() == 36
    assert depth >= 6


def test_reported_settings_are_those_fitted(spark, rows):
    spaces = {"Random Forest": {"n_estimators": ("int", 2, 4, 2), "max_depth": ("int", 2, 3, 1), "min_samples_split": ("int", 2, 3, 1), "min_samples_leaf": ("int", 1, 2, 1), "max_features": ("choice", ["sqrt", "all"])}}
    found = tuning.search(rows, trials=2, folds=2, spaces=spaces).collect()
    listed = {r.trial: r.params for r in tuning.trial_table(spark, trials=2, spaces=spaces).collect()}
    assert {r.trial: r.params for r in found} == listed
    assert set(tuning.tuned_presets(tuning.best_trials(spark.createDataFrame(found)))["Random Forest"]) >= {"trees", "max_depth", "subset", "min_leaf"}
