"""Published numbers re-derived from published inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gaugelab.functions.distributions import mcnemar_p_value, t_quantile_975
from gaugelab.operators import compare, errors, profile, significance, split

# F1 per fold and model.
MODELS = (
    "Logistic Regression,Ridge Classifier,SGD Classifier,Decision Tree,Random Forest,Extra Trees,AdaBoost,Gradient Boosting,"
    "KNN,GaussianNB,SVM,MLP,XGBoost,LightGBM,CatBoost"
).split(",")
FOLDS = [
    [0.89, 0.796889, 0.892206, 0.996485, 0.998239, 0.998239, 0.984238, 0.99912, 0.996479, 0.695279, 0.98355, 0.996491, 0.998239, 0.997361, 0.998239],
    [0.893978, 0.814876, 0.899293, 0.993822, 0.997361, 0.997357, 0.982332, 0.996485, 0.993833, 0.717895, 0.984402, 0.994718, 0.996485, 0.996485, 0.996485],
    [0.908007, 0.797629, 0.901361, 0.997361, 0.998239, 0.998239, 0.981627, 0.992098, 0.993854, 0.699465, 0.984375, 0.995602, 0.996479, 0.996485, 0.997357],
    [0.906621, 0.828548, 0.905692, 0.997352, 1.0, 1.0, 0.981563, 0.999119, 0.995579, 0.792377, 0.987762, 0.997352, 0.999117, 0.998233, 1.0],
    [0.904202, 0.813826, 0.898305, 0.997347, 0.999117, 0.998236, 0.980736, 0.997352, 0.996479, 0.756198, 0.982639, 0.995579, 0.999117, 0.997347, 0.999117],
]
RANKS = {
    "Random Forest": 2.0, "Extra Trees": 2.6, "CatBoost": 3.2, "XGBoost": 4.2, "Gradient Boosting": 4.7, "LightGBM": 5.6, "Decision Tree": 6.8, "MLP": 7.5,
    "KNN": 8.4, "SVM": 10.2, "AdaBoost": 10.8, "Logistic Regression": 12.4, "SGD Classifier": 12.6, "Ridge Classifier": 14.0, "GaussianNB": 15.0,
}


@pytest.fixture(scope="module")
def scores(spark):
    cells = [(f, m, v) for f, line in enumerate(FOLDS) for m, v in zip(MODELS, line)]
    return spark.createDataFrame(cells, "fold int, model string, score double")


def test_friedman(scores):
    row = significance.friedman_test(scores).first()
    assert row.statistic == pytest.approx(65.56085229324664, abs=1e-9)
    assert row.p_value == pytest.approx(1.2146839507e-08, rel=1e-8)
    assert (row.significant, row.n_models, row.n_folds) == (True, 15, 5)


def test_average_ranks_and_critical_difference(scores):
    assert {r.model: r.avg_rank for r in significance.average_ranks(scores).collect()} == pytest.approx(RANKS)
    pairs = significance.nemenyi_pairs(scores, MODELS).collect()
    assert pairs[0].critical_difference == pytest.approx(9.591196, abs=1e-5)
    assert (len(pairs), sum(r.significant for r in pairs)) == (105, 13)
    assert sum(r.within_cut_off for r in significance.rank_bars(scores).collect()) == 11


def test_fold_summary_interval(scores):
    wide = scores.withColumnRenamed("score", "f1")
    found = {r.model: r for r in significance.fold_summary(wide, ["f1"]).collect()}
    row = found["Logistic Regression"]
    assert (row["mean"], row["std"], row.ci_low, row.ci_high) == pytest.approx((0.900562, 0.008067, 0.890545, 0.910578), abs=1e-6)


def test_score_matrix_shape(scores):
    matrix = significance.score_matrix(scores, MODELS)
    assert matrix.columns == ["fold", *MODELS]
    assert matrix.first()["KNN"] == 0.996479


def test_mcnemar(spark):
    counts = spark.createDataFrame([("a", "b", 2, 332), ("c", "d", 3, 7)], "model_a string, model_b string, b long, c long")
    first, second = significance.mcnemar_test(counts).collect()
    assert first.statistic == pytest.approx(324.0749, abs=1e-4)
    assert first.p_value == pytest.approx(1.8764105716e-72, rel=1e-9)
    assert (second.statistic, second.significant) == (3.0, False)
    assert second.p_value == pytest.approx(2 * sum(math.comb(10, i) for i in range(4)) / 2**10)
    assert mcnemar_p_value(0, 0, 25) == 1.0


def test_t_quantile():
    assert t_quantile_975(4) == pytest.approx(2.7764451051977987, abs=1e-10)
    assert t_quantile_975(1) == pytest.approx(12.706204736432095, abs=1e-8)


def test_vif_from_published_correlations():
    matrix = [[1.0, -0.0479, 0.3675, 0.2032], [-0.0479, 1.0, 0.122, -0.1784], [0.3675, 0.122, 1.0, -0.0957], [0.2032, -0.1784, -0.0957, 1.0]]
    # The published correlations have four decimals, which moves the factors by up to 1.3e-4.
    assert profile.vif_from_correlations(matrix) == pytest.approx([1.2428, 1.0486, 1.2163, 1.1054], abs=2e-4)


def test_outlier_fences():
    assert profile.outlier_fences((23.0, 25.0)) == (20.0, 28.0)
    assert profile.outlier_fences((9.644, 15.5065)) == pytest.approx((0.85, 24.3), abs=1e-3)


def test_borderline(spark):
    chances = [0.38333, 0.3, 0.42, 0.84333, 0.35]
    frame = spark.createDataFrame([(p, False) for p in chances] + [(0.5, True)], "p_bad double, correct boolean")
    row = errors.borderline(frame).first()
    assert (row.n_errors, row.n_borderline, row.pct_borderline) == (5, 1, 20.0)
    assert row.mean_error_confidence == pytest.approx(0.678, abs=1e-4)


def test_class_imbalance(spark):
    frame = spark.range(4569 + 3546).select(F.when(F.col("id") < 4569, "Good").otherwise("Bad").alias("Class"))
    found = {r.Class: r for r in profile.class_imbalance(frame).collect()}
    assert found["Good"].proportion == pytest.approx(0.563, abs=1e-4)
    assert found["Bad"].imbalance_ratio == pytest.approx(1.2885, abs=1e-4)


def test_split_sizes(spark):
    frame = spark.range(8115).select("id", (F.col("id") >= 4569).cast("int").alias("y"))
    found = {r.partition: (r.n_samples, r.n_bad, r.n_good) for r in split.split_sizes(split.with_split(frame)).collect()}
    assert found == {"test": (1623, 709, 914), "train": (6492, 2837, 3655)}


def test_deployment_view(spark):
    sizes = [2.89, 2.89, 2.95, 3.12, 8.92, 30.64, 59.96, 71.45, 134.75, 440.11, 464.12, 550.34, 1034.09, 2603.33, 5735.21]
    costs = spark.createDataFrame([(s, 0.02) for s in sizes], "model_size_kb double, latency_ms double")
    assert compare.deployment_view(costs).where("edge_feasible").count() == 11


def test_tuning_comparison(spark):
    default = spark.createDataFrame([("CatBoost", 0.9979, 0.9999), ("KNN", 0.9951, 0.9973)], "model string, f1 double, roc_auc double")
    tuned = spark.createDataFrame([("CatBoost", 0.9993, 0.9999)], "model string, f1 double, roc_auc double")
    rows = compare.default_versus_tuned(default, tuned).collect()
    assert len(rows) == 1 and rows[0].d_f1 == pytest.approx(0.0014)
