"""Variants grown together and nested moments against fits done one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugelab.models import zoo
from gaugelab.operators import attribution, evaluate, metrics, tuning
from gaugelab.operators.nested import bayes_learning_curve, step_sizes
from gaugelab.operators.split import first_rows, with_folds

SETTINGS = {"Random Forest": {"trees": 6, "max_depth": 6}, "XGBoost": {"rounds": 4}, "Decision Tree": {"max_depth": 5}}


@pytest.fixture(scope="module")
def folded(rows):
    return with_folds(rows, folds=3).cache()


def test_held_out_predictions_do_not_know_their_labels(folded):
    """Predictions of a fold stay what they are when its labels are turned round."""
    turned = folded.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    first, second = (
        {(r["model"], r["id"]): r["y_proba"] for r in evaluate.cross_validated_predictions(f, list(SETTINGS), 3, settings=SETTINGS).where("fold = 1").collect()} for f in (folded, turned)
    )
    assert first == pytest.approx(second) and len(first) == 3 * folded.where("fold = 1").count()


def test_cross_validation_scores_every_row_once_per_tree_model(folded):
    found = evaluate.cross_validated_predictions(folded, list(SETTINGS), 3, settings=SETTINGS)
    counts = {r[0]: (r[1], r[2]) for r in found.groupBy("model").agg(F.count("id"), F.countDistinct("id")).collect()}
    assert counts == dict.fromkeys(SETTINGS, (folded.count(), folded.count()))
    f1 = {r["model"]: r["f1"] for r in metrics.decision_metrics(found, ["model"]).collect()}
    assert min(f1.values()) > 0.6


def test_search_scores_what_single_fits_score(folded):
    spaces = {"XGBoost": {k: (kind, *((3, 6, 1) if k == "n_estimators" else limits)) for k, (kind, *limits) in tuning.SEARCH_SPACES["XGBoost"].items()}}
    found = {r["trial"]: r for r in tuning.search(folded, trials=2, folds=3, spaces=spaces).collect()}
    assert set(found) == {0, 1}
    settings = zoo.tuned_settings("XGBoost", tuning.trial_parameters("XGBoost", 0, spaces=spaces))
    held = evaluate.cross_validated_predictions(folded, ["XGBoost"], 3, settings={"XGBoost": settings})
    per_fold = [r["f1"] for r in metrics.decision_metrics(held, ["fold"]).collect()]
    assert found[0]["cv_f1"] == pytest.approx(sum(per_fold) / 3)
    best = tuning.best_trials(tuning.search(folded, trials=2, folds=3, spaces=spaces))
    assert tuning.tuned_presets(best)["XGBoost"]["rounds"] in (3, 4, 5, 6)


def test_subsets_and_elimination(folded):
    subsets = {"All": ["Temp", "Humidity", "Light", "CO2", "Fruit"], "One": ["Light"]}
    # Without drawn rows, so that a mask over all features and a table without the others give the same trees.
    found = {r["subset"]: r for r in attribution.subset_impact(folded, "Decision Tree", subsets, 3, SETTINGS["Decision Tree"]).collect()}
    alone = evaluate.cross_validated_predictions(folded, ["Decision Tree"], 3, ["Light"], SETTINGS)
    f1 = [r["f1"] for r in metrics.decision_metrics(alone, ["fold"]).collect()]
    assert found["One"]["cv_f1_mean"] == pytest.approx(sum(f1) / 3) and found["One"]["n_features"] == 1
    assert found["All"]["cv_f1_mean"] > found["One"]["cv_f1_mean"] + 0.1
    rows = attribution.recursive_elimination(folded, folds=3, settings=SETTINGS["Random Forest"]).collect()
    kept = [r for r in rows if r["selected"]]
    assert len(rows) == 9 and len(kept) == rows[0]["optimal_n_features"]
    assert sorted(r["ranking"] for r in rows if not r["selected"]) == list(range(2, 2 + len(rows) - len(kept)))


def test_nested_moments_equal_single_fits(folded):
    with_gaps = folded.withColumn("Temp", F.col("Temp") + 1000.0)
    found = {(r["fold"], r["step"], r["part"]): r for r in bayes_learning_curve(with_gaps, 3, 0.2).collect()}
    assert len(found) == 3 * 3 * 2
    for fold, step in ((0, 0), (1, 1), (2, 2)):
        others = with_gaps.where(F.col("fold") != fold)
        size = step_sizes(others.count(), 3, 0.2)[step]
        seen = first_rows(others, size)
        model = zoo.fit_model("GaussianNB", seen)
        for part, rows in (("train", seen), ("cv", with_gaps.where(F.col("fold") == fold))):
            want = metrics.decision_metrics(evaluate.scored_rows(model, rows, "GaussianNB"), ["model"]).first()["f1"]
            got = found[fold, step, part]
            assert got["f1"] == pytest.approx(want) and got["train_rows"] == size


def test_curve_with_one_class_and_missing_values(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 5), None if i % 6 == 0 else "ab"[i % 2], 1, i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, a double, kind string, y int, fold int")
    found = bayes_learning_curve(frame, 3, 0.1, ["a", "kind"]).collect()
    assert len(found) == 12 and all(r["f1"] == 1.0 for r in found)
