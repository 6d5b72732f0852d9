"""Models against closed forms and brute force; storage round trips."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelab.models import zoo
from gaugelab.models.fitted import load_model
from gaugelab.models.neighbours import nearest_by_boxes, nearest_by_broadcast, reference_points
from gaugelab.operators import cost, evaluate, metrics, split, tuning
from gaugelab.operators.features import fit_preparation

SMALL = {
    "Decision Tree": {"max_depth": 8}, "Random Forest": {"trees": 8, "max_depth": 8}, "Extra Trees": {"trees": 8, "max_depth": 8}, "AdaBoost": {"rounds": 5},
    "Gradient Boosting": {"rounds": 5}, "XGBoost": {"rounds": 5}, "LightGBM": {"rounds": 5}, "CatBoost": {"rounds": 5}, "SVM": {"size": 60, "max_iter": 10}, "MLP": {"max_iter": 20},
}


@pytest.fixture(scope="module")
def parts(rows):
    placed = split.with_split(rows).cache()
    return placed.where("split = 'train'"), placed.where("split = 'test'")


@pytest.fixture(scope="module")
def matrix(parts):
    train, test = parts
    made = fit_preparation(train, zoo.FEATURES)
    local = train.select("y", *made.columns()).toPandas()
    held = test.select("id", "y", *made.columns()).toPandas()
    return local[made.outputs].to_numpy(), local["y"].to_numpy(), held[made.outputs].to_numpy(), held["id"].to_numpy()


def by_id(scored, ids, column):
    found = {r["id"]: r[column] for r in scored.select("id", column).collect()}
    return np.array([found[i] for i in ids])


def test_logistic_regression_solves_the_penalised_problem(parts, matrix):
    x, y, held, ids = matrix
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (p - y) + penalty @ w)
    want = 1 / (1 + np.exp(-(held @ w[:-1] + w[-1])))
    got = by_id(zoo.fit_model("Logistic Regression", parts[0]).transform(parts[1]), ids, "y_proba")
    assert np.abs(got - want).max() < 1e-4


def test_ridge_closed_form(parts, matrix):
    x, y, held, ids = matrix
    t = 2.0 * y - 1.0
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (t - t.mean()))
    got = by_id(zoo.fit_model("Ridge Classifier", parts[0]).transform(parts[1]), ids, "y_score")
    assert np.allclose(got, held @ w + t.mean() - x.mean(axis=0) @ w, atol=1e-9)


def test_gaussian_bayes(parts, matrix):
    x, y, held, ids = matrix
    eps = 1e-9 * x.var(axis=0).max()
    joint = []
    for c in (0, 1):
        own = x[y == c]
        var = own.var(axis=0) + eps
        joint.append(np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * var).sum() + ((held - own.mean(axis=0)) ** 2 / var).sum(axis=1)))
    got = by_id(zoo.fit_model("GaussianNB", parts[0]).transform(parts[1]), ids, "y_proba")
    assert np.allclose(got, 1 / (1 + np.exp(joint[0] - joint[1])), atol=1e-9)


@pytest.mark.parametrize("name", sorted(SMALL))
def test_model_beats_chance(parts, name):
    train, test = parts
    fitted = zoo.fit_model(name, train, **SMALL[name])
    row = metrics.metric_suite(evaluate.scored_rows(fitted, test, name)).first()
    assert row.roc_auc > 0.55 and 0.0 < row.log_loss < 5.0


def test_neighbours_by_boxes_and_broadcast_agree(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(900, 3)), 2)
    points[:300] = [0.5, -0.25, 1.0]  # a third of all rows on one point
    cells = [(i, int(i % 3 == 0), *map(float, p)) for i, p in enumerate(points)]
    train = spark.createDataFrame(cells, "id long, y int, a double, b double, c double")
    reference = reference_points(train, ["a", "b", "c"], "y", "id", 7)
    assert reference.count() <= 607
    asked = np.vstack([np.round(rng.normal(size=(60, 3)) * 2, 2), [[0.5, -0.25, 1.0]] * 30])
    queries = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(asked)], "qid long, point array<double>")
    d = np.round(((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2), 9)
    want = {i: [int(j) for j in np.lexsort((np.arange(900), d[i]))[:7]] for i in range(len(asked))}
    narrow = {r.qid: [n.i for n in r.neighbours] for r in nearest_by_broadcast(queries, reference, 7).collect()}
    assert narrow == want
    for boxes, block in ((64, 20), (2, 1000)):
        wide = {r.qid: [n.i for n in r.neighbours] for r in nearest_by_boxes(queries, reference, 7, 3, "qid", boxes, block).collect()}
        assert wide == want


def test_knn_model_beyond_the_broadcast_limit(parts):
    train, test = parts
    model = zoo.fit_model("KNN", train)
    near = {r.id: r.y_proba for r in model.transform(test).collect()}
    model.broadcast_points = 10
    assert {r.id: r.y_proba for r in model.transform(test).collect()} == near


@pytest.mark.parametrize("name", ["GaussianNB", "SVM", "KNN", "Decision Tree", "Ridge Classifier"])
def test_saved_models_score_the_same(parts, tmp_path, name):
    train, test = parts
    fitted = zoo.fit_model(name, train, **SMALL.get(name, {}))
    fitted.save(str(tmp_path))
    again = load_model(str(tmp_path), name)
    before = {r.id: r.y_score for r in fitted.transform(test).select("id", "y_score").collect()}
    assert {r.id: r.y_score for r in again.transform(test).select("id", "y_score").collect()} == pytest.approx(before)


def test_native_importance_sums_to_one(parts):
    fitted = zoo.fit_model("Extra Trees", parts[0], **SMALL["Extra Trees"])
    got = {r.feature: r.importance for r in zoo.native_importance(fitted).collect()}
    assert set(got) <= set(zoo.FEATURES) and sum(got.values()) == pytest.approx(1.0)
    assert zoo.native_importance(zoo.fit_model("GaussianNB", parts[0])) is None


def test_cross_validation_scores_every_row_once(rows):
    predictions = evaluate.cross_validated_predictions(rows, ["GaussianNB", "Ridge Classifier"], 3)
    counts = predictions.groupBy("model").agg(F.count("id"), F.countDistinct("id")).collect()
    assert {tuple(r)[1:] for r in counts} == {(rows.count(), rows.count())}


def test_registry():
    assert len(zoo.ordered_model_names()) == 15 and set(zoo.PRESETS) == set(zoo.ordered_model_names())
    assert sum(zoo.needs_scaling(n) for n in zoo.ordered_model_names()) == 7
    assert [n for n in zoo.ordered_model_names() if not zoo.has_probability(n)] == ["Ridge Classifier"]


def test_trials_stay_in_range_and_repeat():
    for model, space in tuning.SEARCH_SPACES.items():
        for t in range(30):
            drawn = tuning.trial_parameters(model, t)
            assert drawn == tuning.trial_parameters(model, t)
            zoo.tuned_settings(model, drawn)
            for name, (kind, *limits) in space.items():
                assert drawn[name] in limits[0] if kind == "choice" else limits[0] <= drawn[name] <= limits[1]


def test_cost_profile(parts, tmp_path):
    row = cost.profile_models(*parts, str(tmp_path), ["GaussianNB"], repeats=1).first()
    assert row.model_size_kb > 0 and row.rows_per_second > 0
