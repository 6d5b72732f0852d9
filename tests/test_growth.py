"""Trees: splits against brute force, the same trees whether cells are broadcast or not."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelab.models import growth, trees as tr, zoo
from gaugelab.models.growth import Fit

FOREST = tr.Recipe("forest", 3, tr.DEEPEST, "gini")
RECIPES = {
    "gini": tr.Recipe("forest", 3, tr.DEEPEST, "gini", subset="sqrt", bootstrap=True, min_leaf=2, min_split=4),
    "random": tr.Recipe("forest", 17, 4, "random", subset="log2"),
    "variance": tr.Recipe("boost", 2, 3, "variance"),
    "newton": tr.Recipe("boost", 3, 3, "newton", sample=0.8, per_tree=0.7, min_hessian=1.0, l2=1.0, min_gain=0.1),
    "leaves": tr.Recipe("boost", 2, 5, "newton", leaves=7, min_leaf=5),
    "level": tr.Recipe("boost", 2, 3, "newton", level=True, l2=3.0, centred=False),
}


def sample(rows=700, seed=1):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 40, rows) / 4, r.normal(size=rows).round(1), r.integers(0, 2, rows), np.ones(rows)])
    y = ((x[:, 0] > 5) ^ (x[:, 2] > 0) ^ (r.random(rows) < 0.1)).astype(int)
    return x, y


def cells(rows=700, bins=32):
    x, y = sample(rows)
    edges = [np.unique(np.quantile(c, np.arange(bins) / bins, method="lower")) for c in x.T]
    codes = tr.coded(x, edges)
    whole, n = np.unique(np.column_stack([np.arange(rows) % 3, codes, y]), axis=0, return_counts=True)
    return tr.Cells(whole[:, 1:-1].astype(np.uint8), whole[:, -1].astype(np.int8), n.astype(np.int64), whole[:, 0].astype(np.int32), edges)


def table(spark, made):
    return spark.createDataFrame([(int(f), bytes(c), int(y), int(n)) for f, c, y, n in zip(made.fold, made.codes, made.y, made.n)], "fold int, key binary, y int, n long").repartition(5)


def gini(y, w):
    return 0.0 if not w.sum() else 1 - (w[y == 1].sum() / w.sum()) ** 2 - (w[y == 0].sum() / w.sum()) ** 2


def test_best_split_is_the_purest_one():
    made = cells()
    offsets = tr.offsets_of(made.edges)
    w = made.n.astype(float)
    sums = tr.histogram(made.codes + offsets[:-1], np.zeros(len(w), int), np.stack([w, w * made.y]), 1, offsets[-1])
    feature, cut, gain, totals = tr.best_splits(FOREST, 0, np.array([1]), sums, offsets, made.edges, np.ones(4, bool))
    best = {}
    for f in range(4):
        for c in range(len(made.edges[f])):
            low = made.codes[:, f] <= c
            if w[low].sum() and w[~low].sum():
                best[f, c] = gini(made.y, w) * w.sum() - gini(made.y[low], w[low]) * w[low].sum() - gini(made.y[~low], w[~low]) * w[~low].sum()
    assert 2 * best[feature[0], cut[0]] / 2 == pytest.approx(max(best.values())) == pytest.approx(gain[0])
    assert totals[:, 0].tolist() == [w.sum(), (w * made.y).sum()]


def test_full_tree_separates_all_that_differs():
    made = cells()
    grown, _ = tr.grow_all(FOREST, made, np.arange(len(made.y)), np.ones(4, bool), range(1))
    leaf = grown[0].leaf_of(made.codes)
    for code in np.unique(made.codes, axis=0):
        same = (made.codes == code).all(axis=1)
        share = (made.n[same] * made.y[same]).sum() / made.n[same].sum()
        assert grown[0].value[leaf[same]] == pytest.approx(share)
    assert tr.importances(grown, 4).sum() == pytest.approx(1.0) and tr.importances(grown, 4)[3] == 0


def test_random_trees_do_not_share_cuts():
    made = cells(4000, 200)
    recipe = tr.Recipe("forest", 12, 1, "random", subset="sqrt")
    grown, _ = tr.grow_all(recipe, made, np.arange(len(made.y)), np.array([True, True, False, False]), range(12))
    assert len({(int(t.feature[0]), int(t.cut[0])) for t in grown}) >= 10


def test_limits_of_recipes():
    made = cells()
    everything = np.arange(len(made.y))
    grown, _ = tr.grow_all(RECIPES["leaves"], made, everything, np.ones(4, bool), range(2))
    assert all(len(np.unique(t.leaf_of(made.codes))) <= 7 for t in grown)
    grown, _ = tr.grow_all(RECIPES["level"], made, everything, np.ones(4, bool), range(2))
    assert all(len({(int(f), int(c)) for f, c, g in zip(t.feature, t.cut, t.left != np.arange(len(t.left))) if g}) <= 3 for t in grown)
    plain = tr.Recipe("boost", 1, 4, "newton", l2=1.0)
    loose = tr.grow_all(plain, made, everything, np.ones(4, bool), range(1))[0][0]
    least = float(loose.gain[0]) * 0.999  # the first split is just worth it
    tight = tr.grow_all(tr.Recipe("boost", 1, 4, "newton", l2=1.0, min_gain=least), made, everything, np.ones(4, bool), range(1))[0][0]
    assert 0 < (tight.gain > 0).sum() < (loose.gain > 0).sum() and tight.gain[tight.gain > 0].min() > least


def test_drawn_counts():
    u = (np.arange(20000) + 0.5) / 20000
    for n in (1, 3, 50, 5000):
        poisson = tr.drawn_counts(u, np.full(20000, n), None)
        assert poisson.mean() == pytest.approx(n, rel=0.02) and poisson.var() == pytest.approx(n, rel=0.05)
        some = tr.drawn_counts(u, np.full(20000, n), 0.8)
        assert some.mean() == pytest.approx(0.8 * n, rel=0.02) and some.max() <= n and some.var() == pytest.approx(0.16 * n, rel=0.08)


@pytest.mark.parametrize("name, limit", [*[(n, 0) for n in sorted(RECIPES)], ("gini", 60), ("random", 60)])
def test_wide_growth_gives_the_same_trees(spark, name, limit):
    made, recipe = cells(), RECIPES[name]
    fit = Fit(recipe, held=1, allowed=(True, True, True, False))
    want, base = tr.grow_all(recipe, made, np.flatnonzero(made.fold != 1), np.array(fit.allowed), range(recipe.trees))
    got, other = growth.grow_wide(table(spark, made), fit, made.edges, limit)
    assert base == pytest.approx(other) and len(got) == len(want)
    for a, b in zip(want, got):
        assert b.value[b.leaf_of(made.codes)] == pytest.approx(a.value[a.leaf_of(made.codes)], abs=1e-9)
        assert sorted(a.gain[a.gain > 0]) == pytest.approx(sorted(b.gain[b.gain > 0]))


def test_votes_both_ways(spark):
    made = cells()
    fits = [Fit(RECIPES["gini"], 0), Fit(RECIPES["newton"], 2), Fit(RECIPES["level"], None)]
    frame = table(spark, made)
    answers = []
    for limit in (None, 10):
        found, shares = growth.votes(frame, made.edges, fits, limit)
        answers.append(({(r["fit"], r["fold"], bytes(r["key"])): r["proba"] for r in found.collect()}, {r["fit"]: list(r["shares"]) for r in shares.collect()}))
    assert answers[0][0] == pytest.approx(answers[1][0]) and len(answers[0][0]) > 100
    assert {f for f, _, _ in answers[0][0]} == {0, 1}
    for f in range(3):
        assert answers[0][1][f] == pytest.approx(answers[1][1][f])


def test_model_over_the_limit_scores_the_same(rows, monkeypatch):
    settings = {"trees": 2, "max_depth": 5}
    train = rows.where("id % 3 > 0")
    small = zoo.fit_model("Random Forest", train, **settings)
    monkeypatch.setattr(growth, "LIMIT_CELLS", 100)
    wide = zoo.fit_model("Random Forest", train, **settings)
    near = {r["id"]: r["y_proba"] for r in small.transform(rows).collect()}
    assert {r["id"]: r["y_proba"] for r in wide.transform(rows).collect()} == pytest.approx(near)


def test_rows_with_nulls_new_levels_and_constant_columns(spark):
    data = [(i, None if i % 7 == 0 else float(i % 13), 1.0, None if i % 5 == 0 else "ab"[i % 2], int(i % 13 > 6)) for i in range(300)]
    train = spark.createDataFrame(data, "id long, a double, c double, kind string, y int")
    for name, settings in (("Decision Tree", {}), ("Extra Trees", {"trees": 5}), ("CatBoost", {"rounds": 5})):
        fitted = zoo.fit_model(name, train, ["a", "c", "kind"], **settings)
        asked = spark.createDataFrame([(1, None, None, "new"), (2, 1.0, 9.0, None), (3, float("nan"), 1.0, "a")], "id long, a double, c double, kind string")
        assert fitted.transform(asked).where(F.col("y_proba").between(0, 1)).count() == 3
    one_class = zoo.fit_model("Random Forest", train.withColumn("y", F.lit(1)), ["a"], trees=3)
    assert {r["y_proba"] for r in one_class.transform(train).collect()} == {1.0}
    one_class = zoo.fit_model("XGBoost", train.withColumn("y", F.lit(0)), ["a"], rounds=3)
    assert all(r["y_pred"] == 0 for r in one_class.transform(train).collect())
