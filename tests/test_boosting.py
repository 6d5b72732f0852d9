"""Boosted trees over parts that workers keep, against growth on cells at hand."""

from __future__ import annotations

import numpy as np
import pytest

from gaugelab.models import growth, trees as tr
from gaugelab.models.growth import Fit
from tests.test_growth import RECIPES, cells, table

BOOSTED = [n for n in sorted(RECIPES) if RECIPES[n].kind == "boost"]
ALLOWED = np.array([True, True, True, False])


def parts_of(made, recipe, base, parts=3):
    """Parts of the cells, the last one empty."""
    at = np.arange(len(made.y)) % max(1, parts - 1)
    return [tr.BoostedPart(recipe, tr.Cells(made.codes[at == p], made.y[at == p], made.n[at == p], made.fold[at == p], made.edges), base) for p in range(parts)]


@pytest.mark.parametrize("name", BOOSTED)
@pytest.mark.parametrize("lost", [False, True])
def test_parts_give_the_same_trees_also_when_made_anew(name, lost, monkeypatch):
    monkeypatch.setattr(tr.BoostedPart, "SLICE", 100)
    made, recipe = cells(3000), RECIPES[name]
    want, base = tr.grow_all(recipe, made, np.arange(len(made.y)), ALLOWED, range(recipe.trees))
    kept, past = parts_of(made, recipe, base), []

    def sums_of(moves, slot, nodes, used):
        if lost:  # one worker has lost its part, another has not seen the last jobs
            kept[0] = parts_of(made, recipe, base)[0]
        return sum(p.sums(past, moves, slot, nodes, used) for p in kept)

    for t, tree in enumerate(want):
        got, moves, value = tr.boosted_tree(recipe, t, made.edges, ALLOWED, sums_of)
        assert got.value[got.leaf_of(made.codes)] == pytest.approx(tree.value[tree.leaf_of(made.codes)], abs=1e-9)
        past.append((moves, value))


def test_large_boosted_fits_take_a_job_a_level(spark, monkeypatch):
    """Neither are margins written after each tree nor sums shuffled."""
    def refused(*_):
        raise AssertionError("not kept by workers")

    monkeypatch.setattr(growth, "_with_margins", refused)
    monkeypatch.setattr(growth, "PART_LEAST", 100)
    made = cells()
    for name in BOOSTED:
        recipe = RECIPES[name]
        want, _ = tr.grow_all(recipe, made, np.flatnonzero(made.fold != 1), ALLOWED, range(recipe.trees))
        got, _ = growth.grow_wide(table(spark, made), Fit(recipe, 1, tuple(ALLOWED)), made.edges, 0)
        assert np.array([t.value[t.leaf_of(made.codes)] for t in got]) == pytest.approx(np.array([t.value[t.leaf_of(made.codes)] for t in want]), abs=1e-9)


def test_parts_that_are_too_large_are_not_kept(spark, monkeypatch):
    made, recipe = cells(), RECIPES["newton"]
    monkeypatch.setattr(growth, "PART_MOST", 10)
    monkeypatch.setattr(growth, "_grown_together", lambda *_: pytest.fail("kept by workers"))
    want, _ = tr.grow_all(recipe, made, np.arange(len(made.y)), ALLOWED, range(recipe.trees))
    got, _ = growth.grow_wide(table(spark, made), Fit(recipe, None, tuple(ALLOWED)), made.edges, 0)
    assert np.array([t.value[t.leaf_of(made.codes)] for t in got]) == pytest.approx(np.array([t.value[t.leaf_of(made.codes)] for t in want]), abs=1e-9)


def test_draws_of_single_rows():
    u, n = (np.arange(2000) + 0.5) / 2000, np.where(np.arange(2000) % 3, 1, 4)
    drawn = tr.drawn_counts(u, n, 0.9)
    assert (drawn[n == 1] == (u[n == 1] > 1 - 0.9)).all() and drawn[n == 4] == pytest.approx(tr.drawn_counts(u[n == 4], n[n == 4], 0.9))


def test_rows_leave_the_walk_at_their_leaf():
    made = cells(3000)
    tree = tr.grow_all(RECIPES["gini"], made, np.arange(len(made.y)), np.ones(4, bool), range(1))[0][0]
    want = np.zeros(len(made.y), np.int64)
    for i, code in enumerate(made.codes):
        while tree.left[want[i]] != want[i]:
            want[i] = tree.left[want[i]] + (code[tree.feature[want[i]]] > tree.cut[want[i]])
    assert (tree.leaf_of(made.codes) == want).all()
