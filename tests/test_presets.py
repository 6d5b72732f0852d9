"""The registered modelling queries ask for the whole job: all models, folds, trials, sizes, depths and presets."""

from __future__ import annotations

import inspect
from unittest import mock

import pytest

from gaugelab.catalog import QUERIES, modelling, scoring
from gaugelab.fixed_values import CV_FOLDS, RULE_DEPTHS, SEARCH_SPACES
from gaugelab.models import zoo

WHOLE = [
    ("cross_validate_models", modelling.evaluate, "cross_validate", {"models": None, "folds": CV_FOLDS}),
    ("evaluate_on_test", modelling.evaluate, "evaluate_on_test", {"models": None, "settings": None}),
    ("learning_curve", modelling.evaluate, "learning_curve", {"steps": 8, "folds": CV_FOLDS, "settings": None}),
    ("tuning_search", modelling.tuning, "search", {"models": None, "trials": 30, "folds": CV_FOLDS, "spaces": SEARCH_SPACES}),
    ("cost_profile", modelling.cost, "profile_models", {"models": None, "repeats": 5, "settings": None}),
    ("recursive_elimination", modelling.attribution, "recursive_elimination", {"folds": CV_FOLDS, "settings": None}),
    ("subset_impact", modelling.attribution, "subset_impact", {"folds": CV_FOLDS, "settings": None}),
    ("explain_forest", modelling.attribution, "explain_model", {"rows": 500, "background": 200}),
    ("rule_fidelity", scoring.rules, "rule_fidelity", {"depths": RULE_DEPTHS, "folds": CV_FOLDS}),
]


class Called(Exception):
    pass


def arguments(query, module, name, *patches) -> dict:
    """The arguments, with defaults, that a query gives to a function in place of which nothing runs."""
    real = inspect.signature(getattr(module, name))
    with mock.patch.object(module, name, side_effect=Called) as stand_in, mock.patch.object(modelling, "sensors"), mock.patch.object(scoring, "sensors"), mock.patch.object(modelling, "_parts", return_value=(1, 2)):
        with mock.patch.object(modelling, "run_folder"), mock.patch.object(scoring.split, "with_block_folds"), mock.patch.object(modelling, "fit_preparation"):
            with mock.patch.object(modelling.zoo, "fit_model") if name != "fit_model" else mock.MagicMock(), pytest.raises(Called):
                QUERIES[query](None, "")
    bound = real.bind(*stand_in.call_args.args, **stand_in.call_args.kwargs)
    bound.apply_defaults()
    return bound.arguments


@pytest.mark.parametrize("query, module, name, want", WHOLE)
def test_no_reduced_arguments(query, module, name, want):
    got = arguments(query, module, name)
    assert {k: got.get(k, got.get("kwargs", {}).get(k)) for k in want} == want
    assert not got.get("kwargs")


@pytest.mark.parametrize("query", ["model_random_forest", "model_extra_trees", "model_gradient_boosting", "model_xgboost", "model_lightgbm", "model_catboost", "native_importance", "explain_forest"])
def test_presets(query):
    assert not arguments(query, modelling.zoo, "fit_model").get("overrides")


def test_robustness_covers_all_models():
    fitted = []
    with mock.patch.object(modelling, "_parts", return_value=(1, 2)), mock.patch.object(modelling, "fit_preparation"), mock.patch.object(modelling.zoo, "fit_model", side_effect=lambda n, *a, **k: fitted.append((n, set(k)))):
        with mock.patch("gaugelab.operators.scenarios.robustness_extended"), mock.patch("gaugelab.operators.scenarios.robustness_summary_extended"):
            QUERIES["robustness_of_models"](None, "")
    assert fitted == [(n, {"preparation"}) for n in zoo.ordered_model_names()]
