"""The fifteen classifiers, their presets and how to fit them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import SQLTransformer, VectorSlicer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelab.fixed_values import FEATURES, MODEL_FAMILIES, SEED
from gaugelab.models.boosted_stumps import fit_stumps, stump_margin
from gaugelab.models.closed_form import gaussian_margin, gaussian_parameters, ridge_weights, score_stage, weighted_sum
from gaugelab.models.fitted import FittedModel
from gaugelab.models.fitted_trees import FittedTrees, fit_trees
from gaugelab.models.neighbours import NeighbourModel, fit_neighbours
from gaugelab.models.stages import RandomFourierFeatures
from gaugelab.models.trees import DEEPEST, Recipe
from gaugelab.operators.features import Preparation, fit_preparation, vector_stages
from gaugelab.storage import checkpoint_folder

# Presets per model; every one can be overridden when fitting.
PRESETS: dict[str, dict] = {
    "Logistic Regression": {"c": 1.0, "max_iter": 500},
    "Ridge Classifier": {"alpha": 1.0},
    "SGD Classifier": {"alpha": 1e-4, "max_iter": 500},
    "Decision Tree": {"max_depth": DEEPEST, "bins": 255, "min_leaf": 1, "min_split": 2},
    "Random Forest": {"trees": 300, "max_depth": DEEPEST, "bins": 64, "subset": "sqrt", "min_leaf": 1, "min_split": 2},
    "Extra Trees": {"trees": 300, "max_depth": DEEPEST, "bins": 64, "subset": "sqrt", "min_leaf": 1, "min_split": 2},
    "AdaBoost": {"rounds": 50, "bins": 64},
    "Gradient Boosting": {"rounds": 100, "max_depth": 3, "bins": 255, "rate": 0.1, "subsample": 1.0, "min_leaf": 1},
    "XGBoost": {"rounds": 400, "max_depth": 5, "bins": 255, "rate": 0.1, "subsample": 0.9, "by_tree": 0.9, "min_hessian": 1.0, "gamma": 0.0, "l2": 1.0},
    "LightGBM": {"rounds": 400, "max_depth": 5, "bins": 255, "rate": 0.05, "subsample": 1.0, "by_tree": 1.0, "min_leaf": 20, "leaves": 31},
    "CatBoost": {"rounds": 400, "max_depth": 6, "bins": 255, "rate": 0.05, "l2": 3.0},
    "KNN": {"k": 7},
    "GaussianNB": {"smoothing": 1e-9},
    "SVM": {"c": 1.0, "size": 200, "max_iter": 100},
    "MLP": {"hidden": [64, 32], "max_iter": 200},
}

LABEL = "_label"


def ordered_model_names() -> list[str]:
    return list(MODEL_FAMILIES)


def family(name: str) -> str:
    return MODEL_FAMILIES[name][0]


def needs_scaling(name: str) -> bool:
    return MODEL_FAMILIES[name][1]


def has_probability(name: str) -> bool:
    return name != "Ridge Classifier"


def fit_model(
    name: str,
    train: DataFrame,
    columns: Sequence[str] = FEATURES,
    y: str = "y",
    id_col: str = "id",
    preparation: Preparation | None = None,
    keep: Sequence[str] | None = None,
    seed: int = SEED,
    **overrides,
) -> FittedModel | FittedTrees | NeighbourModel:
    """Fit one model of the zoo on training rows.

    ``preparation`` reuses a learnt one, ``keep`` restricts the prepared
    outputs, ``overrides`` replace preset values.
    """
    settings = PRESETS[name] | overrides
    made = replace(preparation or fit_preparation(train, columns), scale=needs_scaling(name))
    checkpoint_folder(train.sparkSession)
    named = made.named_expressions(keep)
    if name == "KNN":
        return fit_neighbours(name, train, made, y, id_col, settings["k"])
    staged = train.select(*made.numeric, *made.categorical, F.col(y).cast("double").alias(LABEL), F.col(y))
    if name in _BY_COLUMNS:
        aliases = {f"_f{i}": e for i, e in enumerate(named.values())}
        prepared = staged.select(F.col(y), *[F.expr(e).alias(a) for a, e in aliases.items()])
        project = SQLTransformer(statement=f"SELECT *, {', '.join(f'{e} AS {a}' for a, e in aliases.items())} FROM __THIS__")
        stage = _BY_COLUMNS[name](prepared, list(aliases), y, settings)
        return FittedModel(name, PipelineModel([project, stage]), "columns")
    sources = made.sources()
    if name in TREE_MODELS:
        return fit_trees(name, train, named, sources, y, recipe(name, settings, seed), settings["bins"])
    lead, origin = vector_stages(list(named.values())), [sources[n] for n in named]
    fitted = Pipeline(stages=[*lead, *_ESTIMATORS[name](made.rows or train.count(), len(origin), settings, seed)]).fit(staged)
    return FittedModel(name, fitted, "vectors", {str(i): column for i, column in enumerate(origin)})


# Tree models.

TREE_MODELS = ["Decision Tree", "Random Forest", "Extra Trees", "Gradient Boosting", "XGBoost", "LightGBM", "CatBoost"]


def recipe(name: str, s: dict, seed: int = SEED) -> Recipe:
    """How the trees of a model are grown under given settings."""
    if name in ("Decision Tree", "Random Forest", "Extra Trees"):
        return Recipe(
            "forest", s.get("trees", 1), s["max_depth"], "random" if name == "Extra Trees" else "gini", subset=s.get("subset", "all"),
            bootstrap=name == "Random Forest", min_leaf=s["min_leaf"], min_split=s["min_split"], seed=seed,
        )
    return Recipe(
        "boost", s["rounds"], s["max_depth"], "variance" if name == "Gradient Boosting" else "newton", per_tree=s.get("by_tree", 1.0), sample=s.get("subsample", 1.0),
        min_leaf=s.get("min_leaf", 1), min_hessian=s.get("min_hessian", 0.0), min_gain=s.get("gamma", 0.0), l2=s.get("l2", 0.0), rate=s["rate"],
        leaves=s.get("leaves", 0), level=name == "CatBoost", centred=name != "CatBoost", seed=seed,
    )


# Models that end in a score expression.

def _ridge(prepared: DataFrame, names: list[str], y: str, s: dict):
    weights, intercept = ridge_weights(prepared, names, y, s["alpha"])
    return score_stage(weighted_sum(names, weights, intercept), proba=False)


def _gaussian(prepared: DataFrame, names: list[str], y: str, s: dict):
    return score_stage(gaussian_margin(names, gaussian_parameters(prepared, names, y, s["smoothing"])), proba=True)


def _adaboost(prepared: DataFrame, names: list[str], y: str, s: dict):
    return score_stage(stump_margin(fit_stumps(prepared, names, y, s["rounds"], s["bins"])), proba=True)


_BY_COLUMNS: dict[str, Callable] = {"Ridge Classifier": _ridge, "GaussianNB": _gaussian, "AdaBoost": _adaboost}


# Models that end in a Spark ML classifier.

def _logistic(rows: int, width: int, s: dict, seed: int) -> list:
    penalty = 1.0 / (s["c"] * rows)
    return [LogisticRegression(labelCol=LABEL, regParam=penalty, standardization=False, tol=1e-10, maxIter=s["max_iter"])]


def _sgd(rows: int, width: int, s: dict, seed: int) -> list:
    return [LogisticRegression(labelCol=LABEL, regParam=s["alpha"], standardization=False, maxIter=s["max_iter"])]


def _svm(rows: int, width: int, s: dict, seed: int) -> list:
    # Scaled numeric columns have variance about one, so 1 / width is the usual kernel width.
    penalty = 1.0 / (s["c"] * rows)
    return [
        RandomFourierFeatures(inputCol="features", outputCol="lifted", gamma=1.0 / width, size=s["size"], width=width, seed=seed),
        LinearSVC(featuresCol="lifted", labelCol=LABEL, regParam=penalty, maxIter=s["max_iter"], standardization=False, rawPredictionCol="margins", predictionCol="side"),
        VectorSlicer(inputCol="margins", outputCol="margin", indices=[1]),
        LogisticRegression(featuresCol="margin", labelCol=LABEL, rawPredictionCol="calibrated"),
    ]


def _perceptron(rows: int, width: int, s: dict, seed: int) -> list:
    return [MultilayerPerceptronClassifier(labelCol=LABEL, layers=[width, *s["hidden"], 2], maxIter=s["max_iter"], seed=seed)]


_ESTIMATORS: dict[str, Callable] = {
    "Logistic Regression": _logistic,
    "SGD Classifier": _sgd,
    "SVM": _svm,
    "MLP": _perceptron,
}


def native_importance(model) -> DataFrame | None:
    """Importances of a tree model summed to raw columns: (feature, importance); None for other models."""
    if not isinstance(model, FittedTrees):
        return None
    rows = [(model.sources[n], w) for n, w in model.importances().items()]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(F.sum("importance").alias("importance")).orderBy(F.desc("importance"), "feature")


def tuned_settings(name: str, params: dict) -> dict:
    """The settings that drawn search parameters stand for here; these are what is fitted and reported."""
    if name == "Random Forest":
        return {
            "trees": params["n_estimators"], "max_depth": params["max_depth"], "subset": params["max_features"] or "all",
            "min_leaf": params["min_samples_leaf"], "min_split": params["min_samples_split"],
        }
    if name == "XGBoost":
        return {
            "rounds": params["n_estimators"], "max_depth": params["max_depth"], "rate": params["learning_rate"], "subsample": params["subsample"],
            "by_tree": params["colsample_bytree"], "min_hessian": float(params["min_child_weight"]), "gamma": params["gamma"],
        }
    if name == "LightGBM":
        return {
            "rounds": params["n_estimators"], "max_depth": params["max_depth"], "rate": params["learning_rate"], "subsample": params["subsample"],
            "by_tree": params["colsample_bytree"], "min_leaf": params["min_child_samples"], "leaves": params["num_leaves"],
        }
    if name == "CatBoost":
        return {"rounds": params["iterations"], "max_depth": params["depth"], "rate": params["learning_rate"], "l2": params["l2_leaf_reg"]}
    raise KeyError(f"{name} has no search space")
