"""Models whose parameters follow from one or two aggregates: ridge and Gaussian naive Bayes.

Each returns the SQL of its score, so that scoring is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.operators.features import sql_number

PROBABILITY_SQL = "1 / (1 + exp(-({margin})))"


def score_stage(margin: str, proba: bool) -> SQLTransformer:
    """Stage adding y_score, y_proba and y_pred for a margin that favours class 1 when positive."""
    chance = PROBABILITY_SQL.format(margin="_margin") if proba else "CAST(NULL AS DOUBLE)"
    score = chance if proba else "_margin"
    return SQLTransformer(
        statement=f"SELECT *, CASE WHEN _margin > 0 THEN 1 ELSE 0 END AS y_pred, {chance} AS y_proba, {score} AS y_score FROM (SELECT *, {margin} AS _margin FROM __THIS__)"
    )


def weighted_sum(names: Sequence[str], weights: Sequence[float], intercept: float) -> str:
    return " + ".join([sql_number(float(intercept)), *[f"{sql_number(float(w))} * `{n}`" for n, w in zip(names, weights)]])


def ridge_weights(prepared: DataFrame, names: Sequence[str], y: str = "y", alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge regression on a -1/+1 target: centred Gramian in one pass, p x p solve on the driver."""
    target = 2.0 * F.col(y) - 1.0
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = prepared.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(target).alias("t"),
        *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.covar_pop(names[i], names[j]).alias(f"g{i}_{j}") for i, j in cells],
        *[F.covar_pop(F.col(n), target).alias(f"h{i}") for i, n in enumerate(names)],
    ).first()
    p = len(names)
    gram, moment = np.zeros((p, p)), np.array([row[f"h{i}"] for i in range(p)]) * row["n"]
    for i, j in cells:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] * row["n"]
    weights = np.linalg.solve(gram + alpha * np.eye(p), moment)
    return weights, float(row["t"] - weights @ np.array([row[f"m{i}"] for i in range(p)]))


def gaussian_parameters(prepared: DataFrame, names: Sequence[str], y: str = "y", smoothing: float = 1e-9) -> dict[int, dict]:
    """Prior, means and smoothed population variances per class, from one grouped pass."""
    moments = [F.avg(n).alias(f"m{i}") for i, n in enumerate(names)] + [F.var_pop(n).alias(f"v{i}") for i, n in enumerate(names)]
    rows = prepared.groupBy(F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"), *moments).collect()
    total = sum(r["n"] for r in rows)
    p = range(len(names))
    # Variance over all rows from the class moments.
    overall = []
    for i in p:
        mean = sum(r["n"] * r[f"m{i}"] for r in rows) / total
        overall.append(sum(r["n"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in rows) / total)
    extra = smoothing * max(overall)
    return {r["y"]: {"prior": r["n"] / total, "mean": [r[f"m{i}"] for i in p], "var": [r[f"v{i}"] + extra for i in p]} for r in rows}


def gaussian_margin(names: Sequence[str], parameters: dict[int, dict]) -> str:
    """SQL of log p(1|x) - log p(0|x)."""
    if set(parameters) != {0, 1}:
        return sql_number(1e3 if 1 in parameters else -1e3)

    def joint(k: int) -> str:
        q = parameters[k]
        constant = float(np.log(q["prior"]) - 0.5 * np.sum(np.log(2.0 * np.pi * np.array(q["var"]))))
        terms = [f"({sql_number(-0.5 / v)} * power(`{n}` - {sql_number(m)}, 2))" for n, m, v in zip(names, q["mean"], q["var"])]
        return " + ".join([sql_number(constant), *terms])

    return f"({joint(1)}) - ({joint(0)})"
