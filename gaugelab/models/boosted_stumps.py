"""AdaBoost over one-cut trees.

Rows are first reduced to counts of distinct (cell, y) combinations, a cell
being the vector of quantile bins. Each round adds weights per (feature, bin)
in one job; only that histogram (features x bins) reaches the driver, which
picks the stump. Row weights are a closed expression of the stumps so far, so
no lineage builds up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelab.operators.features import sql_number
from gaugelab.operators.profile import quantile_lookup


def cut_points(prepared: DataFrame, names: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Candidate cuts per feature: midpoints between neighbouring distinct quantiles."""
    found = quantile_lookup(prepared, names, [i / bins for i in range(bins + 1)])
    cuts = {}
    for name in names:
        values = sorted(set(found[name]))
        cuts[name] = [(a + b) / 2.0 for a, b in zip(values, values[1:])]
    return cuts


def _stump_vote(code: Column, cut: int, low: float, high: float) -> Column:
    return F.when(code <= cut, F.lit(low)).otherwise(F.lit(high))


def fit_stumps(prepared: DataFrame, names: Sequence[str], y: str = "y", rounds: int = 50, bins: int = 64) -> list[dict]:
    """Stumps as dicts feature, threshold, low, high (votes -1/+1) and weight."""
    cuts = cut_points(prepared, names, bins)
    useful = [n for n in names if cuts[n]]
    # Code = number of cuts <= value, by binary search.
    coded = Bucketizer(inputCols=useful, outputCols=[f"{n}_code" for n in useful], splitsArray=[[-math.inf, *cuts[n], math.inf] for n in useful])
    codes = [F.col(f"{n}_code").cast("int").alias(n) for n in useful]
    cells = coded.transform(prepared).select(*codes, F.col(y).cast("int").alias("y")).groupBy(*useful, "y").agg(F.count(F.lit(1)).cast("double").alias("count"))
    cells = cells.persist()
    stumps: list[dict] = []
    try:
        target = F.col("y") * 2 - 1
        log_weight: Column = F.lit(0.0)
        for _ in range(rounds):
            weighted = cells.withColumn("w", F.col("count") * F.exp(log_weight))
            histogram = (
                weighted.select("y", "w", F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("code")) for i, n in enumerate(useful)])))
                .groupBy("f", "code", "y").agg(F.sum("w").alias("w")).collect()
            )
            best = _best_stump(histogram, len(useful))
            if best is None or best["error"] >= 0.5:
                break
            name = useful[best["f"]]
            perfect = best["error"] <= 0.0
            weight = 1.0 if perfect else math.log((1.0 - best["error"]) / best["error"])
            stumps.append({"feature": name, "threshold": cuts[name][best["cut"]], "low": best["low"], "high": best["high"], "weight": weight})
            if perfect:
                break
            wrong = _stump_vote(F.col(name), best["cut"], best["low"], best["high"]) != target
            log_weight = log_weight + F.when(wrong, F.lit(weight)).otherwise(F.lit(0.0))
    finally:
        cells.unpersist()
    return stumps


def _best_stump(histogram, features: int) -> dict | None:
    """Purest weighted cut of one round; earlier features and lower cuts win ties."""
    total = np.zeros(2)
    tables: list[dict[int, np.ndarray]] = [dict() for _ in range(features)]
    for r in histogram:
        tables[r["f"]].setdefault(r["code"], np.zeros(2))[r["y"]] += r["w"]
        if r["f"] == 0:
            total[r["y"]] += r["w"]
    best = None
    for f, table in enumerate(tables):
        left = np.zeros(2)
        ordered = sorted(table)
        for code in ordered[:-1]:
            left = left + table[code]
            right = total - left
            gini = sum(2.0 * side[0] * side[1] / side.sum() for side in (left, right) if side.sum() > 0) / total.sum()
            if best is None or gini < best["gini"] - 1e-12:
                low, high = (1.0 if left[1] > left[0] else -1.0), (1.0 if right[1] > right[0] else -1.0)
                error = (left[0 if low > 0 else 1] + right[0 if high > 0 else 1]) / total.sum()
                best = {"f": f, "cut": code, "gini": gini, "low": low, "high": high, "error": float(error)}
    return best


def stump_margin(stumps: Sequence[dict]) -> str:
    """SQL of the normalised weighted vote in [-1, 1]."""
    if not stumps:
        return sql_number(-1.0)
    total = sum(s["weight"] for s in stumps)
    votes = [
        f"(CASE WHEN `{s['feature']}` < {sql_number(s['threshold'])} THEN {sql_number(s['low'] * s['weight'] / total)} ELSE {sql_number(s['high'] * s['weight'] / total)} END)"
        for s in stumps
    ]
    return " + ".join(votes)
