"""Edge cases and properties of the operators."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugelab.operators import association, attribution, cleaning, curves, errors, features, metrics, profile, rules, scenarios, significance
from gaugelab.plans.bindings import score_all

PRED = "model string, id long, y int, y_pred int, y_proba double, y_score double"


def frame(spark, cells, schema=PRED):
    return spark.createDataFrame(cells, schema)


def test_labels_are_capitalised_not_title_cased(spark):
    raw = spark.createDataFrame([("bAD foo",), (" BAD\t",), (None,), ("good",)], "Class string")
    assert {r.Class for r in cleaning.normalise_labels(raw).collect()} == {"Bad foo", "Bad", "Nan", "Good"}


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("Bad",), ("Rotten",)], "Class string")
    with pytest.raises(Exception, match="neither Good nor Bad"):
        df.select(cleaning.encoded_target(F.col("Class"))).collect()
    assert [r[0] for r in df.select(cleaning.lenient_target(F.col("Class"))).collect()] == [1, 0]


def test_duplicates_with_missing_cells(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    row = cleaning.duplicate_analysis(df).first()
    assert (row.n_rows, row.n_exact_duplicates, row.n_unique) == (3, 1, 2)
    kept = cleaning.drop_exact_duplicates(df.withColumn("id", F.monotonically_increasing_id()), "id")
    assert kept.count() == 2


def test_cleaning_report_counts_missing(spark):
    raw = spark.createDataFrame(
        [("A", 1.0, float("nan"), 2.0, 3.0, "BAD"), ("A", 1.0, float("nan"), 2.0, 3.0, "Bad "), (None, 1.0, 5.0, 2.0, 3.0, "good")],
        "Fruit string, Temp double, `Humid (%)` double, `Light (Fux)` double, `CO2 (pmm)` double, Class string",
    )
    got = {(r.section, r.label): r.n for r in cleaning.cleaning_report(raw).collect()}
    assert got == {
        ("raw_rows", ""): 3, ("raw_columns", ""): 6, ("raw_class", "Bad"): 2, ("raw_class", "Good"): 1, ("duplicates_removed", ""): 1,
        ("clean_rows", ""): 2, ("class", "Bad"): 1, ("class", "Good"): 1, ("fruit", "A"): 1, ("missing_values", ""): 2,
    }


def test_nan_is_missing_in_profiles(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "Temp double")
    row = profile.descriptive_stats(df, ["Temp"]).first()
    assert (row["count"], row["mean"], row["max"], row.q50) == (2, 2.0, 3.0, 2.0)


def test_moments_of_a_constant(spark):
    row = profile.moments(spark.range(10).select(F.lit(4.0).alias("Temp")), ["Temp"]).first()
    assert (row["std"], row["skew"], row["kurtosis"]) == (0.0, 0.0, 0.0)


def test_skew_and_kurtosis_match_pandas(spark, rows):
    local = rows.select("Temp", "CO2").toPandas()
    for r in profile.moments(rows, ["Temp", "CO2"]).collect():
        assert r["skew"] == pytest.approx(local[r.feature].skew())
        assert r["kurtosis"] == pytest.approx(local[r.feature].kurtosis())


def test_one_class_has_no_ranking_metrics(spark):
    row = metrics.metric_suite(frame(spark, [("m", 1, 1, 1, 0.9, 0.9), ("m", 2, 1, 0, 0.2, 0.2)])).first()
    assert (row.roc_auc, row.pr_auc) == (None, None)
    assert (row.recall, row.balanced_accuracy, row.mcc) == (0.5, 0.5, 0.0)


def test_constant_predictions_and_tied_scores(spark):
    row = metrics.metric_suite(frame(spark, [("m", i, i % 2, 0, 0.5, 0.5) for i in range(10)])).first()
    assert (row.precision, row.f1, row.mcc, row.roc_auc, row.pr_auc) == (0.0, 0.0, 0.0, 0.5, 0.5)


def test_step_average_precision_on_ties(spark):
    cells = [("m", i, y, int(s >= 0.5), s, s) for i, (y, s) in enumerate([(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.7), (0, 0.7), (0, 0.2), (1, 0.1)])]
    y, s = np.array([c[2] for c in cells]), np.array([c[5] for c in cells])
    want = 0.0
    for t in sorted(set(s), reverse=True):
        want += ((s == t) & (y == 1)).sum() / y.sum() * ((s >= t) & (y == 1)).sum() / (s >= t).sum()
    assert metrics.metric_suite(frame(spark, cells)).first().pr_auc == pytest.approx(want)


def test_auc_of_negated_scores(spark, rows):
    p = score_all(rows).where(F.col("model") == "S2")
    turned = p.withColumns({"y_score": -F.col("y_score"), "model": F.lit("turned")})
    got = metrics.ranking_metrics(p.unionByName(turned), ["model"]).toPandas().set_index("model")["roc_auc"]
    assert got["S2"] + got["turned"] == pytest.approx(1.0)
    areas = curves.curve_areas(p).first()
    assert areas.roc_area == pytest.approx(got["S2"])


def test_scores_without_probability(spark, rows):
    found = metrics.metric_suite(score_all(rows)).toPandas().set_index("model")
    assert pd.isna(found.loc["S6", "log_loss"]) and pd.isna(found.loc["S6", "brier_score"]) and not pd.isna(found.loc["S6", "roc_auc"])
    assert set(curves.calibration_points(score_all(rows)).select("model").distinct().toPandas()["model"]) == {"S1", "S2", "S3", "S4", "S5"}


def test_no_errors(spark):
    clean = errors.outcome_columns(spark.createDataFrame([(1, 1, 0.9)], "y_true int, y_pred int, p_bad double"))
    row = errors.borderline(clean).first()
    assert (row.n_errors, row.n_borderline, row.pct_borderline, row.mean_error_confidence) == (0, 0, 0.0, None)
    assert errors.borderline(clean.drop("p_bad")) is None


def test_mcnemar_counts_against_pandas(rows):
    p = score_all(rows)
    wide = p.withColumn("ok", F.col("y") == F.col("y_pred")).toPandas().pivot(index="id", columns="model", values="ok")
    for r in significance.mcnemar_counts(p, ["S1", "S3", "S4"]).collect():
        assert r.b == (wide[r.model_a] & ~wide[r.model_b]).sum()
        assert r.c == (~wide[r.model_a] & wide[r.model_b]).sum()


def test_single_fold_has_no_interval(spark):
    one = spark.createDataFrame([("m", 0.5)], "model string, f1 double")
    row = significance.fold_summary(one, ["f1"]).first()
    assert (row["mean"], row["std"], row.ci_low) == (0.5, None, None)


def test_ramp(spark):
    assert scenarios.with_ramp(spark.range(1)).first().ramp == 0.0
    got = [r.ramp for r in scenarios.with_ramp(spark.range(5)).orderBy("id").collect()]
    assert got == pytest.approx([0.0, 0.25, 0.5, 0.75, 1.0])


def test_clean_rows_are_neither_moved_nor_clipped(spark):
    df = spark.createDataFrame([(1, 20.0, 120.0, -5.0, 10.0)], "id long, Temp double, Humidity double, Light double, CO2 double")
    row = scenarios.perturbed(df, [scenarios.CLEAN, scenarios.shift_scenarios()[0]]).collect()
    assert (row[0].Humidity, row[0].Light) == (120.0, -5.0)
    assert (row[1].Temp, row[1].Humidity, row[1].Light) == (21.0, 100.0, 0.0)


def test_noise_is_the_same_for_any_layout(rows):
    listed = scenarios.noise_scenarios([1.0], 2)
    one = scenarios.perturbed(rows.coalesce(1), listed).agg(F.sum("Temp"), F.sum("CO2")).first()
    many = scenarios.perturbed(rows.repartition(13), listed).agg(F.sum("Temp"), F.sum("CO2")).first()
    assert tuple(one) == pytest.approx(tuple(many), rel=1e-12)
    draws = scenarios.perturbed(rows, listed).where("repeat = 0").join(rows.select("id", F.col("CO2").alias("base")), "id").select((F.col("CO2") - F.col("base")).alias("z")).toPandas()["z"] / 20.0
    assert abs(draws.mean()) < 0.15 and abs(draws.std() - 1.0) < 0.1


def test_extended_scenarios_have_twenty_labels():
    assert len({s.label for s in scenarios.extended_scenarios()}) == 20
    assert len(scenarios.basic_scenarios()) == 10


def test_category_preparation(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 3.0), ("a", None), ("c", 8.0), ("c", 2.0)], "Fruit string, Temp double")
    made = features.fit_preparation(train, ["Temp", "Fruit"])
    assert made.outputs == ["num__Temp", "cat__Fruit_a", "cat__Fruit_b", "cat__Fruit_c"]
    assert made.modes == {"Fruit": "a"} and made.medians == {"Temp": 2.5}
    filled = np.array([1.0, 3.0, 2.5, 8.0, 2.0])
    assert (made.means["Temp"], made.scales["Temp"]) == pytest.approx((filled.mean(), filled.std()))
    got = spark.createDataFrame([("zzz", float("nan")), (None, 8.0)], "Fruit string, Temp double").select(*made.columns()).collect()
    assert tuple(got[0])[1:] == (0.0, 0.0, 0.0) and tuple(got[1])[1:] == (1.0, 0.0, 0.0)
    assert got[0][0] == pytest.approx((2.5 - filled.mean()) / filled.std())
    assert features.Preparation.from_json(made.to_json()) == made


def test_feature_types(spark):
    df = spark.createDataFrame([(1, True, "x", 2.0)], "i int, b boolean, s string, d double")
    assert features.detect_feature_types(df) == (["i", "b", "d"], ["s"])


def test_perfect_and_absent_association(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "Bad").otherwise("Good").alias("Class"), (F.col("id") % 4).cast("string").alias("four"), F.lit("k").alias("one"))
    long = df.unpivot(["Class"], ["four", "one"], "feature", "level")
    found = {r.feature: r.cramers_v for r in association.cramers_v(long, "Class").collect()}
    # chi2 = n for a perfect 4 x 2 table; the bias correction takes 3/399 off phi2 and 1/399 off k.
    assert found["four"] == pytest.approx(math.sqrt((1 - 3 / 399) / (1 - 1 / 399))) and found["one"] is None
    information = {r.feature: r.mutual_information for r in association.plugin_mutual_information(long, "Class").collect()}
    assert information["four"] == pytest.approx(math.log(2)) and information["one"] == pytest.approx(0.0)


def test_neighbour_information_by_brute_force(rows):
    df = rows.select("id", "y", "Temp", "CO2")
    got = {r.feature: r.mutual_information for r in association.neighbour_mutual_information(df, "y", ["Temp", "CO2"]).collect()}
    scaled = association._scaled_with_jitter(df, "y", ["Temp", "CO2"], "id", 42).toPandas()
    digamma = lambda m: -0.5772156649015329 + sum(1.0 / i for i in range(1, int(m)))
    for feature, part in scaled.groupby("feature"):
        x, y = part["value"].to_numpy(), part["y"].to_numpy()
        inside, k_all, c_all = [], [], []
        for c in (0, 1):
            own = x[y == c]
            k = min(3, len(own) - 1)
            gaps = np.sort(np.abs(own[:, None] - own[None, :]), axis=1)[:, k]
            inside += [digamma((np.abs(x - v) < g).sum()) for v, g in zip(own, gaps)]
            k_all += [digamma(k)] * len(own)
            c_all += [digamma(len(own))] * len(own)
        want = digamma(len(x)) + np.mean(k_all) - np.mean(c_all) - np.mean(inside)
        assert got[feature] == pytest.approx(max(0.0, want), abs=2e-3)


def test_leakage_flag(spark):
    df = spark.range(500).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 * 10.0 + F.col("id") / 1000.0).alias("Temp"), (F.col("id") % 7).cast("double").alias("CO2"))
    found = {r.feature: r for r in association.leakage_scan(df, features=["Temp", "CO2"]).collect()}
    assert found["Temp"].flag == "possible-leakage" and found["Temp"].best_single_split_acc == pytest.approx(1.0)
    assert found["CO2"].flag == "ok"


def test_threshold_rule_is_recovered(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 500, "p").otherwise("q").alias("Fruit"), (F.col("id") % 50).cast("double").alias("Temp"), F.lit(5.0).alias("Humidity"),
        (F.col("id") % 37).cast("double").alias("Light"), (F.col("id") % 11).cast("double").alias("CO2"),
    ).withColumn("y", F.when(F.col("Fruit") == "p", F.col("Temp") > 20).otherwise(F.col("Light") <= 9).cast("int"))
    found = {r.Fruit: r for r in rules.threshold_rules(df).collect()}
    assert (found["p"].rule, found["p"].accuracy) == ("Temp > 20.5 °C", 1.0)
    assert (found["q"].rule, found["q"].accuracy) == ("Light <= 9.5 Lux", 1.0)


def test_rule_fidelity_grows_with_depth(rows):
    from gaugelab.operators.split import with_block_folds

    got = rules.rule_fidelity(with_block_folds(rows), depths=[1, 2, 3]).orderBy("max_depth").collect()
    assert [r.leaves for r in got][0] == 2
    accuracy = [r.resubstitution_accuracy for r in got]
    assert accuracy == sorted(accuracy) and all(0.4 < r.cv_accuracy <= 1.0 for r in got)


def test_shuffling_keeps_every_value(rows):
    copies = attribution.shuffled_copies(rows, ["Temp", "CO2"], repeats=2)
    want = sorted(r.Temp for r in rows.select("Temp").collect())
    for repeat in (0, 1):
        part = copies.where((F.col("repeat") == repeat) & (F.col("shuffled") == "Temp")).select("id", "Temp", "CO2").toPandas()
        assert sorted(part["Temp"]) == want
        moved = part.merge(rows.select("id", "Temp", "CO2").toPandas(), on="id")
        assert (moved["CO2_x"] == moved["CO2_y"]).all() and (moved["Temp_x"] != moved["Temp_y"]).mean() > 0.9


def test_shuffling_an_unused_or_constant_feature_costs_nothing(rows):
    df = rows.withColumn("CO2", F.lit(3.0))
    score = lambda d: d.withColumn("y_pred", ((F.col("Humidity") > 50) & (F.col("CO2") > 1)).cast("int"))
    got = {r.feature: r.importance_mean for r in attribution.permutation_importance(df, score, ["Humidity", "CO2", "Light"], repeats=3).collect()}
    assert got["CO2"] == 0.0 and got["Light"] == 0.0 and got["Humidity"] > 0.0


def test_shapley_adds_up(rows):
    names = ["Temp", "Humidity", "Fruit"]
    score = lambda d: d.withColumn("y_score", F.col("Temp") * F.col("Humidity") + F.when(F.col("Fruit") == "view", 100.0).otherwise(0.0))
    explain, background = rows.orderBy("id").limit(10), rows.orderBy(F.desc("id")).limit(7)
    got = attribution.shapley_values(explain, background, score, names).toPandas()
    total = got.groupby("id").agg(a=("attribution", "sum"), s=("score", "first"), b=("base", "first"))
    assert np.allclose(total.a, total.s - total.b)


def test_histogram_of_a_constant(spark):
    got = curves.histogram(spark.range(4).select(F.lit(2.0).alias("v")), "v", 4).toPandas()
    assert got["n"].sum() == 4 and len(got) == 4


def test_box_whiskers(spark):
    df = spark.createDataFrame([("Bad", float(v)) for v in [1, 2, 3, 4, 100]], "Class string, Temp double")
    row = curves.box_summary(df, ["Temp"]).first()
    assert (row.q25, row.q50, row.q75, row.whisker_low, row.whisker_high, row.n_fliers) == (2.0, 3.0, 4.0, 1.0, 4.0, 1)


def test_cuts_are_ordered_without_rounding(spark):
    from fractions import Fraction

    from gaugelab.operators.rules import _exact_order

    draw = random.Random(4)
    rows = []
    for n in (2, 7, 1000, 10**7, 10**9, 10**12):
        for _ in range(60):
            left = draw.randint(1, n - 1)
            left_pos, right_pos = draw.randint(0, left), draw.randint(0, n - left)
            rows.append((len(rows), float(left), float(left_pos), float(n), float(left_pos + right_pos)))
    # Nearly equal: one row more or less on one side of very many.
    n = 10**12
    rows += [(len(rows) + i, float(n // 2 + i), float(n // 4), float(n), float(n // 2)) for i in range(-3, 4)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]

    def half_gini(r):
        _, ln, lp, tn, tp = (int(x) for x in r)
        rn, rp = tn - ln, tp - lp
        return Fraction(lp * (ln - lp), ln) + Fraction(rp * (rn - rp), rn)

    found = _exact_order(spark.createDataFrame(rows, "id long, left_n double, left_pos double, all_n double, all_pos double")).collect()
    key = {r.id: tuple(r.order_impurity) for r in found}
    exact = {r[0]: half_gini(r) for r in rows}
    by_key, by_value = sorted(rows, key=lambda r: (key[r[0]], r[0])), sorted(rows, key=lambda r: (exact[r[0]], r[0]))
    assert [r[0] for r in by_key] == [r[0] for r in by_value]
    for a, b in zip(by_key, by_key[1:]):
        assert (key[a[0]] == key[b[0]]) == (exact[a[0]] == exact[b[0]])
