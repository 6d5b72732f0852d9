"""Split, metric, curve, significance, error and scenario queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gaugelab.catalog.audit import _histogram
from gaugelab.catalog.base import SENSORS, duck_normal, duck_word, query, scored, unpivoted
from gaugelab.fixed_values import COMBINED_SHIFTS, DRIFTS, NOISE_LEVELS, NOISE_REPEATS, NOISE_SIGMA, SENSORS as SENSOR_NAMES, SINGLE_SHIFTS
from gaugelab.operators import compare, curves, errors, features, metrics, rules, scenarios, significance, split
from gaugelab.plans.bindings import FIXED_SCORERS as MODELS
from gaugelab.plans.bindings import predictions, score_all, sensors


# Splits.

def _hash(purpose: str, extra: str = "id") -> str:
    return duck_word("'42'", f"'{purpose}'", extra)


_SPLIT = f"""{SENSORS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_hash('split')}, id) AS rn, count(*) OVER (PARTITION BY y) AS nc, count(*) OVER () AS n FROM sensors),
    share AS (SELECT y, want, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, y) <= want - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS n_test
      FROM (SELECT y, min(ceil(n * 0.2)) AS want, min(ceil(n * 0.2) * nc / n) AS exact FROM ranked GROUP BY y)),
    parts AS (SELECT r.*, CASE WHEN r.rn <= share.n_test THEN 'test' ELSE 'train' END AS split FROM ranked r JOIN share ON r.y = share.y)"""


@query("stratified_split", f"WITH {_SPLIT} SELECT id, y, split FROM parts")
def _(spark, sf):
    return split.with_split(sensors(spark, sf)).select("id", "y", "split")


@query("split_sizes", f"WITH {_SPLIT} SELECT split AS partition, count(*) AS n_samples, CAST(sum(y) AS BIGINT) AS n_bad, CAST(sum(1 - y) AS BIGINT) AS n_good FROM parts GROUP BY 1")
def _(spark, sf):
    return split.split_sizes(split.with_split(sensors(spark, sf)))


_FOLDS = f"""{SENSORS}, folded AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY y ORDER BY {_hash('fold')}, id) - 1) * 5 / count(*) OVER (PARTITION BY y)) AS INT) AS fold FROM sensors)"""


@query("stratified_folds", f"WITH {_FOLDS} SELECT id, y, fold FROM folded")
def _(spark, sf):
    return split.with_folds(sensors(spark, sf)).select("id", "y", "fold")


@query(
    "block_folds",
    f"""WITH {SENSORS} SELECT id, y, CAST(floor((row_number() OVER (PARTITION BY y ORDER BY id) - 1) * 5 / count(*) OVER (PARTITION BY y)) AS INT) AS fold FROM sensors""",
)
def _(spark, sf):
    return split.with_block_folds(sensors(spark, sf)).select("id", "y", "fold")


@query("bounded_sample", f"WITH {SENSORS} SELECT id, Fruit, Temp, y FROM sensors ORDER BY {_hash('sample')}, id LIMIT 500", "Temp")
def _(spark, sf):
    return split.bounded_sample(sensors(spark, sf), 500).select("id", "Fruit", "Temp", "y")


_NESTED = f"""WITH {_FOLDS}, tr AS (SELECT f.id, v.fold, row_number() OVER (PARTITION BY v.fold ORDER BY {_hash('learning', 'f.id')}, f.id) AS learning_rank
      FROM folded f JOIN (SELECT DISTINCT fold FROM folded) v ON f.fold <> v.fold)
    SELECT fold, step, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM tr JOIN (SELECT unnest(range(0, 8)) AS step) s
      ON learning_rank <= floor((0.1 + 0.9 * step / 7) * 0.8 * (SELECT count(*) FROM sensors)) GROUP BY ALL"""


@query("nested_train_sizes", _NESTED)
def _(spark, sf):
    folded = split.with_folds(sensors(spark, sf))
    train = folded.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("held <> fold").drop("fold").withColumnRenamed("held", "fold")
    rows = folded.count()
    ranked = split.with_learning_rank(train, ["fold"])
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(int((0.1 + 0.9 * i / 7) * 0.8 * rows)).alias("size")) for i in range(8)])
    return (
        ranked.select("id", "fold", "learning_rank", F.inline(steps)).where("learning_rank <= size")
        .groupBy("fold", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))
    )


# Metrics.

def _metric_sql(source: str, keys: str, extra: str = "") -> str:
    """All metrics by plain aggregates and windows over a predictions table."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    lead = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""conf AS (SELECT {keys}, CAST(count(*) FILTER (WHERE y = 1 AND y_pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y = 0 AND y_pred = 1) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE y = 0 AND y_pred = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y = 1 AND y_pred = 0) AS DOUBLE) AS fn,
        avg(-(CASE WHEN y = 1 THEN ln(least(greatest(y_proba, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(y_proba, 1e-15), 1 - 1e-15)) END)) FILTER (WHERE y_proba IS NOT NULL) AS log_loss,
        avg((y_proba - y) * (y_proba - y)) AS brier_score FROM {source} GROUP BY {keys}),
    rk AS (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY y_score) + (count(*) OVER (PARTITION BY {keys}, y_score) - 1) / 2.0 AS mid FROM {source}),
    au AS (SELECT {keys}, (sum(mid) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)) AS roc_auc FROM rk GROUP BY {keys}),
    ds AS (SELECT {keys}, y_score, sum(y) AS p, count(*) AS c FROM {source} GROUP BY {keys}, y_score),
    cu AS (SELECT *, sum(p) OVER w AS cp, sum(c) OVER w AS cc, sum(p) OVER (PARTITION BY {keys}) AS tp FROM ds WINDOW w AS (PARTITION BY {keys} ORDER BY y_score DESC)),
    ap AS (SELECT {keys}, sum(CAST(p AS DOUBLE) / tp * cp / cc) AS pr_auc FROM cu GROUP BY {keys}),
    m AS (SELECT {lead}, (tp + tn) / (tp + fp + tn + fn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
        CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, a.roc_auc, b.pr_auc,
        CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc,
        ((tp + tn) / (tp + fp + tn + fn) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / pow(tp + fp + tn + fn, 2)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / pow(tp + fp + tn + fn, 2)) AS cohen_kappa,
        log_loss, brier_score{extra} FROM conf c JOIN au a ON {on.replace('b.', 'c.')} JOIN ap b ON {on})"""


_METRICS = "accuracy balanced_accuracy precision recall f1 roc_auc pr_auc mcc cohen_kappa log_loss brier_score"


@query("metric_suite", f"WITH {SENSORS}, {scored()}, {_metric_sql('scored', 'model')} SELECT * FROM m", _METRICS)
def _(spark, sf):
    return compare.ranked_models(metrics.metric_suite(predictions(spark, sf)))


_FOLD_SCORED = f"{_FOLDS}, {scored('folded')}"


@query("metric_suite_by_fold", f"WITH {_FOLD_SCORED}, {_metric_sql('scored', 'model, fold')} SELECT * FROM m", _METRICS)
def _(spark, sf):
    return metrics.metric_suite(score_all(split.with_folds(sensors(spark, sf))), ["model", "fold"])


@query("metric_suite_by_fruit", f"WITH {SENSORS}, {scored()}, {_metric_sql('scored', 'model, Fruit')} SELECT * FROM m", _METRICS)
def _(spark, sf):
    return metrics.metric_suite(predictions(spark, sf), ["model", "Fruit"])


_DECISION = f"WITH {SENSORS}, {scored()}, {_metric_sql('scored', 'model', ', fn / (tp + fn) AS fnr, fp / (fp + tn) AS fpr')} SELECT model, f1, mcc, fnr, fpr FROM m"


@query("decision_metrics", _DECISION, "f1 mcc fnr fpr")
def _(spark, sf):
    return metrics.decision_metrics(predictions(spark, sf), ["model"])


@query(
    "confusion_matrix",
    f"""WITH {SENSORS}, {scored()} SELECT g.model, g.y, g.y_pred, count(s.id) AS n FROM (SELECT * FROM (SELECT DISTINCT model FROM scored), (SELECT unnest([0, 1]) AS y), (SELECT unnest([0, 1]) AS y_pred)) g
    LEFT JOIN scored s ON s.model = g.model AND s.y = g.y AND s.y_pred = g.y_pred GROUP BY ALL""",
)
def _(spark, sf):
    return curves.confusion_matrix(predictions(spark, sf))


_CUM = """ds AS (SELECT model, y_score, sum(y) AS p, count(*) - sum(y) AS q FROM scored GROUP BY ALL),
    cu AS (SELECT model, y_score, CAST(sum(p) OVER w AS DOUBLE) AS cp, CAST(sum(q) OVER w AS DOUBLE) AS cq, CAST(sum(p) OVER (PARTITION BY model) AS DOUBLE) AS tp, CAST(sum(q) OVER (PARTITION BY model) AS DOUBLE) AS tq
      FROM ds WINDOW w AS (PARTITION BY model ORDER BY y_score DESC))"""


@query(
    "roc_points",
    f"WITH {SENSORS}, {scored()}, {_CUM} SELECT model, y_score AS threshold, cq / tq AS fpr, cp / tp AS tpr FROM cu UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM cu",
    "threshold fpr tpr",
)
def _(spark, sf):
    return curves.roc_points(predictions(spark, sf))


@query(
    "pr_points",
    f"WITH {SENSORS}, {scored()}, {_CUM} SELECT model, y_score AS threshold, cp / tp AS recall, cp / (cp + cq) AS precision FROM cu UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM cu",
    "threshold recall precision",
)
def _(spark, sf):
    return curves.pr_points(predictions(spark, sf))


@query(
    "curve_areas",
    f"""WITH {SENSORS}, {scored()}, {_CUM}, pt AS (SELECT *, coalesce(lag(cp) OVER w, 0) AS lp, coalesce(lag(cq) OVER w, 0) AS lq FROM cu WINDOW w AS (PARTITION BY model ORDER BY y_score DESC))
    SELECT model, sum((cq - lq) / tq * (cp + lp) / tp / 2) AS roc_area, sum((cp - lp) / tp * (cp / (cp + cq) + CASE WHEN lp + lq = 0 THEN 1 ELSE lp / (lp + lq) END) / 2) AS pr_area,
      min(tp / (tp + tq)) AS base_rate FROM pt GROUP BY 1""",
    "roc_area pr_area base_rate",
)
def _(spark, sf):
    return curves.curve_areas(predictions(spark, sf))


_EDGES = ", ".join(f"quantile_cont(y_proba, {i / 10})" for i in range(1, 10))


@query(
    "calibration_points",
    f"""WITH {SENSORS}, {scored()}, pr AS (SELECT * FROM scored WHERE y_proba IS NOT NULL), e AS (SELECT model, [{_EDGES}] AS edges FROM pr GROUP BY 1)
    SELECT pr.model, CAST(len(list_filter(edges, lambda x: x < y_proba)) AS INT) AS bin, avg(y_proba) AS mean_probability, avg(CAST(y AS DOUBLE)) AS positive_share, count(*) AS n
    FROM pr JOIN e ON pr.model = e.model GROUP BY ALL""",
    "mean_probability positive_share",
)
def _(spark, sf):
    return curves.calibration_points(predictions(spark, sf))


# Significance.

_FOLD_F1 = f"{_FOLD_SCORED}, {_metric_sql('scored', 'model, fold')}, fs AS (SELECT fold, model, round(f1, 9) AS score FROM m)"


def _fold_f1(spark, sf):
    # Nine decimals, so that ties between folds' scores are the same on any engine.
    per_fold = metrics.decision_metrics(score_all(split.with_folds(sensors(spark, sf))), ["model", "fold"])
    return per_fold.select("fold", "model", F.round("f1", 9).alias("score"))


_T4 = "2.7764451051977987"


@query(
    "fold_summary",
    f"""WITH {_FOLD_SCORED}, {_metric_sql('scored', 'model, fold')}, l AS ({' UNION ALL '.join(f"SELECT model, '{c}' AS metric, {c} AS value FROM m" for c in _METRICS.split())}),
    s AS (SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM l GROUP BY ALL)
    SELECT model, metric, mean, std, mean - {_T4} * std / sqrt(n) AS ci_low, mean + {_T4} * std / sqrt(n) AS ci_high, n FROM s""",
    "mean std ci_low ci_high",
)
def _(spark, sf):
    per_fold = metrics.metric_suite(score_all(split.with_folds(sensors(spark, sf))), ["model", "fold"])
    return significance.fold_summary(per_fold, _METRICS.split())


@query(
    "cross_validation_view",
    f"""WITH {_FOLD_SCORED}, {_metric_sql('scored', 'model, fold')} SELECT model, {', '.join(f'avg({c}) AS {c}_mean' for c in _METRICS.split())}, stddev_samp(f1) AS f1_std,
      avg(f1) - {_T4} * stddev_samp(f1) / sqrt(5) AS f1_ci_low, avg(f1) + {_T4} * stddev_samp(f1) / sqrt(5) AS f1_ci_high FROM m GROUP BY 1""",
    " ".join(f"{c}_mean" for c in _METRICS.split()) + " f1_std f1_ci_low f1_ci_high",
)
def _(spark, sf):
    per_fold = metrics.metric_suite(score_all(split.with_folds(sensors(spark, sf))), ["model", "fold"])
    return compare.cross_validation_view(significance.fold_summary(per_fold, _METRICS.split()))


@query("score_matrix", f"WITH {_FOLD_F1} SELECT fold, {', '.join(f'max(score) FILTER (WHERE model = {chr(39)}{m}{chr(39)}) AS {m}' for m in MODELS)} FROM fs GROUP BY 1", " ".join(MODELS))
def _(spark, sf):
    return significance.score_matrix(_fold_f1(spark, sf), MODELS)


_RANKED = "rk2 AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY score DESC) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rank FROM fs)"


@query("fold_ranks", f"WITH {_FOLD_F1}, {_RANKED} SELECT fold, model, score, CAST(rank AS DOUBLE) AS rank FROM rk2", "score rank")
def _(spark, sf):
    return significance.fold_ranks(_fold_f1(spark, sf))


_K = len(MODELS)


@query(
    "friedman_test",
    f"""WITH {_FOLD_F1}, {_RANKED}, r AS (SELECT model, sum(rank) AS s FROM rk2 GROUP BY 1), t AS (SELECT count(*) AS t FROM fs GROUP BY fold, score),
    x AS (SELECT (12.0 / (5 * {_K} * {_K + 1}) * (SELECT sum(s * s) FROM r) - 3 * 5 * {_K + 1}) / (1 - (SELECT sum(t * t * t - t) FROM t) / (5.0 * {_K} * {_K * _K - 1})) AS statistic)
    SELECT CAST(statistic AS DOUBLE) AS statistic,
      exp(-statistic / 2) * (SELECT sum(pow(statistic / 2, g + 0.5) / gamma(g + 1.5)) FROM (SELECT unnest(range(0, 2)) AS g)) + tail AS p_value,
      exp(-statistic / 2) * (SELECT sum(pow(statistic / 2, g + 0.5) / gamma(g + 1.5)) FROM (SELECT unnest(range(0, 2)) AS g)) + tail < 0.05 AS significant,
      CAST({_K} AS BIGINT) AS n_models, CAST(5 AS BIGINT) AS n_folds
    FROM (SELECT statistic, 1 - exp(-statistic / 2) * (SELECT sum(pow(statistic / 2, j + 0.5) / gamma(j + 1.5)) FROM (SELECT unnest(range(0, 120)) AS j)) AS tail FROM x)""",
    "statistic p_value",
)
def _(spark, sf):
    return significance.friedman_test(_fold_f1(spark, sf))


@query("average_ranks", f"WITH {_FOLD_F1}, {_RANKED} SELECT model, avg(rank) AS avg_rank FROM rk2 GROUP BY 1", "avg_rank")
def _(spark, sf):
    return significance.average_ranks(_fold_f1(spark, sf))


_PAIR_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in combinations(MODELS, 2))
_CD = f"2.850 * sqrt({_K} * {_K + 1} / (6.0 * 5))"


@query(
    "nemenyi_pairs",
    f"""WITH {_FOLD_F1}, {_RANKED}, a AS (SELECT model, avg(rank) AS r FROM rk2 GROUP BY 1)
    SELECT p.model_a, p.model_b, abs(x.r - z.r) AS rank_diff, {_CD} AS critical_difference, abs(x.r - z.r) > {_CD} AS significant
    FROM (VALUES {_PAIR_ROWS}) p(model_a, model_b) JOIN a x ON x.model = p.model_a JOIN a z ON z.model = p.model_b""",
    "rank_diff critical_difference",
)
def _(spark, sf):
    return significance.nemenyi_pairs(_fold_f1(spark, sf), MODELS)


@query("rank_bars", f"WITH {_FOLD_F1}, {_RANKED}, a AS (SELECT model, avg(rank) AS avg_rank FROM rk2 GROUP BY 1) SELECT model, avg_rank, (SELECT min(avg_rank) FROM a) + {_CD} AS cut_off, avg_rank <= (SELECT min(avg_rank) FROM a) + {_CD} AS within_cut_off FROM a", "avg_rank cut_off")
def _(spark, sf):
    return significance.rank_bars(_fold_f1(spark, sf))


_WIDE = f"w AS (SELECT id, {', '.join(f'bool_or(y = y_pred) FILTER (WHERE model = {chr(39)}{m}{chr(39)}) AS {m}' for m in MODELS)} FROM scored GROUP BY id)"
_MCNEMAR = " UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) FILTER (WHERE {a} AND NOT {b}) AS b, count(*) FILTER (WHERE NOT {a} AND {b}) AS c FROM w" for a, b in combinations(MODELS, 2))
# Error function by its all-positive series: erf(z) = exp(-z^2) sum z^(2k+1) / gamma(k + 3/2).
_ERF = "exp(-x / 2) * list_sum(list_transform(range(0, 150), lambda k: exp((k + 0.5) * ln(greatest(x / 2, 1e-300)) - lgamma(k + 1.5))))"


@query(
    "mcnemar_pairwise",
    f"""WITH {SENSORS}, {scored()}, {_WIDE}, pr AS ({_MCNEMAR}), st AS (SELECT *, CASE WHEN b + c < 25 THEN CAST(least(b, c) AS DOUBLE) ELSE pow(abs(b - c) - 1.0, 2) / (b + c) END AS statistic FROM pr),
    pv AS (SELECT *, CASE WHEN b + c < 25 THEN least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(b, c) AS BIGINT) + 1), lambda i: gamma(b + c + 1.0) / (gamma(i + 1.0) * gamma(b + c - i + 1.0)))) / pow(2, b + c))
        WHEN statistic > 60 THEN 0.0 ELSE (SELECT 1 - {_ERF} FROM (SELECT statistic AS x)) END AS p_value FROM st)
    SELECT model_a, model_b, b, c, statistic, CAST(p_value AS DOUBLE) AS p_value, p_value < 0.05 AS significant FROM pv""",
    "statistic p_value",
)
def _(spark, sf):
    return significance.mcnemar_pairwise(predictions(spark, sf), MODELS)


# Errors.

_ERRORS = f"""{SENSORS}, {scored()}, err AS (SELECT id, Fruit, Temp, Humidity, Light, CO2, y AS y_true, y_pred, y_proba AS p_bad, y = y_pred AS correct,
    CASE WHEN y = 1 AND y_pred = 0 THEN 'false_negative' WHEN y = 0 AND y_pred = 1 THEN 'false_positive' ELSE 'correct' END AS error_type FROM scored WHERE model = 'S1')"""


def _errors(spark, sf):
    return errors.error_frame(sensors(spark, sf), predictions(spark, sf).where(F.col("model") == "S1"))


@query("error_frame", f"WITH {_ERRORS} SELECT id, error_type, correct, p_bad, y_true, y_pred FROM err", "p_bad")
def _(spark, sf):
    return _errors(spark, sf).select("id", "error_type", "correct", "p_bad", "y_true", "y_pred")


@query("errors_by_fruit", f"WITH {_ERRORS} SELECT Fruit, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS n_errors, count(*) FILTER (WHERE NOT correct) / count(*) AS error_rate FROM err GROUP BY 1", "error_rate")
def _(spark, sf):
    return errors.errors_by_group(_errors(spark, sf))


@query("error_feature_profile", f"WITH {_ERRORS}, {unpivoted('err', 'correct')} SELECT correct, feature, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY ALL", "mean std")
def _(spark, sf):
    return errors.error_feature_profile(_errors(spark, sf))


@query(
    "borderline_errors",
    f"""WITH {_ERRORS} SELECT count(*) AS n_errors, count(*) FILTER (WHERE p_bad BETWEEN 0.4 AND 0.6) AS n_borderline, 100.0 * count(*) FILTER (WHERE p_bad BETWEEN 0.4 AND 0.6) / count(*) AS pct_borderline,
      avg(abs(p_bad - 0.5)) + 0.5 AS mean_error_confidence FROM err WHERE NOT correct""",
    "pct_borderline mean_error_confidence",
)
def _(spark, sf):
    return errors.borderline(_errors(spark, sf))


@query("misclassified_samples", f"WITH {_ERRORS} SELECT id, Temp, Humidity, Light, CO2, Fruit, y_true, y_pred, error_type, p_bad FROM err WHERE NOT correct", "Temp Humidity Light CO2 p_bad")
def _(spark, sf):
    return errors.misclassified(_errors(spark, sf))


@query("error_type_counts", f"WITH {_ERRORS} SELECT error_type, count(*) AS n FROM err GROUP BY 1")
def _(spark, sf):
    return errors.error_type_counts(_errors(spark, sf))


@query(
    "error_probability_histogram",
    f"""WITH {_ERRORS}, b AS (SELECT min(p_bad) AS a, max(p_bad) AS z FROM err WHERE NOT correct), p AS (SELECT CAST(least(floor((p_bad - a) / ((z - a) / 20.0)), 19) AS INT) AS bin FROM err, b WHERE NOT correct)
    SELECT g.bin, min(a + g.bin * ((z - a) / 20.0)) AS low, min(a + (g.bin + 1) * ((z - a) / 20.0)) AS high, count(p.bin) AS n FROM (SELECT CAST(unnest(range(0, 20)) AS INT) AS bin, a, z FROM b) g LEFT JOIN p ON g.bin = p.bin GROUP BY g.bin""",
    "low high",
)
def _(spark, sf):
    return curves.histogram(errors.misclassified(_errors(spark, sf)), "p_bad", 20)


@query("best_and_worst_model", f"WITH {SENSORS}, {scored()}, {_metric_sql('scored', 'model')} SELECT (SELECT model FROM m ORDER BY f1 DESC, model LIMIT 1) AS best_model, (SELECT max(f1) FROM m) AS best_value, (SELECT model FROM m ORDER BY f1, model LIMIT 1) AS worst_model, (SELECT min(f1) FROM m) AS worst_value", "best_value worst_value")
def _(spark, sf):
    return compare.best_and_worst(metrics.metric_suite(predictions(spark, sf)))


@query("worst_errors", f"WITH {_ERRORS} SELECT id, Fruit, error_type, p_bad FROM err WHERE NOT correct ORDER BY abs(p_bad - y_true) DESC, id LIMIT 30", "p_bad")
def _(spark, sf):
    wrong = errors.misclassified(_errors(spark, sf))
    return compare.top_rows(wrong, 30, F.desc(F.abs(F.col("p_bad") - F.col("y_true"))), "id").select("id", "Fruit", "error_type", "p_bad")


@query("metric_bars", f"WITH {SENSORS}, {scored()}, {_metric_sql('scored', 'model')} SELECT model, mcc AS value FROM m WHERE model IN ('S1', 'S3', 'S6')", "value")
def _(spark, sf):
    results = metrics.metric_suite(predictions(spark, sf))
    shown = compare.known_models(predictions(spark, sf), ["S6", "S0", "S3", "S1"])
    return curves.sorted_series(results.where(F.col("model").isin(shown)), "model", "mcc")


_PAIR_CELLS = " UNION ALL ".join(f"SELECT id, \"Class\", '{a}' AS feature_x, '{b}' AS feature_y, {a} AS x, {b} AS y_value FROM pick" for a, b in combinations(SENSOR_NAMES, 2))


@query("pair_sample", f"WITH {SENSORS}, pick AS (SELECT * FROM sensors) {_PAIR_CELLS}", "x y_value")
def _(spark, sf):
    return curves.pair_points(sensors(spark, sf))


# Scenarios.

def _reading(sensor: str, shift: dict, sigma: dict, drift: dict, repeat: int) -> str:
    value = sensor
    if sensor in shift:
        value = f"({value} + {shift[sensor]})"
    if sensor in sigma:
        word = f"'{42 + repeat}'"
        value = f"({value} + {sigma[sensor]} * {duck_normal(word, chr(39) + sensor + chr(39), 'id')})"
    if sensor in drift:
        value = f"({value} + {drift[sensor]} * ramp)"
    if shift or sigma or drift:
        value = f"least({value}, 100)" if sensor == "Humidity" else f"greatest({value}, 0)" if sensor == "Light" else value
    return f"CAST({value} AS DOUBLE) AS {sensor}"


def _copies(listed: list[tuple[str, str, dict, dict, dict, int]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT id, Fruit, y, '{label}' AS scenario, '{category}' AS category, {repeat} AS repeat, {', '.join(_reading(s, shift, sigma, drift, repeat) for s in SENSOR_NAMES)} FROM {source}"
        for label, category, shift, sigma, drift, repeat in listed
    )


_SINGLE = [(k, "Single shift", v, {}, {}, 0) for k, v in SINGLE_SHIFTS.items()]
_NOISE = [(f"Gaussian noise x{lv:g}", "Noise level", {}, {s: v * lv for s, v in NOISE_SIGMA.items()}, {}, r) for lv in NOISE_LEVELS for r in range(NOISE_REPEATS)]
_COMBINED = [(k, "Combined shift", v, {}, {}, 0) for k, v in COMBINED_SHIFTS.items()]
_DRIFT = [(k, "Temporal drift", {}, {}, v, 0) for k, v in DRIFTS.items()]
_CLEAN = [("Clean", "Baseline", {}, {}, {}, 0)]
_BASIC = [*_CLEAN, *_SINGLE, ("Gaussian noise (all)", "Noise level", {}, NOISE_SIGMA, {}, 0)]
_EXTENDED = [*_CLEAN, *_SINGLE, *_NOISE, *_COMBINED, *_DRIFT]


def _scenario_cte(listed) -> str:
    return f"""{SENSORS}, ramped AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN 0.0 ELSE (row_number() OVER (ORDER BY id) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) END AS ramp FROM sensors),
    copies AS ({_copies(listed, 'ramped')}), {scored('copies')},
    cf AS (SELECT model, scenario, category, repeat, CAST(count(*) FILTER (WHERE y = 1 AND y_pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE y = 0 AND y_pred = 1) AS DOUBLE) AS fp,
      CAST(count(*) FILTER (WHERE y = 0 AND y_pred = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE y = 1 AND y_pred = 0) AS DOUBLE) AS fn FROM scored GROUP BY ALL),
    pr AS (SELECT model, scenario, category, 2 * tp / (2 * tp + fp + fn) AS f1, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc,
      fn / (tp + fn) AS fnr, fp / (fp + tn) AS fpr FROM cf),
    sc AS (SELECT model, scenario, category, avg(f1) AS f1, avg(mcc) AS mcc, avg(fnr) AS fnr, avg(fpr) AS fpr FROM pr GROUP BY ALL),
    dr AS (SELECT sc.*, c.f1 - sc.f1 AS f1_drop FROM sc JOIN sc c ON c.model = sc.model AND c.scenario = 'Clean')"""


@query("perturbed_readings", f"{_copies([*_CLEAN, *_SINGLE, *_COMBINED], 'sensors')}".join([f"WITH {SENSORS} SELECT id, scenario, Temp, Humidity, Light, CO2 FROM (", ")"]), "Temp Humidity Light CO2")
def _(spark, sf):
    listed = [scenarios.CLEAN, *scenarios.shift_scenarios(), *scenarios.combined_scenarios()]
    return scenarios.perturbed(sensors(spark, sf), listed).select("id", "scenario", *SENSOR_NAMES)


@query("noisy_readings", f"WITH {SENSORS} SELECT id, scenario, repeat, Temp, Humidity, Light, CO2 FROM ({_copies(_NOISE[:5], 'sensors')})", "Temp Humidity Light CO2")
def _(spark, sf):
    return scenarios.perturbed(sensors(spark, sf), scenarios.noise_scenarios([0.5])).select("id", "scenario", "repeat", *SENSOR_NAMES)


@query(
    "drifted_readings",
    f"""WITH {SENSORS}, ramped AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) AS ramp FROM sensors)
    SELECT id, scenario, Temp, Humidity, Light, CO2 FROM ({_copies(_DRIFT, 'ramped')})""",
    "Temp Humidity Light CO2",
)
def _(spark, sf):
    return scenarios.perturbed(sensors(spark, sf), scenarios.drift_scenarios()).select("id", "scenario", *SENSOR_NAMES)


@query("robustness", f"WITH {_scenario_cte(_BASIC)} SELECT model, scenario, f1, mcc, f1_drop FROM dr", "f1 mcc f1_drop")
def _(spark, sf):
    return scenarios.robustness(sensors(spark, sf), score_all)


@query("robustness_summary", f"WITH {_scenario_cte(_BASIC)} SELECT model, avg(f1) AS mean_f1, min(f1) AS worst_f1, avg(f1_drop) AS mean_f1_drop, max(f1_drop) AS max_f1_drop FROM dr WHERE scenario <> 'Clean' GROUP BY 1", "mean_f1 worst_f1 mean_f1_drop max_f1_drop")
def _(spark, sf):
    return scenarios.robustness_summary(scenarios.robustness(sensors(spark, sf), score_all))


@query("robustness_extended", f"WITH {_scenario_cte(_EXTENDED)} SELECT model, scenario, category, f1, mcc, fnr, fpr, f1_drop FROM dr", "f1 mcc fnr fpr f1_drop")
def _(spark, sf):
    return scenarios.robustness_extended(sensors(spark, sf), score_all)


@query("robustness_summary_extended", f"WITH {_scenario_cte(_EXTENDED)} SELECT model, avg(f1) AS mean_f1, min(f1) AS worst_f1, avg(f1_drop) AS mean_f1_drop, max(fnr) AS worst_fnr, max(fpr) AS worst_fpr FROM dr WHERE scenario <> 'Clean' GROUP BY 1", "mean_f1 worst_f1 mean_f1_drop worst_fnr worst_fpr")
def _(spark, sf):
    return scenarios.robustness_summary_extended(scenarios.robustness_extended(sensors(spark, sf), score_all))


_BASIC_LABELS = [row[0] for row in _BASIC]


@query("scenario_matrix", f"""WITH {_scenario_cte(_BASIC)} SELECT model, {', '.join(f'max(f1) FILTER (WHERE scenario = {chr(39)}{s}{chr(39)}) AS "{s}"' for s in _BASIC_LABELS)} FROM dr GROUP BY 1""", _BASIC_LABELS)
def _(spark, sf):
    return compare.scenario_matrix(scenarios.robustness(sensors(spark, sf), score_all), _BASIC_LABELS)


@query(
    "noise_curve",
    f"""WITH {_scenario_cte([*_CLEAN, *_NOISE])} SELECT model, CASE WHEN scenario = 'Clean' THEN CAST(0 AS DOUBLE) ELSE CAST(replace(scenario, 'Gaussian noise x', '') AS DOUBLE) END AS noise_level, f1, fnr, fpr FROM sc""",
    "noise_level f1 fnr fpr",
)
def _(spark, sf):
    return scenarios.noise_curve(sensors(spark, sf), score_all)


# Rules.

def _threshold_sql(cte: str, source: str) -> str:
    """Purest cut per group and sensor, then the sensor that reproduces the label best."""
    return f"""WITH {cte}, {unpivoted(source, 'Fruit, y')}, d AS (SELECT Fruit, feature, value, count(*) AS n, sum(y) AS p FROM long GROUP BY ALL),
    c AS (SELECT Fruit, feature, value, lead(value) OVER w AS nxt, CAST(sum(n) OVER w AS DOUBLE) AS ln, CAST(sum(p) OVER w AS DOUBLE) AS lp, CAST(sum(n) OVER g AS DOUBLE) AS tn, CAST(sum(p) OVER g AS DOUBLE) AS tp
      FROM d WINDOW w AS (PARTITION BY Fruit, feature ORDER BY value), g AS (PARTITION BY Fruit, feature)),
    i AS (SELECT *, (value + nxt) / 2.0 AS thr, round(2 * lp * (ln - lp) / ln + 2 * (tp - lp) * (tn - ln - tp + lp) / (tn - ln), 9) AS imp FROM c WHERE nxt > value + 1e-7),
    b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY Fruit, feature ORDER BY imp, thr) = 1),
    a AS (SELECT *, (greatest(lp, ln - lp) + greatest(tp - lp, tn - ln - tp + lp)) / tn AS acc, CASE WHEN (tp - lp) / (tn - ln) >= lp / ln THEN '>' ELSE '<=' END AS direction, list_position(['Temp', 'Humidity', 'Light', 'CO2'], feature) AS pos FROM b),
    f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY Fruit ORDER BY acc DESC, pos) = 1)
    SELECT Fruit, CAST(tn AS BIGINT) AS n, tp / tn AS bad_rate, feature AS split_feature, thr AS threshold, direction,
      concat(feature, ' ', direction, ' ', printf('%.1f', thr), ' ', CASE feature WHEN 'Temp' THEN '°C' WHEN 'Humidity' THEN '%' WHEN 'Light' THEN 'Lux' ELSE 'ppm' END) AS rule, acc AS accuracy FROM f"""


@query("threshold_rules", _threshold_sql(SENSORS, "sensors"), "bad_rate threshold accuracy")
def _(spark, sf):
    return rules.threshold_rules(sensors(spark, sf))


def _tree_sql(depth: int) -> str:
    """Greedy Gini tree per group, one set of CTEs per level."""
    parts = [SENSORS, "l0 AS (SELECT id, Fruit, y, Temp, Humidity, Light, CO2, CAST(1 AS BIGINT) AS node, true AS grew FROM sensors)"]
    for d in range(depth):
        parts += [
            f"o{d} AS (SELECT Fruit, node FROM l{d} WHERE grew GROUP BY ALL HAVING sum(y) > 0 AND sum(y) < count(*))",
            unpivoted(f"(SELECT l.* FROM l{d} l JOIN o{d} o ON l.Fruit = o.Fruit AND l.node = o.node)", "Fruit, node, y", f"u{d}"),
            f"d{d} AS (SELECT Fruit, node, feature, value, count(*) AS n, sum(y) AS p FROM u{d} GROUP BY ALL)",
            f"""c{d} AS (SELECT Fruit, node, feature, value, lead(value) OVER w AS nxt, CAST(sum(n) OVER w AS DOUBLE) AS ln, CAST(sum(p) OVER w AS DOUBLE) AS lp, CAST(sum(n) OVER g AS DOUBLE) AS tn, CAST(sum(p) OVER g AS DOUBLE) AS tp
              FROM d{d} WINDOW w AS (PARTITION BY Fruit, node, feature ORDER BY value), g AS (PARTITION BY Fruit, node, feature))""",
            f"""b{d} AS (SELECT Fruit, node, feature, (value + nxt) / 2.0 AS thr FROM c{d} WHERE nxt > value + 1e-7
              QUALIFY row_number() OVER (PARTITION BY Fruit, node ORDER BY round(2 * lp * (ln - lp) / ln + 2 * (tp - lp) * (tn - ln - tp + lp) / (tn - ln), 9), list_position(['Temp', 'Humidity', 'Light', 'CO2'], feature), (value + nxt) / 2.0) = 1)""",
            f"""l{d + 1} AS (SELECT l.id, l.Fruit, l.y, Temp, Humidity, Light, CO2, CASE WHEN b.feature IS NULL THEN l.node
                ELSE l.node * 2 + CASE WHEN (CASE b.feature WHEN 'Temp' THEN Temp WHEN 'Humidity' THEN Humidity WHEN 'Light' THEN Light ELSE CO2 END) > b.thr THEN 1 ELSE 0 END END AS node, b.feature IS NOT NULL AS grew
              FROM l{d} l LEFT JOIN b{d} b ON l.Fruit = b.Fruit AND l.node = b.node AND l.grew)""",
        ]
    parts.append(f"e AS (SELECT Fruit, node, count(*) AS n, greatest(sum(y), count(*) - sum(y)) AS hit FROM l{depth} GROUP BY ALL)")
    return f"WITH {', '.join(parts)} SELECT Fruit, CAST(sum(n) AS BIGINT) AS n, sum(hit) / sum(n) AS accuracy, count(*) AS leaves FROM e GROUP BY 1"


@query("tree_fidelity_by_group", _tree_sql(3), "accuracy")
def _(spark, sf):
    return rules.tree_fidelity_by_group(sensors(spark, sf))


@query("rule_fidelity")
def _(spark, sf):
    return rules.rule_fidelity(split.with_block_folds(sensors(spark, sf)))


_RULE_READINGS = f"""WITH {SENSORS}, tr AS (SELECT * FROM ({_threshold_sql(SENSORS, 'sensors')})),
    readings AS (SELECT s.Fruit, s.y, CASE split_feature WHEN 'Temp' THEN Temp WHEN 'Humidity' THEN Humidity WHEN 'Light' THEN Light ELSE CO2 END AS reading FROM sensors s JOIN tr ON s.Fruit = tr.Fruit)"""


@query("rule_histogram", _histogram(_RULE_READINGS, "readings", "Fruit, y", "reading", 30), "low high")
def _(spark, sf):
    rows = sensors(spark, sf)
    return rules.rule_histogram(rows, rules.threshold_rules(rows))


_TRAIN_LONG = unpivoted("seen", "", features=tuple(SENSOR_NAMES))


@query(
    "scaler_report",
    f"WITH {_SPLIT}, seen AS (SELECT * FROM parts WHERE split = 'train'), {_TRAIN_LONG} SELECT feature, avg(value) AS train_mean, stddev_pop(value) AS train_scale FROM long GROUP BY 1",
    "train_mean train_scale",
)
def _(spark, sf):
    return features.scaler_report(split.with_split(sensors(spark, sf)).where("split = 'train'"), SENSOR_NAMES)
