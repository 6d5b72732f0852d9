"""Cleaning, profiling and association queries."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from gaugelab.catalog.base import GAUGES, RAW, SENSORS, duck_normal, query, unpivoted
from gaugelab.operators import association, cleaning, curves, features, profile
from gaugelab.plans.bindings import gauges, raw_readings, sensors
from gaugelab.plans.order import values_at_quantiles

FEATURES = ("Temp", "Humidity", "Light", "CO2")

VALUES = '"Fruit", Temp, Humidity, Light, CO2, "Class"'


@query("clean_readings", f'WITH {RAW} SELECT DISTINCT {VALUES} FROM named', "Temp")
def _(spark, sf):
    return cleaning.clean(raw_readings(spark, sf))


@query("header_repair", f'WITH {RAW} SELECT Fruit, Temp, Humidity, Light, CO2, label AS "Class", count(*) AS n FROM raw GROUP BY ALL', "Temp")
def _(spark, sf):
    named = cleaning.repair_headers(raw_readings(spark, sf))
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n"))


@query("label_normalise", f'WITH {RAW} SELECT "Class", count(*) AS n FROM named GROUP BY 1')
def _(spark, sf):
    return profile.value_counts(cleaning.normalise_labels(cleaning.repair_headers(raw_readings(spark, sf))), "Class")


@query("dedup_keep_first", f'WITH {SENSORS} SELECT Fruit, floor(Temp / 10) AS t, Humidity, "Class", min(id) AS id FROM sensors GROUP BY ALL', "t Humidity")
def _(spark, sf):
    rows = sensors(spark, sf).select("id", "Fruit", F.floor(F.col("Temp") / 10).cast("double").alias("t"), "Humidity", "Class")
    return cleaning.drop_exact_duplicates(rows, "id")


@query(
    "cleaning_report",
    f"""WITH {RAW}, kept AS (SELECT DISTINCT {VALUES} FROM named)
    SELECT 'raw_rows' AS section, '' AS label, count(*) AS n FROM named
    UNION ALL SELECT 'raw_columns', '', 6
    UNION ALL SELECT 'raw_class', "Class", count(*) FROM named GROUP BY ALL
    UNION ALL SELECT 'duplicates_removed', '', (SELECT count(*) FROM named) - (SELECT count(*) FROM kept)
    UNION ALL SELECT 'clean_rows', '', count(*) FROM kept
    UNION ALL SELECT 'class', "Class", count(*) FROM kept GROUP BY ALL
    UNION ALL SELECT 'fruit', Fruit, count(*) FROM kept GROUP BY ALL
    UNION ALL SELECT 'missing_values', '', 0""",
)
def _(spark, sf):
    return cleaning.cleaning_report(raw_readings(spark, sf))


@query(
    "duplicate_analysis",
    f"""WITH {RAW}, g AS (SELECT count(*) AS c FROM raw GROUP BY Fruit, Temp, Humidity, Light, CO2, label)
    SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c) - count(*) AS BIGINT) AS n_exact_duplicates,
      100.0 * (sum(c) - count(*)) / sum(c) AS pct_duplicates, count(*) AS n_unique FROM g""",
    "pct_duplicates",
)
def _(spark, sf):
    return cleaning.duplicate_analysis(cleaning.repair_headers(raw_readings(spark, sf)))


@query("features_and_target", f"WITH {SENSORS} SELECT id, Temp, Humidity, Light, CO2, Fruit, y FROM sensors", "Temp Humidity Light CO2")
def _(spark, sf):
    return cleaning.features_and_target(sensors(spark, sf))


@query("lenient_target", f"WITH {RAW} SELECT label, CASE WHEN lower(trim(label)) = 'bad' THEN 1 ELSE 0 END AS y, count(*) AS n FROM raw GROUP BY ALL")
def _(spark, sf):
    rows = cleaning.repair_headers(raw_readings(spark, sf)).select(F.col("Class").alias("label"), cleaning.lenient_target(F.col("Class")).alias("y"))
    return rows.groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"))


def _describe(source_cte: str, source: str) -> str:
    return f"""WITH {source_cte}, {unpivoted(source, "")}
    SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
      skewness(value) AS skew, kurtosis(value) AS kurtosis, var_samp(value) AS variance,
      quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM long GROUP BY feature"""


_DESCRIBED = "mean std min max skew kurtosis variance q25 q50 q75"


@query("descriptive_stats", _describe(SENSORS, "sensors"), _DESCRIBED)
def _(spark, sf):
    return profile.descriptive_stats(sensors(spark, sf))


@query("descriptive_stats_gauges", _describe(GAUGES, "gauges"), _DESCRIBED, digits=3)  # variances of prices reach 1e9: 3 decimals are 12 digits
def _(spark, sf):
    return profile.descriptive_stats(gauges(spark, sf))


_BY_CLASS = """SELECT "Class", feature, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM long GROUP BY ALL"""


@query("stats_by_class", f"""WITH {SENSORS}, {unpivoted('sensors', '"Class"')} {_BY_CLASS}""", "mean std min max")
def _(spark, sf):
    return profile.stats_by_class(sensors(spark, sf))


@query("stats_by_class_gauges", f"""WITH {GAUGES}, {unpivoted('gauges', '"Class"')} {_BY_CLASS}""", "mean std min max")
def _(spark, sf):
    return profile.stats_by_class(gauges(spark, sf))


def _correlations(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM {source}"
        if a != b
        else f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CAST(1 AS DOUBLE) AS r"
        for a in FEATURES
        for b in FEATURES
    )


@query("correlation_matrix", f"WITH {SENSORS} {_correlations('sensors')}", "r")
def _(spark, sf):
    return profile.correlation_matrix(sensors(spark, sf))


@query("correlation_matrix_gauges", f"WITH {GAUGES} {_correlations('gauges')}", "r")
def _(spark, sf):
    return profile.correlation_matrix(gauges(spark, sf))


@query("feature_variance", f"WITH {SENSORS}, {unpivoted('sensors', '')} SELECT feature, var_samp(value) AS variance FROM long GROUP BY 1", "variance")
def _(spark, sf):
    return profile.feature_variance(sensors(spark, sf))


def _determinant(names: list[str]) -> str:
    """Determinant of the correlation matrix of some features, written out over permutations."""
    if not names:
        return "1.0"
    terms = []
    for order in permutations(range(len(names))):
        sign = 1
        for i in range(len(order)):
            for j in range(i + 1, len(order)):
                sign = -sign if order[i] > order[j] else sign
        cells = [f"r_{names[i]}_{names[j]}" for i, j in enumerate(order)]
        terms.append(("+" if sign > 0 else "-") + " * ".join(cells))
    return f"({' '.join(terms)})"


_R_CELLS = ", ".join((f"corr({a}, {b}) AS r_{a}_{b}" if a != b else f"CAST(1 AS DOUBLE) AS r_{a}_{b}") for a in FEATURES for b in FEATURES)
_VIF = " UNION ALL ".join(f"SELECT '{f}' AS feature, {_determinant([g for g in FEATURES if g != f])} / {_determinant(list(FEATURES))} AS vif FROM r" for f in FEATURES)


@query("variance_inflation", f"WITH {SENSORS}, r AS (SELECT {_R_CELLS} FROM sensors) {_VIF}", "vif")
def _(spark, sf):
    return profile.variance_inflation(sensors(spark, sf))


def _outliers(cte: str, source: str) -> str:
    return f"""WITH {cte}, {unpivoted(source, "")},
    f AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1)
    SELECT l.feature, min(q1 - 1.5 * (q3 - q1)) AS lower_fence, min(q3 + 1.5 * (q3 - q1)) AS upper_fence,
      count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers,
      100.0 * count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*) AS pct_outliers
    FROM long l JOIN f ON l.feature = f.feature GROUP BY 1"""


@query("outlier_summary", _outliers(SENSORS, "sensors"), "lower_fence upper_fence pct_outliers")
def _(spark, sf):
    return profile.outlier_summary(sensors(spark, sf))


@query("outlier_summary_gauges", _outliers(GAUGES, "gauges"), "lower_fence upper_fence pct_outliers")
def _(spark, sf):
    return profile.outlier_summary(gauges(spark, sf))


@query(
    "class_imbalance",
    f"""WITH {SENSORS}, c AS (SELECT "Class", count(*) AS n FROM sensors GROUP BY 1)
    SELECT "Class", n, n / (SELECT sum(n) FROM c) AS proportion, (SELECT max(n) / min(n) FROM c) AS imbalance_ratio FROM c""",
    "proportion imbalance_ratio",
)
def _(spark, sf):
    return profile.class_imbalance(sensors(spark, sf))


@query("fruit_counts", f"WITH {SENSORS} SELECT Fruit, count(*) AS n FROM sensors GROUP BY 1")
def _(spark, sf):
    return profile.value_counts(sensors(spark, sf), "Fruit")


@query("crosstab_fruit_class", f'WITH {SENSORS} SELECT Fruit, "Class", count(*) AS n FROM sensors GROUP BY ALL')
def _(spark, sf):
    return profile.crosstab(sensors(spark, sf), "Fruit", "Class")


_PROBS = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
_QUANTILE_ROWS = " UNION ALL ".join(f"SELECT Fruit, feature, CAST({p} AS DOUBLE) AS probability, quantile_cont(value, {p}) AS quantile FROM long GROUP BY ALL" for p in _PROBS)


@query("quantiles_by_group", f"WITH {SENSORS}, {unpivoted('sensors', 'Fruit')} {_QUANTILE_ROWS}", "probability quantile")
def _(spark, sf):
    return profile.quantiles(sensors(spark, sf), FEATURES, _PROBS, ["Fruit"]).select("Fruit", "feature", "probability", "quantile")


@query("quantiles_price", "SELECT " + " UNION ALL SELECT ".join(f"CAST({p} AS DOUBLE) AS probability, quantile_cont(l_extendedprice, {p}) AS quantile FROM lineitem" for p in _PROBS), "probability quantile")
def _(spark, sf):
    prices = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_extendedprice").alias("value"))
    return values_at_quantiles(prices, [], "value", _PROBS).select("probability", "quantile")


def _binned(cte: str, source: str, target: str) -> str:
    """Long frame of quartile bins; equal edges merge."""
    numeric = " UNION ALL ".join(
        f"""SELECT {target}, '{f}' AS feature, CAST(CAST({f} > q1 AS INT) + CASE WHEN q2 > q1 THEN CAST({f} > q2 AS INT) ELSE 0 END
          + CASE WHEN q3 > q2 THEN CAST({f} > q3 AS INT) ELSE 0 END AS VARCHAR) AS level
        FROM {source}, (SELECT quantile_cont({f}, 0.25) AS q1, quantile_cont({f}, 0.5) AS q2, quantile_cont({f}, 0.75) AS q3 FROM {source})"""
        for f in FEATURES
    )
    return f"{cte}, binned AS ({numeric} UNION ALL SELECT {target}, 'Fruit', Fruit FROM {source})"


def _contingency(target: str) -> str:
    return f"""cells AS (SELECT feature, level, {target}, count(*) AS o FROM binned GROUP BY ALL),
    t AS (SELECT feature, sum(o) AS n, count(DISTINCT level) AS r, count(DISTINCT {target}) AS k FROM cells GROUP BY 1),
    rt AS (SELECT feature, level, sum(o) AS rn FROM cells GROUP BY ALL),
    ct AS (SELECT feature, {target}, sum(o) AS cn FROM cells GROUP BY ALL),
    grid AS (SELECT rt.feature, rt.level, ct.{target}, rt.rn, ct.cn, t.n, t.r, t.k, coalesce(cells.o, 0) AS o,
        CAST(rt.rn AS DOUBLE) * ct.cn / t.n AS e
      FROM rt JOIN ct ON rt.feature = ct.feature JOIN t ON t.feature = rt.feature
      LEFT JOIN cells ON cells.feature = rt.feature AND cells.level = rt.level AND cells.{target} = ct.{target})"""


_CRAMER = f"""chi AS (SELECT feature, min(n) AS n, min(r) AS r, min(k) AS k,
      sum(CASE WHEN r = 2 AND k = 2 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE power(o - e, 2) / e END) AS chi2 FROM grid GROUP BY 1),
    v AS (SELECT *, greatest(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) AS phi,
      least(k - power(k - 1, 2) / (n - 1) - 1, r - power(r - 1, 2) / (n - 1) - 1) AS den FROM chi)
    SELECT feature, CAST(chi2 AS DOUBLE) AS chi2, CASE WHEN den > 0 THEN sqrt(phi / den) END AS cramers_v FROM v"""


@query("cramers_v", f"""WITH {_binned(SENSORS, 'sensors', '"Class"')}, {_contingency('"Class"')}, {_CRAMER}""", "chi2 cramers_v")
def _(spark, sf):
    return association.cramers_v_with_target(sensors(spark, sf), "Class")


@query("cramers_v_gauges", f"""WITH {_binned(GAUGES, 'gauges', '"Class"')}, {_contingency('"Class"')}, {_CRAMER}""", "chi2 cramers_v")
def _(spark, sf):
    return association.cramers_v_with_target(gauges(spark, sf), "Class")


_TWO_BY_TWO = f"""WITH {SENSORS}, binned AS (SELECT "Class", 'warm' AS feature, CASE WHEN Temp > 30 THEN 'yes' ELSE 'no' END AS level FROM sensors
    UNION ALL SELECT "Class", 'rule', CASE WHEN Fruit = 'view' AND Temp > 40 THEN 'yes' ELSE 'no' END FROM sensors)"""


@query("cramers_v_two_by_two", f"""{_TWO_BY_TWO}, {_contingency('"Class"')}, {_CRAMER}""", "chi2 cramers_v")
def _(spark, sf):
    flags = sensors(spark, sf).select(
        "Class",
        F.when(F.col("Temp") > 30, "yes").otherwise("no").alias("warm"),
        F.when((F.col("Fruit") == "view") & (F.col("Temp") > 40), "yes").otherwise("no").alias("rule"),
    )
    return association.cramers_v(flags.unpivot(["Class"], ["warm", "rule"], "feature", "level"), "Class")


_PLUGIN = """SELECT feature, greatest(0.0, sum(CASE WHEN o > 0 THEN CAST(o AS DOUBLE) / n * ln(CAST(o AS DOUBLE) * n / (CAST(rn AS DOUBLE) * cn)) ELSE 0 END)) AS mutual_information FROM grid GROUP BY 1"""


@query("mutual_information_binned", f"""WITH {_binned(SENSORS, 'sensors', '"Class"')}, {_contingency('"Class"')} {_PLUGIN}""", "mutual_information")
def _(spark, sf):
    return association.plugin_mutual_information(association.binned_features(sensors(spark, sf), "Class"), "Class")


def _digamma(x: str) -> str:
    z = f"(({x}) + 6.0)"
    shift = " + ".join(f"CAST(1 AS DOUBLE) / (({x}) + {i})" for i in range(6))
    return f"(ln({z}) - 0.5 / {z} - 1.0 / (12.0 * pow({z}, 2)) + 1.0 / (120.0 * pow({z}, 4)) - 1.0 / (252.0 * pow({z}, 6)) + 1.0 / (240.0 * pow({z}, 8)) - ({shift}))"


def _neighbour_information(cte: str, source: str, target: str) -> str:
    """Nearest-neighbour estimator by sorting: neighbours by lag/lead, counts by as-of lookups."""
    scaled = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, id, {target} AS c, {f} / s + 1e-10 * greatest(1.0, a / s) * {duck_normal("'42'", f"'{f}'", "id")} AS x
        FROM {source}, (SELECT stddev_pop({f}) AS s, avg(abs({f})) AS a FROM {source})"""
        for f in FEATURES
    )
    near = ", ".join([f"struct_pack(gap := x - lag(x, {i}) OVER w, at := lag(x, {i}) OVER w, side := -1)" for i in (1, 2, 3)] + [f"struct_pack(gap := lead(x, {i}) OVER w - x, at := lead(x, {i}) OVER w, side := 1)" for i in (1, 2, 3)])
    return f"""{cte}, pts AS ({scaled}),
    cand AS (SELECT feature, id, c, x, count(*) OVER (PARTITION BY feature, c) AS nc,
        list_sort(list_filter([{near}], lambda e: e.gap IS NOT NULL)) AS near FROM pts WINDOW w AS (PARTITION BY feature, c ORDER BY x, id)),
    rad AS (SELECT feature, id, c, nc, x, near[CAST(least(3, nc - 1) AS BIGINT)] AS r FROM cand WHERE nc > 1),
    ends AS (SELECT feature, id, nc, CASE WHEN r.side = -1 THEN r.at ELSE x - r.gap END AS lo, CASE WHEN r.side = 1 THEN r.at ELSE x + r.gap END AS hi FROM rad),
    cum AS (SELECT feature, x, max(rn) AS upto FROM (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS rn FROM pts) GROUP BY ALL),
    m AS (SELECT e.feature, e.id, e.nc, coalesce(h.upto, 0) - coalesce(l.upto, 0) AS m FROM ends e
        ASOF LEFT JOIN cum h ON e.feature = h.feature AND e.hi > h.x
        ASOF LEFT JOIN cum l ON e.feature = l.feature AND e.lo >= l.x)
    SELECT feature, greatest(0.0, {_digamma("CAST(count(*) AS DOUBLE)")} + avg({_digamma("CAST(least(3, nc - 1) AS DOUBLE)")}) - avg({_digamma("CAST(nc AS DOUBLE)")})
        - avg({_digamma("CAST(greatest(m, 1) AS DOUBLE)")})) AS mutual_information FROM m GROUP BY 1"""


_PLUGIN_FRUIT = f"""SELECT 'Fruit' AS feature, greatest(0.0, sum(CAST(o AS DOUBLE) / n * ln(CAST(o AS DOUBLE) * n / (CAST(rn AS DOUBLE) * cn)))) AS mutual_information FROM
    (SELECT Fruit, y, count(*) AS o, sum(count(*)) OVER () AS n, sum(count(*)) OVER (PARTITION BY Fruit) AS rn, sum(count(*)) OVER (PARTITION BY y) AS cn FROM sensors GROUP BY Fruit, y)"""


@query("mutual_information", f"WITH {_neighbour_information(SENSORS, 'sensors', 'y')} UNION ALL {_PLUGIN_FRUIT}", "mutual_information")
def _(spark, sf):
    return association.mutual_information(sensors(spark, sf), "y")


@query(
    "feature_relevance",
    f"""WITH mi AS (SELECT * FROM (WITH {_neighbour_information(SENSORS, 'sensors', 'y')} UNION ALL {_PLUGIN_FRUIT})),
    cv AS (SELECT * FROM (WITH {_binned(SENSORS, 'sensors', '"Class"')}, {_contingency('"Class"')}, {_CRAMER}))
    SELECT coalesce(mi.feature, cv.feature) AS feature, mutual_information, cramers_v FROM mi FULL JOIN cv ON mi.feature = cv.feature""",
    "mutual_information cramers_v",
)
def _(spark, sf):
    rows = sensors(spark, sf)
    return association.feature_relevance(association.mutual_information(rows, "y"), association.cramers_v(association.binned_features(rows, "Class"), "Class"))


def _leakage(cte: str, source: str, y: str) -> str:
    one = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, thr, max(greatest(acc, 1 - acc)) AS acc FROM (
            SELECT thr, avg(CASE WHEN (x > thr) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE 0.0 END) AS acc
            FROM (SELECT {f} AS x, {y} AS y FROM {source}), (SELECT DISTINCT unnest(quantile_cont({f}, {[i / 100 for i in range(1, 100)]})) AS thr FROM {source}) GROUP BY thr) GROUP BY ALL"""
        for f in FEATURES
    )
    return f"""WITH {cte}, a AS ({one}), b AS (SELECT feature, acc, thr, row_number() OVER (PARTITION BY feature ORDER BY round(acc, 12) DESC, thr) AS k FROM a)
    SELECT feature, acc AS best_single_split_acc, thr AS threshold, CASE WHEN round_even(acc, 4) >= 0.98 THEN 'possible-leakage' ELSE 'ok' END AS flag FROM b WHERE k = 1"""


@query("leakage_scan", _leakage(SENSORS, "sensors", "y"), "best_single_split_acc threshold")
def _(spark, sf):
    return association.leakage_scan(sensors(spark, sf))


@query("leakage_scan_gauges", _leakage(GAUGES, "gauges", """(CASE WHEN "Class" = 'Bad' THEN 1 ELSE 0 END)"""), "best_single_split_acc threshold")
def _(spark, sf):
    rows = gauges(spark, sf)
    return association.leakage_scan(rows.withColumn("y", cleaning.encoded_target(F.col("Class"))))


@query(
    "category_codes",
    f"WITH {SENSORS}, l AS (SELECT Fruit, dense_rank() OVER (ORDER BY Fruit) - 1 AS code FROM (SELECT DISTINCT Fruit FROM sensors)) SELECT s.id, s.Fruit, CAST(l.code AS INT) AS Fruit_code FROM sensors s JOIN l ON s.Fruit = l.Fruit",
)
def _(spark, sf):
    return features.category_codes(sensors(spark, sf).select("id", "Fruit"), "Fruit")


@query(
    "quartile_bins",
    f"""WITH {_binned(SENSORS, 'sensors', '"Class"')} SELECT feature, level, "Class", count(*) AS n FROM binned GROUP BY ALL""",
)
def _(spark, sf):
    binned = association.binned_features(sensors(spark, sf), "Class")
    return binned.groupBy("feature", "level", "Class").agg(F.count(F.lit(1)).alias("n"))


_BOX = f"""WITH {SENSORS}, {unpivoted('sensors', '"Class"')},
    q AS (SELECT "Class", feature, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM long GROUP BY ALL)
    SELECT q."Class", q.feature, q25, q50, q75,
      min(value) FILTER (WHERE value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
      max(value) FILTER (WHERE value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
      count(*) FILTER (WHERE NOT (value BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))) AS n_fliers
    FROM long l JOIN q ON l.feature = q.feature AND l."Class" = q."Class" GROUP BY ALL"""


@query("box_summary", _BOX, "q25 q50 q75 whisker_low whisker_high")
def _(spark, sf):
    return curves.box_summary(sensors(spark, sf))


def _density(cut: float, points: int, shared: bool) -> str:
    span = f"min(lo - {cut} * h) OVER (PARTITION BY feature) AS a, max(hi + {cut} * h) OVER (PARTITION BY feature) AS b" if shared else f"lo - {cut} * h AS a, hi + {cut} * h AS b"
    return f"""WITH {SENSORS}, {unpivoted('sensors', '"Class"')},
    s0 AS (SELECT "Class", feature, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi FROM long GROUP BY ALL),
    s AS (SELECT "Class", feature, n, h, {span} FROM s0),
    d AS (SELECT "Class", feature, value, count(*) AS w FROM long GROUP BY ALL),
    g AS (SELECT "Class", feature, n, h, CAST(unnest(range(0, {points})) AS INT) AS grid_point, a, b FROM s)
    SELECT g."Class", g.feature, g.grid_point, min(a + (b - a) * grid_point / {points - 1}.0) AS x,
      sum(w * exp(-0.5 * pow((a + (b - a) * grid_point / {points - 1}.0 - value) / h, 2)) / (n * h * sqrt(2.0 * pi()))) AS density
    FROM g JOIN d ON g.feature = d.feature AND g."Class" = d."Class" GROUP BY ALL"""


@query("density_by_class", _density(3.0, 200, True), "x density")
def _(spark, sf):
    return curves.density(sensors(spark, sf))


@query("violin_by_class", _density(0.0, 200, False), "x density")
def _(spark, sf):
    return curves.density(sensors(spark, sf), cut=0.0, keys_share_grid=False)


def _histogram(cte: str, source: str, keys: str, value: str, bins: int) -> str:
    """Equal-width bins over each group's range on the full grid."""
    on = " AND ".join(f"v.{k} = e.{k}" for k in keys.split(", "))
    return f"""{cte}, v AS (SELECT {keys}, {value} AS value FROM {source} WHERE {value} IS NOT NULL),
    e AS (SELECT {keys}, min(value) AS a, max(value) AS b FROM v GROUP BY ALL),
    p AS (SELECT {', '.join('v.' + k for k in keys.split(', '))}, CAST(least(floor((value - a) / ((b - a) / {bins}.0)), {bins - 1}) AS INT) AS bin FROM v JOIN e ON {on}),
    g AS (SELECT {keys}, a, b, CAST(unnest(range(0, {bins})) AS INT) AS bin FROM e)
    SELECT {', '.join('g.' + k for k in keys.split(', '))}, g.bin, min(a + g.bin * ((b - a) / {bins}.0)) AS low, min(a + (g.bin + 1) * ((b - a) / {bins}.0)) AS high, count(p.bin) AS n
    FROM g LEFT JOIN p ON {' AND '.join(f'g.{k} = p.{k}' for k in keys.split(', '))} AND g.bin = p.bin GROUP BY {', '.join('g.' + k for k in keys.split(', '))}, g.bin"""


@query("histogram_light", f"WITH {_histogram(SENSORS, 'sensors', 'Fruit, y', 'Light', 30)}", "low high")
def _(spark, sf):
    return curves.histogram(sensors(spark, sf), "Light", 30, ["Fruit", "y"])


_GAPS = f"""{SENSORS}, gaps AS (SELECT id, y, CASE WHEN id % 17 = 0 THEN NULL ELSE Temp END AS Temp, Humidity, Light, CO2,
    CASE WHEN id % 19 = 0 THEN NULL ELSE Fruit END AS Fruit FROM sensors)"""
_PREPARED = f"""WITH {_GAPS}, med AS (SELECT quantile_cont(Temp, 0.5) AS mt FROM gaps),
    mode AS (SELECT Fruit AS mf FROM gaps WHERE Fruit IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, Fruit LIMIT 1),
    filled AS (SELECT id, coalesce(Temp, mt) AS Temp, Humidity, Light, CO2, coalesce(Fruit, mf) AS Fruit FROM gaps, med, mode),
    st AS (SELECT {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in FEATURES)} FROM filled)
    SELECT id, {', '.join(f'({f} - m_{f}) / s_{f} AS num__{f}' for f in FEATURES)},
      {', '.join(f"CASE WHEN Fruit = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS cat__Fruit_{v}" for v in ('click', 'error', 'purchase', 'signup', 'view'))}
    FROM filled, st"""


@query("prepared_features", _PREPARED, " ".join(f"num__{f}" for f in FEATURES))
def _(spark, sf):
    rows = sensors(spark, sf).select(
        "id", F.when(F.col("id") % 17 != 0, F.col("Temp")).alias("Temp"), "Humidity", "Light", "CO2", F.when(F.col("id") % 19 != 0, F.col("Fruit")).alias("Fruit")
    )
    made = features.fit_preparation(rows, [*FEATURES, "Fruit"])
    return rows.select("id", *made.columns())
