"""How strongly each feature is tied to the label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelab.fixed_values import GROUP, LEAKAGE_FLAG, SEED, SENSORS
from gaugelab.functions.hashing import normal
from gaugelab.functions.scalars import digamma
from gaugelab.operators.profile import long_values, quantile_lookup
from gaugelab.plans.join import join_settled, settled
from gaugelab.plans.order import BUCKET, range_edges, values_at_quantiles, with_bucket


def quantile_bin(column: str, edges: Sequence[float]) -> Column:
    """Right-closed bin number for ascending edges; lowest value included, NULL stays NULL.

    Equal edges merge, as with ``duplicates="drop"``.
    """
    inner = sorted(set(edges))[1:-1]
    value = F.col(column)
    number = sum(((value > e).cast("int") for e in inner), F.lit(0))
    return F.when(value.isNotNull(), number)


def binned_features(df: DataFrame, target: str, features: Sequence[str] = SENSORS, groups: Sequence[str] = (GROUP,), bins: int = 4) -> DataFrame:
    """Long frame (feature, level, target): numeric features in quantile bins, categories as they are."""
    edges = quantile_lookup(df, features, [i / bins for i in range(bins + 1)])
    wide = df.select(
        target,
        *[quantile_bin(f, edges[f]).cast("string").alias(f) for f in features],
        *[F.col(g).cast("string").alias(g) for g in groups],
    )
    return wide.unpivot([target], [*features, *groups], "feature", "level").where(F.col("level").isNotNull())


def contingency(long: DataFrame, target: str) -> DataFrame:
    """Cells with their margins: (feature, level, target, n, row_n, col_n, total)."""
    # Used five times, computed once.
    cells = settled(long.groupBy("feature", "level", target).agg(F.count(F.lit(1)).alias("n")))
    by_level = cells.groupBy("feature", "level").agg(F.sum("n").alias("row_n"))
    by_class = cells.groupBy("feature", target).agg(F.sum("n").alias("col_n"))
    totals = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    return cells.join(by_level, ["feature", "level"]).join(by_class, ["feature", target]).join(totals, "feature")


def cramers_v(long: DataFrame, target: str) -> DataFrame:
    """Bias-corrected Cramer's V of each feature with the target: (feature, chi2, cramers_v).

    Empty cells need no rows: sum((o-e)^2/e) = sum(o^2/e) - n. A 2x2 table gets
    Yates' correction, where |o-e| is the same in all four cells and
    sum(1/e) = n * sum(1/row) * sum(1/col).
    """
    cells = contingency(long, target)
    expected = F.col("row_n").cast("double") * F.col("col_n") / F.col("total")
    summary = cells.groupBy("feature").agg(
        F.max("total").cast("double").alias("n"),
        (F.sum(F.col("n").cast("double") * F.col("n") / expected)).alias("ratio"),
        F.max(F.abs(F.col("n") - expected)).alias("gap"),
    )
    rows = (
        cells.groupBy("feature", "level").agg(F.max("row_n").alias("m"))
        .groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("r"), F.sum(1.0 / F.col("m")).alias("inv_rows"))
    )
    cols = (
        cells.groupBy("feature", target).agg(F.max("col_n").alias("m"))
        .groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum(1.0 / F.col("m")).alias("inv_cols"))
    )
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    yates_gap = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    chi2 = F.when((r == 2) & (k == 2), yates_gap * yates_gap * n * F.col("inv_rows") * F.col("inv_cols")).when((r == 1) | (k == 1), 0.0).otherwise(F.col("ratio") - n)
    phi2 = F.greatest(F.lit(0.0), F.try_divide(F.col("chi2"), n) - F.try_divide((k - 1) * (r - 1), n - 1))
    denominator = F.least(k - F.try_divide((k - 1) * (k - 1), n - 1) - 1, r - F.try_divide((r - 1) * (r - 1), n - 1) - 1)
    return (
        summary.join(rows, "feature").join(cols, "feature").withColumn("chi2", chi2)
        .select("feature", "chi2", F.when(denominator > 0, F.sqrt(phi2 / denominator)).alias("cramers_v"))
    )


def cramers_v_with_target(df: DataFrame, target: str, features: Sequence[str] = SENSORS, groups: Sequence[str] = (GROUP,), bins: int = 4) -> DataFrame:
    """Cramer's V of every feature, numeric ones in quantile bins first; strongest first."""
    return cramers_v(binned_features(df, target, features, groups, bins), target).orderBy(F.desc("cramers_v"), "feature")


def plugin_mutual_information(long: DataFrame, target: str) -> DataFrame:
    """Mutual information (nats) of categorical features from their counts."""
    cells = contingency(long, target)
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    term = n / total * F.log(n * total / (F.col("row_n").cast("double") * F.col("col_n")))
    return cells.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("mutual_information"))


def neighbour_mutual_information(
    df: DataFrame, target: str, features: Sequence[str] = SENSORS, id_col: str = "id", neighbours: int = 3, seed: int = SEED
) -> DataFrame:
    """Mutual information of numeric features by the nearest-neighbour estimator (Ross 2014).

    For a row of class c, r is the distance to its k-th neighbour of the same
    class (k capped by the class size - 1) and m the number of rows of any class
    strictly nearer than r, itself included. Then
    MI = psi(N) + mean psi(k) - mean psi(N_c) - mean psi(m), floored at 0.
    Values are scaled by their standard deviation and get a tiny hashed jitter.
    Classes with a single row are left out.

    In one dimension the k nearest of a row are among the k rows on either side
    in value order, so the radius needs one sort, and the counts need a second
    one over rows and interval ends together. No pair of rows is formed.
    """
    scaled = _scaled_with_jitter(df, target, features, id_col, seed)
    sizes = scaled.groupBy("feature", target).agg(F.count(F.lit(1)).alias("class_rows")).where("class_rows > 1")
    points = join_settled(scaled, sizes, ["feature", target])
    # Edges are literals, so the sketch needs only the numbers, not the jittered frame.
    edges = range_edges(points, "value")

    radii = _class_radii(points, target, id_col, neighbours, edges)
    # Each row marks its own place and both ends of its interval. In the order
    # (value, kind) the points before an upper end are those below it, and the
    # points before a lower end are those up to it.
    marks = radii.select(
        "feature",
        F.col(id_col).alias("row"),
        F.inline(
            F.array(
                F.struct(F.col("upper").alias("value"), F.lit(0).alias("kind")),
                F.struct(F.col("value"), F.lit(1).alias("kind")),
                F.struct(F.col("lower").alias("value"), F.lit(2).alias("kind")),
            )
        ),
    )
    in_order = W.partitionBy("feature", BUCKET).orderBy("value", "kind").rowsBetween(W.unboundedPreceding, 0)
    seen = with_bucket(marks, "value", edges).withColumn("local", F.sum((F.col("kind") == 1).cast("long")).over(in_order))
    counted = (
        join_settled(seen.where(F.col("kind") != 1), _points_before_bucket(points, edges), ["feature", BUCKET])
        .groupBy("feature", "row")
        .agg(F.sum((F.col("local") + F.col("earlier")) * (1 - F.col("kind"))).alias("inside"))
    )
    means = counted.groupBy("feature").agg(F.avg(digamma(F.greatest(F.col("inside"), F.lit(1)))).alias("psi_m"), F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(neighbours), F.col("class_rows") - 1)
    by_class = sizes.groupBy("feature").agg(
        (F.sum(F.col("class_rows") * digamma(k)) / F.sum("class_rows")).alias("psi_k"),
        (F.sum(F.col("class_rows") * digamma(F.col("class_rows"))) / F.sum("class_rows")).alias("psi_c"),
    )
    value = digamma(F.col("n")) + F.col("psi_k") - F.col("psi_c") - F.col("psi_m")
    return means.join(by_class, "feature").select("feature", F.greatest(F.lit(0.0), value).alias("mutual_information"))


def _scaled_with_jitter(df: DataFrame, target: str, features: Sequence[str], id_col: str, seed: int) -> DataFrame:
    """Long frame of scaled values; scale and jitter size come from one aggregate (2 numbers per feature)."""
    row = df.agg(
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in features],
        *[F.avg(F.abs(F.col(f).cast("double"))).alias(f"a_{f}") for f in features],
    ).first()
    scale = {f: (row[f"s_{f}"] or 1.0) for f in features}
    jitter = {f: 1e-10 * max(1.0, (row[f"a_{f}"] or 0.0) / scale[f]) for f in features}
    wide = df.select(
        id_col, target,
        *[(F.col(f).cast("double") / scale[f] + jitter[f] * normal(seed, F.lit(f), id_col)).alias(f) for f in features],
    )
    return long_values(wide, features, [id_col, target])


def _points_before_bucket(points: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Points in earlier buckets, for every bucket of every feature (a table of edges x features)."""
    counts = with_bucket(points, "value", edges).groupBy("feature", BUCKET).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("feature").distinct().withColumn(BUCKET, F.explode(F.sequence(F.lit(0), F.lit(len(edges)))))
    earlier = W.partitionBy("feature").orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    return grid.join(counts, ["feature", BUCKET], "left").select("feature", BUCKET, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))


def _class_radii(points: DataFrame, target: str, id_col: str, k: int, edges: Sequence[float]) -> DataFrame:
    """Per row the open interval (lower, upper) that reaches its k-th neighbour of the same class.

    Each bucket is sorted on its own; the k first and k last values of every
    bucket are lent to the buckets around it, so rows near an edge see all
    their neighbours even across thin buckets.
    """
    group = ["feature", target]
    bucketed = with_bucket(points, "value", edges)
    ordered = W.partitionBy(*group, BUCKET).orderBy("value", id_col)
    backward = W.partitionBy(*group, BUCKET).orderBy(F.desc("value"), F.desc(id_col))
    own = bucketed.select(*group, BUCKET, "value", id_col)
    heads = own.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)
    tails = own.withColumn("rank", F.row_number().over(backward)).where(F.col("rank") <= k)
    head_values = heads.groupBy(*group, BUCKET).agg(F.array_sort(F.collect_list("value")).alias("heads"))
    tail_values = tails.groupBy(*group, BUCKET).agg(F.array_sort(F.collect_list("value")).alias("tails"))
    # One row per bucket with at most k values each; k buckets on either side always suffice.
    chain = W.partitionBy(*group).orderBy(BUCKET)
    lent = (
        head_values.join(tail_values, [*group, BUCKET])
        .withColumn("after", F.slice(F.flatten(F.collect_list("heads").over(chain.rowsBetween(1, k))), 1, k))
        .withColumn("before", F.flatten(F.collect_list("tails").over(chain.rowsBetween(-k, -1))))
        .withColumn("before", F.slice("before", F.greatest(F.lit(1), F.size("before") - (k - 1)), k))
        .select(*group, BUCKET, "before", "after")
    )
    near = bucketed.withColumns(
        {
            "left": F.collect_list("value").over(ordered.rowsBetween(-k, -1)),
            "right": F.collect_list("value").over(ordered.rowsBetween(1, k)),
        }
    )
    near = join_settled(near, lent, [*group, BUCKET])
    x = F.col("value")
    left, right = F.concat("before", "left"), F.concat("right", "after")
    wanted = F.least(F.lit(k), F.col("class_rows") - 1).cast("int")
    candidates = F.array_sort(
        F.concat(
            F.transform(left, lambda v: F.struct((x - v).alias("gap"), v.alias("at"), F.lit(-1).alias("side"))),
            F.transform(right, lambda v: F.struct((v - x).alias("gap"), v.alias("at"), F.lit(1).alias("side"))),
        )
    )
    reach = F.element_at(candidates, wanted)
    staged = near.withColumn("reach", reach)
    radius, at, side = F.col("reach.gap"), F.col("reach.at"), F.col("reach.side")
    return staged.select(
        "feature", id_col, "value",
        F.when(side == -1, at).otherwise(x - radius).alias("lower"),
        F.when(side == 1, at).otherwise(x + radius).alias("upper"),
    )


def mutual_information(df: DataFrame, target: str, features: Sequence[str] = SENSORS, groups: Sequence[str] = (GROUP,), id_col: str = "id") -> DataFrame:
    """Mutual information of every feature: neighbours for numeric, counts for categorical."""
    long = df.select(target, *[F.col(g).cast("string").alias(g) for g in groups]).unpivot([target], list(groups), "feature", "level")
    return neighbour_mutual_information(df, target, features, id_col).unionByName(plugin_mutual_information(long, target)).orderBy(F.desc("mutual_information"), "feature")


def leakage_scan(df: DataFrame, y: str = "y", features: Sequence[str] = SENSORS, flag_at: float = LEAKAGE_FLAG) -> DataFrame:
    """Best accuracy of one cut per feature over the 1..99 % quantiles, either polarity.

    The lowest of the equally good cuts is reported. All cut accuracies come
    from the counts gathered while the quantiles are found.
    """
    long = long_values(df, features, [y])
    probabilities = [i / 100.0 for i in range(1, 100)]
    cuts = values_at_quantiles(long, ["feature"], "value", probabilities, {"pos": F.col(y)})
    at_high = F.col("quantile") >= F.col("high")
    below = F.when(at_high, F.col("upto_high_rows")).otherwise(F.col("upto_low_rows"))
    below_pos = F.when(at_high, F.col("upto_high_pos")).otherwise(F.col("upto_low_pos"))
    hits = (F.col("total_pos") - below_pos) + (below - below_pos)
    accuracy = hits / F.col("group_rows").cast("double")
    scored = cuts.select("feature", F.col("quantile").alias("threshold"), F.greatest(accuracy, 1.0 - accuracy).alias("accuracy"))
    best = scored.groupBy("feature").agg(F.max(F.struct("accuracy", (-F.col("threshold")).alias("minus"))).alias("best"))
    return best.select(
        "feature",
        F.col("best.accuracy").alias("best_single_split_acc"),
        (-F.col("best.minus")).alias("threshold"),
        F.when(F.bround("best.accuracy", 4) >= flag_at, "possible-leakage").otherwise("ok").alias("flag"),
    ).orderBy(F.desc("best_single_split_acc"), "feature")


def feature_relevance(information: DataFrame, association: DataFrame) -> DataFrame:
    """Mutual information and Cramer's V side by side."""
    return information.select("feature", "mutual_information").join(association.select("feature", "cramers_v"), "feature", "outer")
