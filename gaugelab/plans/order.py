"""Global order without a global window.

A window over a whole table, or over one hot group, sorts everything in a
single task. Here the order column is first cut into many value ranges
(buckets); each (group, bucket) is sorted on its own, and a small table of
bucket totals supplies the offset of every bucket. Bucket edges only decide how
evenly the work is spread; the results are exact for any edges, and a retried
task computes the same thing because edges are literals in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelab.plans.join import settled

BUCKET = "_bucket"

# Buckets of a hashed uniform when only a few of them will be sorted.
UNIT_BUCKETS = 65_536


def bucket_count(df: DataFrame) -> int:
    """Two buckets per shuffle partition, within limits the edge sketch handles well."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, min(8192, 2 * partitions))


def range_edges(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Inner edges that spread the values evenly (one sketch pass, bounded result)."""
    n = buckets or bucket_count(df)
    probabilities = [i / n for i in range(1, n)]
    edges = df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", probabilities, 1.0 / (2 * n))
    return sorted(set(edges))


def with_bucket(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Number of edges <= value, by binary search on the JVM."""
    if not edges:
        return df.withColumn(BUCKET, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    staged = df.withColumn("_bucket_input", F.col(value).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_bucket_input", outputCol="_bucket_found")
    # As an integer: shuffles by a double key normalise it first and cannot be shared.
    return cut.transform(staged).withColumn(BUCKET, F.col("_bucket_found").cast("int")).drop("_bucket_input", "_bucket_found")


def with_unit_bucket(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """Buckets for a hashed uniform: already evenly spread, so no sketch is needed."""
    n = buckets or bucket_count(df)
    return df.withColumn(BUCKET, F.floor(F.col(value) * float(n)).cast("int"))


def _offsets(bucketed: DataFrame, keys: list[str], totals: dict[str, Column], value: str | None) -> DataFrame:
    """Per (keys, bucket): sums in earlier buckets, sums of the group, first value of the next bucket."""
    aggregates = [c.alias(f"_in_{name}") for name, c in totals.items()]
    if value is not None:
        aggregates.append(F.min(value).alias("_first"))
    per_bucket = bucketed.groupBy(*keys, BUCKET).agg(*aggregates)
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    ordered = group.orderBy(BUCKET)
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    out = [*keys, BUCKET]
    for name in totals:
        out.append(F.coalesce(F.sum(f"_in_{name}").over(earlier), F.lit(0)).alias(f"_off_{name}"))
        out.append(F.sum(f"_in_{name}").over(group).alias(f"total_{name}"))
    if value is not None:
        out.append(F.lead("_first").over(ordered).alias("_next_bucket"))
    return per_bucket.select(*out)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column],
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """One row per (keys, distinct value), in ascending order of value within keys.

    For each name in ``sums`` (a per-row Column) the row carries ``name`` (sum at
    this value), ``before_name`` (sum at smaller values) and ``total_name`` (sum
    of the group), plus ``next_value``, the next larger value of the group.
    Equal values are combined before the shuffle, so a hot value costs one row
    per task.
    """
    keys = list(keys)
    df = df.where(F.col(value).isNotNull())
    edges = range_edges(df, value) if edges is None else edges
    distinct = df.groupBy(*keys, value).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    bucketed = with_bucket(distinct, value, edges)
    offsets = _offsets(bucketed, keys, {name: F.sum(name) for name in sums}, value)
    ordered = W.partitionBy(*keys, BUCKET).orderBy(value)
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    local = bucketed.withColumns(
        {f"_loc_{name}": F.coalesce(F.sum(name).over(earlier), F.lit(0)) for name in sums}
        | {"_next_local": F.lead(value).over(ordered)}
    )
    joined = local.join(offsets, [*keys, BUCKET])
    return joined.select(
        *keys,
        value,
        *sums,
        *[(F.col(f"_off_{name}") + F.col(f"_loc_{name}")).alias(f"before_{name}") for name in sums],
        *[f"total_{name}" for name in sums],
        F.coalesce("_next_local", "_next_bucket").alias("next_value"),
    )


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    unit: bool = False,
) -> DataFrame:
    """Add ``position`` (0-based rank in the group) and ``group_rows``.

    ``unit`` says that ``order`` is a hashed uniform, which needs no edge sketch.
    """
    keys = list(keys)
    bucketed = with_unit_bucket(df, order) if unit else with_bucket(df, order, range_edges(df, order))
    offsets = _offsets(bucketed, keys, {"rows": F.count(F.lit(1))}, None)
    ordered = W.partitionBy(*keys, BUCKET).orderBy(order, *ties)
    local = bucketed.withColumn("_local", F.row_number().over(ordered) - 1)
    joined = local.join(offsets, [*keys, BUCKET])
    return (
        joined.withColumn("position", F.col("_off_rows") + F.col("_local"))
        .withColumnRenamed("total_rows", "group_rows")
        .drop("_local", "_off_rows", BUCKET)
    )


def values_at_ranks(df: DataFrame, keys: Sequence[str], order: str, tie: str, ranks: DataFrame, unit: bool = False) -> DataFrame:
    """The rows at wanted ranks: (keys, slot, place), place being the struct (order, tie).

    ``ranks`` holds (keys, slot, rank), ranks counted from 0 in the order (order,
    tie). Rows are only counted per bucket; the few buckets that hold a wanted
    rank are sorted, the rest of the table is never shuffled.
    """
    keys = list(keys)
    narrow = df.select(*dict.fromkeys([*keys, order, tie]))
    bucketed = with_unit_bucket(narrow, order, UNIT_BUCKETS) if unit else with_bucket(narrow, order, range_edges(df, order))
    counts = bucketed.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_off", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    wanted = placed.join(ranks, keys).where((F.col("rank") >= F.col("_off")) & (F.col("rank") < F.col("_off") + F.col("_rows")))
    wanted = settled(wanted.select(*keys, BUCKET, "slot", (F.col("rank") - F.col("_off")).alias("_local")))
    kept = bucketed.join(wanted.select(*keys, BUCKET), [*keys, BUCKET], "left_semi")
    numbered = kept.withColumn("_local", (F.row_number().over(W.partitionBy(*keys, BUCKET).orderBy(order, tie)) - 1).cast("long"))
    return numbered.join(wanted, [*keys, BUCKET, "_local"]).select(*keys, "slot", F.struct(F.col(order).alias("order"), F.col(tie).alias("tie")).alias("place"))


def values_at_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    sums: dict[str, Column] | None = None,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per (keys, probability).

    Buckets are counted first; only buckets that hold a wanted rank are then
    grouped and sorted, so for a few quantiles almost no row is shuffled.
    Columns: ``low`` and ``high`` (the neighbouring values), ``quantile``,
    ``group_rows`` and, for each name in ``sums``, ``upto_low_name`` and
    ``upto_high_name`` (sums at values <= low / high) and ``total_name``.
    """
    keys = list(keys)
    sums = {"rows": F.lit(1), **(sums or {})}
    df = df.where(F.col(value).isNotNull())
    edges = range_edges(df, value) if edges is None else edges
    staged = df.select(*keys, value, *[c.alias(name) for name, c in sums.items()])
    bucketed = with_bucket(staged, value, edges)

    within = lambda r: (r >= F.col("_off_rows")) & (r < F.col("_off_rows") + F.col("_bucket_rows"))
    listed = ", ".join(f"CAST({float(p)!r} AS DOUBLE)" for p in probabilities)
    wanted = F.expr(f"transform(array({listed}), p -> named_struct('p', p, 'lo', floor(p * (total_rows - 1)), 'hi', ceil(p * (total_rows - 1))))")
    offsets = _offsets(bucketed, keys, {name: F.sum(name) for name in sums}, None)
    in_bucket = bucketed.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_bucket_rows"))
    # Each bucket is told which ranks to look for; buckets with none are dropped.
    hit_buckets = (
        offsets.join(in_bucket, [*keys, BUCKET])
        .withColumn("_wanted", F.filter(wanted, lambda w: within(w["lo"]) | within(w["hi"])))
        .where(F.size("_wanted") > 0)
        .drop("_bucket_rows")
    )
    # At most two buckets per group and probability; computed once, used twice.
    hit_buckets = settled(hit_buckets)

    kept = bucketed.join(hit_buckets.select(*keys, BUCKET), [*keys, BUCKET], "left_semi")
    distinct = kept.groupBy(*keys, BUCKET, value).agg(*[F.sum(name).alias(name) for name in sums])
    earlier = W.partitionBy(*keys, BUCKET).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    local = distinct.withColumns({f"_loc_{name}": F.sum(name).over(earlier) for name in sums})
    ranked = local.join(hit_buckets, [*keys, BUCKET]).withColumns(
        {f"_upto_{name}": F.col(f"_off_{name}") + F.col(f"_loc_{name}") for name in sums}
    )
    inside = lambda r: (r >= F.col("_upto_rows") - F.col("rows")) & (r < F.col("_upto_rows"))
    hits = ranked.withColumn("_hit", F.explode(F.filter("_wanted", lambda w: inside(w["lo"]) | inside(w["hi"]))))
    hits = hits.withColumn("probability", F.col("_hit.p"))
    is_low, is_high = inside(F.col("_hit.lo")), inside(F.col("_hit.hi"))
    picked = hits.groupBy(*keys, "probability").agg(
        F.max(F.when(is_low, F.col(value))).alias("low"),
        F.max(F.when(is_high, F.col(value))).alias("high"),
        F.max("total_rows").alias("group_rows"),
        *[F.max(F.when(is_low, F.col(f"_upto_{name}"))).alias(f"upto_low_{name}") for name in sums if name != "rows"],
        *[F.max(F.when(is_high, F.col(f"_upto_{name}"))).alias(f"upto_high_{name}") for name in sums if name != "rows"],
        F.max(F.when(is_low, F.col("_upto_rows"))).alias("upto_low_rows"),
        F.max(F.when(is_high, F.col("_upto_rows"))).alias("upto_high_rows"),
        *[F.max(f"total_{name}").alias(f"total_{name}") for name in sums if name != "rows"],
    )
    position = F.col("probability") * (F.col("group_rows") - 1)
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    return picked.withColumn("quantile", low + (high - low) * (position - F.floor(position)))
