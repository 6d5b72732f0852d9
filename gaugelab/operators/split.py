"""Seeded, stratified partitions that come out the same on any cluster layout.

Rows are ordered inside each class by a hash of their id. A part is a range of
that order, so only the rows at its borders are looked up (see ``plans.order``)
and every row finds its part by comparing: the table itself is not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelab.fixed_values import CV_FOLDS, SEED, TEST_FRACTION
from gaugelab.functions.hashing import uniform
from gaugelab.plans.join import join_settled, settled
from gaugelab.plans.order import row_positions, values_at_ranks


def test_rows_per_class(df: DataFrame, y: str, fraction: float = TEST_FRACTION) -> DataFrame:
    """How many rows of each class go to the test part: (y, class_rows, n_test).

    The total is ceil(fraction * rows); classes share it in proportion, and the
    largest remainders get the rows left over.
    """
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("class_rows"))
    every = W.partitionBy(F.lit(0))  # one row per class
    rows = F.sum("class_rows").over(every)
    exact = F.ceil(rows * F.lit(fraction)) * F.col("class_rows") / rows
    shares = counts.select(y, "class_rows", F.ceil(rows * F.lit(fraction)).alias("want"), exact.alias("exact"))
    shares = shares.withColumns({"whole": F.floor("exact"), "rest": F.col("exact") - F.floor("exact")})
    order = every.orderBy(F.desc("rest"), y)
    extra = (F.row_number().over(order) <= F.col("want") - F.sum("whole").over(every)).cast("int")
    return shares.select(y, "class_rows", (F.col("whole") + extra).alias("n_test"))


def _with_cuts(df: DataFrame, keys: Sequence[str], order: str, tie: str, ranks: DataFrame, unit: bool) -> DataFrame:
    """Add ``_passed``: how many of the rows at the wanted ranks stand at or before this row."""
    places = values_at_ranks(df, keys, order, tie, ranks, unit)
    cuts = places.groupBy(*keys).agg(F.array_sort(F.collect_list("place")).alias("_cuts"))
    here = F.struct(F.col(order).alias("order"), F.col(tie).alias("tie"))
    passed = F.size(F.filter("_cuts", lambda cut: cut <= here))
    return join_settled(df, cuts, keys, "left").withColumn("_passed", F.coalesce(passed, F.lit(0))).drop("_cuts")


def with_split(df: DataFrame, y: str = "y", id_col: str = "id", fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """Add ``split`` = test for exactly the allotted rows of each class, else train.

    Only the hashed place of the first training row of each class is looked up;
    rows are then told apart by comparing, without being moved.
    """
    keyed = df.withColumn("_u", uniform(seed, F.lit("split"), id_col))
    share = settled(test_rows_per_class(df, y, fraction))
    ranks = share.select(y, F.lit(0).alias("slot"), F.col("n_test").cast("long").alias("rank"))
    return _with_cuts(keyed, [y], "_u", id_col, ranks, unit=True).withColumn("split", F.when(F.col("_passed") > 0, "train").otherwise("test")).drop("_u", "_passed")


def _block_starts(df: DataFrame, y: str, folds: int) -> DataFrame:
    """(y, slot, rank) of the first row of blocks 1..folds-1; block sizes differ by at most one."""
    sizes = settled(df.groupBy(y).agg(F.count(F.lit(1)).alias("n")))
    slots = F.explode(F.sequence(F.lit(1), F.lit(folds - 1)))
    return sizes.withColumn("slot", slots).select(y, "slot", F.ceil(F.col("slot") * F.col("n") / folds).cast("long").alias("rank"))


def with_folds(df: DataFrame, y: str = "y", id_col: str = "id", folds: int = CV_FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..folds-1: blocks of each class's hashed order, sizes differing by at most one."""
    keyed = df.drop("fold").withColumn("_u", uniform(seed, F.lit("fold"), id_col))
    return _with_cuts(keyed, [y], "_u", id_col, _block_starts(df, y, folds), unit=True).withColumnRenamed("_passed", "fold").drop("_u")


def with_block_folds(df: DataFrame, y: str = "y", order: str = "id", folds: int = CV_FOLDS) -> DataFrame:
    """Add ``fold`` without shuffling: contiguous blocks of each class in row order."""
    return _with_cuts(df.drop("fold"), [y], order, order, _block_starts(df, y, folds), unit=False).withColumnRenamed("_passed", "fold")


def first_rows(df: DataFrame, rows: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """Exactly the first ``rows`` rows of the hashed learning order (all, if there are fewer)."""
    keyed = df.withColumns({"_u": uniform(seed, F.lit("learning"), id_col), "_all": F.lit(0)})
    ranks = df.sparkSession.createDataFrame([(0, 0, rows)], "_all int, slot int, rank long")
    return _with_cuts(keyed, ["_all"], "_u", id_col, ranks, unit=True).where(F.col("_passed") == 0).drop("_u", "_all", "_passed")


def bounded_sample(df: DataFrame, rows: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """At most ``rows`` rows by smallest hash (a top-k, merged per task)."""
    return df.orderBy(uniform(seed, F.lit("sample"), id_col), id_col).limit(rows)


def with_learning_rank(df: DataFrame, keys: Sequence[str] = ("fold",), id_col: str = "id", seed: int = SEED) -> DataFrame:
    """Add ``learning_rank`` (1..n) per key in hashed order; sizes nest: rank <= size."""
    keyed = df.withColumn("_u", uniform(seed, F.lit("learning"), id_col))
    placed = row_positions(keyed, list(keys), "_u", [id_col], unit=True)
    return placed.withColumn("learning_rank", F.col("position") + 1).drop("_u", "position", "group_rows")


def split_sizes(df: DataFrame, y: str = "y", split: str = "split") -> DataFrame:
    return df.groupBy(F.col(split).alias("partition")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.col(y).cast("long")).alias("n_bad"), F.sum((1 - F.col(y)).cast("long")).alias("n_good")
    )
