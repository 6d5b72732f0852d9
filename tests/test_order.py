"""Global order by buckets: exact whatever the edges, the layout and the skew."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugelab.operators import split
from gaugelab.plans.join import join_settled
from gaugelab.plans.order import row_positions, running_totals, values_at_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group share one value."""
    rng = np.random.default_rng(1)
    n = 3000
    values = np.round(rng.lognormal(0, 2, n), 3)
    values[:1000] = 7.25
    groups = np.where(np.arange(n) < 1500, "hot", np.where(np.arange(n) % 2 == 0, "a", "b"))
    frame = pd.DataFrame({"id": np.arange(n), "g": groups, "v": values, "w": rng.integers(0, 5, n)})
    return frame, spark.createDataFrame(frame).repartition(7)


@pytest.mark.parametrize("edges", [None, [], [1.0], [0.5, 7.25, 7.25001, 50.0, 1e6]])
def test_running_totals(skewed, edges):
    frame, df = skewed
    got = running_totals(df, ["g"], "v", {"w": F.col("w")}, edges).toPandas().sort_values(["g", "v"]).reset_index(drop=True)
    want = frame.groupby(["g", "v"], as_index=False)["w"].sum()
    want["before_w"] = want.groupby("g")["w"].cumsum() - want["w"]
    want["next_value"] = want.groupby("g")["v"].shift(-1)
    want["total_w"] = want.groupby("g")["w"].transform("sum")
    pd.testing.assert_frame_equal(got[["g", "v", "w", "before_w", "total_w", "next_value"]], want[["g", "v", "w", "before_w", "total_w", "next_value"]], check_dtype=False)


@pytest.mark.parametrize("edges", [None, [], [7.25]])
def test_quantiles(skewed, edges):
    frame, df = skewed
    probabilities = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.77, 1.0]
    got = values_at_quantiles(df, ["g"], "v", probabilities, edges=edges).collect()
    assert len(got) == 3 * len(probabilities)
    for r in got:
        assert r.quantile == pytest.approx(np.quantile(frame.loc[frame.g == r.g, "v"], r.probability), rel=1e-12)


def test_quantiles_of_tiny_groups(spark):
    df = spark.createDataFrame([("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)], "g string, v double")
    got = {(r.g, r.probability): r.quantile for r in values_at_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {("one", 0.0): 3.0, ("one", 0.5): 3.0, ("one", 1.0): 3.0, ("two", 0.0): 1.0, ("two", 0.5): 1.5, ("two", 1.0): 2.0}


def test_row_positions(skewed):
    frame, df = skewed
    got = row_positions(df, ["g"], "v", ["id"]).toPandas()
    want = frame.sort_values(["g", "v", "id"]).copy()
    want["position"] = want.groupby("g").cumcount()
    merged = got.merge(want, on="id")
    assert (merged["position_x"] == merged["position_y"]).all()
    assert (got.groupby("g")["group_rows"].first() == frame.groupby("g").size()).all()


def test_splits_do_not_depend_on_layout(rows):
    one = split.with_folds(split.with_split(rows.coalesce(1))).select("id", "split", "fold").toPandas()
    many = split.with_folds(split.with_split(rows.repartition(16, "Temp"))).select("id", "split", "fold").toPandas()
    pd.testing.assert_frame_equal(one.sort_values("id").reset_index(drop=True), many.sort_values("id").reset_index(drop=True))


def test_folds_cover_and_balance(rows):
    counts = split.with_folds(rows).groupBy("y", "fold").count().toPandas()
    assert counts.groupby("y")["count"].agg(lambda c: c.max() - c.min()).max() <= 1
    assert counts["count"].sum() == rows.count()


def test_split_is_stratified(rows):
    parts = split.with_split(rows).groupBy("split", "y").count().toPandas()
    n = rows.count()
    assert parts.loc[parts.split == "test", "count"].sum() == -(-n // 5)


def test_first_rows_nest(rows):
    small = {r.id for r in split.first_rows(rows, 100).collect()}
    large = {r.id for r in split.first_rows(rows, 300).collect()}
    assert (len(small), len(large)) == (100, 300) and small <= large
    assert split.first_rows(rows, 10**6).count() == rows.count()


def test_block_folds_of_a_class_smaller_than_the_folds(spark):
    df = spark.createDataFrame([(i, 1 if i in (3, 8, 9) else 0) for i in range(20)], "id long, y int")
    got = split.with_block_folds(df).toPandas().sort_values("id")
    assert list(got.loc[got.y == 1, "fold"]) == [0, 1, 3]
    assert list(got.loc[got.y == 0, "fold"]) == [i * 5 // 17 for i in range(17)]


def test_settled_join_equals_plain_join(spark, rows):
    small = rows.groupBy("Fruit").agg(F.count(F.lit(1)).alias("n"))
    assert join_settled(rows, small, ["Fruit"]).agg(F.sum("n")).first()[0] == rows.join(small, "Fruit").agg(F.sum("n")).first()[0]
