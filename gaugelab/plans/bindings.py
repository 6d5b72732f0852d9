"""Sensor tables and fixed scorers derived from the given tables."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# A table of at most this size may be dealt out anew; a larger one never is.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a small table out by key, as a file with one row group would keep a single core busy.

    Moves at most ``SPREAD_BYTES``; the rows are the same either way.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if size <= SPREAD_BYTES else df


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as sensor rows: a threshold rule per group labels them, with ~4 % of labels flipped."""
    columns = ["event_id", "event_type", "value", "props", "user_id", "ts"]
    events = spread(table(spark, sf_dir, "events").select(*columns), "event_id")
    ts = F.col("ts")
    base = events.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("Fruit"),
        F.col("value").alias("Temp"),
        F.get_json_object("props", "$.k").cast("double").alias("Humidity"),
        F.col("user_id").cast("double").alias("Light"),
        (F.hour(ts) * 60 + F.minute(ts)).cast("double").alias("CO2"),
    )
    rule = (
        F.when(F.col("Fruit") == "view", F.col("Temp") > 40)
        .when(F.col("Fruit") == "click", F.col("Humidity") > 50)
        .when(F.col("Fruit") == "error", F.col("Light") <= 60)
        .when(F.col("Fruit") == "signup", F.col("CO2") > 720)
        .otherwise((F.col("Temp") > 30) & (F.col("Humidity") <= 70))
    )
    y = F.when(rule != (F.col("id") % 23 == 0), 1).otherwise(0)
    return base.withColumn("y", y).withColumn("Class", F.when(F.col("y") == 1, "Bad").otherwise("Good"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read as sensor rows: the larger table, for profiles."""
    columns = ["l_orderkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"]
    return spread(table(spark, sf_dir, "lineitem").select(*columns), "l_orderkey").select(
        F.col("l_quantity").alias("Temp"),
        (F.lit(100.0) * F.col("l_discount")).alias("Humidity"),
        F.col("l_extendedprice").alias("Light"),
        (F.lit(100.0) * F.col("l_tax")).alias("CO2"),
        F.col("l_returnflag").alias("Fruit"),
        F.when(F.col("l_linestatus") == "O", "Bad").otherwise("Good").alias("Class"),
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dirty frame with malformed headers, mixed label spellings and many exact duplicates."""
    rows = sensors(spark, sf_dir)
    label = F.element_at(F.array(F.lit("BAD"), F.lit(" Bad "), F.lit("good"), F.lit("Good")), (F.col("id") % 4 + 1).cast("int"))
    return rows.select(
        "Fruit",
        F.floor(F.col("Temp") / 10).cast("double").alias("Temp"),
        F.floor(F.col("Humidity") / 10).alias("Humid (%)"),
        F.floor(F.col("Light") / 50).alias("Light (Fux)"),
        F.floor(F.col("CO2") / 360).alias("CO2 (pmm)"),
        label.alias("Class"),
    )


FIXED_SCORERS = ["S1", "S2", "S3", "S4", "S5", "S6"]


# Fixed scorers: closed-form scores, so everything after scoring is comparable across engines.
# Values: probability (or None for a ranking score only) and the score.
def fixed_scorers() -> dict[str, tuple[Column | None, Column]]:
    humidity = F.col("Humidity") / 99.0
    co2 = F.col("CO2") / 1440.0
    temp = 1.0 - F.least(F.col("Temp") / 100.0, F.lit(1.0))
    known = F.when(F.col("id") % 7 == 0, 1.0 - F.col("y")).otherwise(F.col("y").cast("double"))
    ties = F.round(F.col("Humidity") / 99.0, 1)
    unsure = (F.col("Temp") - 30.0) / 50.0 + (F.col("Humidity") - 50.0) / 50.0
    return {
        "S1": (humidity, humidity),
        "S2": (co2, co2),
        "S3": (temp, temp),
        "S4": (known, known),
        "S5": (ties, ties),
        "S6": (None, unsure),
    }


def score_all(df: DataFrame, scorers: Mapping[str, tuple[Column | None, Column]] | None = None) -> DataFrame:
    """One row per input row and scorer: model, y_pred, y_proba, y_score. A score without probability is cut at 0."""
    listed = scorers or fixed_scorers()
    # Each score is computed once, before the row is copied per scorer.
    made = {f"_score_{name}": score.cast("double") for name, (_, score) in listed.items()}
    made |= {f"_proba_{name}": proba.cast("double") for name, (proba, score) in listed.items() if proba is not None and proba is not score}
    staged = df.withColumns(made)
    cells = []
    for name, (proba, _) in listed.items():
        score = F.col(f"_score_{name}")
        chance = F.lit(None).cast("double") if proba is None else F.col(f"_proba_{name}") if f"_proba_{name}" in made else score
        cells.append(
            F.struct(
                F.lit(name).alias("model"),
                (score >= (0.5 if proba is not None else 0.0)).cast("int").alias("y_pred"),
                chance.alias("y_proba"),
                score.alias("y_score"),
            )
        )
    return staged.select(*df.columns, F.inline(F.array(*cells)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions table of the fixed scorers on the sensor rows."""
    return score_all(sensors(spark, sf_dir)).select("id", "Fruit", "y", "model", "y_pred", "y_proba", "y_score")
