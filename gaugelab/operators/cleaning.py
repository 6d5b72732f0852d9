"""Header repair, label clean-up, duplicate removal and target encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from gaugelab.fixed_values import FEATURES, GROUP, HEADER_REPAIRS, NEGATIVE, POSITIVE, TARGET
from gaugelab.functions.scalars import capitalised_label


def repair_headers(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(HEADER_REPAIRS)


def normalise_labels(df: DataFrame) -> DataFrame:
    return df.withColumn(TARGET, capitalised_label(F.col(TARGET)))


def drop_exact_duplicates(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Keep one row per distinct combination of values, the one with the smallest id.

    The grouping combines copies inside each task first, so a row copied a
    billion times costs one row per task in the shuffle.
    """
    if id_col is None:
        return df.dropDuplicates()
    values = [c for c in df.columns if c != id_col]
    return df.groupBy(*values).agg(F.min(id_col).alias(id_col)).select(*df.columns)


def clean(raw: DataFrame, id_col: str | None = None) -> DataFrame:
    """Repaired headers, normalised labels, no exact duplicates."""
    return drop_exact_duplicates(normalise_labels(repair_headers(raw)), id_col)


def cleaning_report(raw: DataFrame, id_col: str | None = None) -> DataFrame:
    """What cleaning did, as rows (section, label, n).

    Sections: raw_rows, raw_columns, raw_class (counts after label clean-up,
    before duplicates go), duplicates_removed, clean_rows, class, fruit,
    missing_values (cells of the clean frame).
    """
    named = normalise_labels(repair_headers(raw))
    values = [c for c in named.columns if c != id_col]
    missing = sum(
        (_is_missing(named, c).cast("int") for c in values), F.lit(0)
    )
    distinct = named.groupBy(*values).agg(F.count(F.lit(1)).alias("copies")).withColumn("missing", missing)
    small = distinct.groupBy(TARGET, GROUP).agg(
        F.sum("copies").alias("raw"), F.count(F.lit(1)).alias("kept"), F.sum("missing").alias("missing")
    )
    entry = lambda section, label, n: F.struct(
        F.lit(section).alias("section"), F.coalesce(label, F.lit("")).alias("label"), n.cast("long").alias("n")
    )
    none, raw_n, kept_n = F.lit(""), F.col("raw"), F.col("kept")
    entries = [
        entry("raw_rows", none, raw_n),
        entry("raw_columns", none, F.lit(0)),
        entry("raw_class", F.col(TARGET), raw_n),
        entry("duplicates_removed", none, raw_n - kept_n),
        entry("clean_rows", none, kept_n),
        entry("class", F.col(TARGET), kept_n),
        entry("missing_values", none, F.col("missing")),
    ]
    # A missing fruit has no entry of its own.
    fruit = F.when(F.col(GROUP).isNotNull(), F.array(entry("fruit", F.col(GROUP), kept_n))).otherwise(F.array().cast("array<struct<section:string,label:string,n:bigint>>"))
    return (
        small.select(F.inline(F.concat(F.array(*entries), fruit)))
        .groupBy("section", "label")
        .agg(F.sum("n").alias("n"))
        .withColumn("n", F.when(F.col("section") == "raw_columns", F.lit(len(values)).cast("long")).otherwise(F.col("n")))
    )


def _is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (DoubleType, FloatType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def duplicate_analysis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: n_rows, n_exact_duplicates (beyond the first of a group), pct_duplicates, n_unique."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("copies"))
    totals = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))
    duplicates = F.col("n_rows") - F.col("n_unique")
    return totals.select(
        "n_rows",
        duplicates.alias("n_exact_duplicates"),
        F.try_divide(100.0 * duplicates, F.col("n_rows").cast("double")).alias("pct_duplicates"),
        "n_unique",
    )


def encoded_target(label: Column) -> Column:
    """1 for the positive label, 0 for the negative one; any other label is an error."""
    return (
        F.when(label == POSITIVE, F.lit(1))
        .when(label == NEGATIVE, F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("label is neither Good nor Bad: "), F.coalesce(label, F.lit("missing")))).cast("int"))
    )


def lenient_target(label: Column) -> Column:
    """1 where the trimmed, lower-cased label is the positive one, else 0; never fails."""
    text = F.lower(F.trim(F.coalesce(label.cast("string"), F.lit("")), F.lit(" \t\n\r\x0b\x0c")))
    return (text == POSITIVE.lower()).cast("int")


def features_and_target(df: DataFrame, carry: Sequence[str] = ("id",)) -> DataFrame:
    """The five features and the encoded target ``y``."""
    return df.select(*[c for c in carry if c in df.columns], *FEATURES, encoded_target(F.col(TARGET)).alias("y"))
