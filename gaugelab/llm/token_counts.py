"""Exact length histogram of encoded documents, with suffix sums.

Documents are counted by their number of tokens; sums from the longest length
down then answer every question about lengths from the small table: totals,
quantiles, and what is left when each document is cut at a context limit.

Sums run within ranges of ``RANGE`` lengths and over the totals of the ranges, so
no window holds more than ``RANGE`` rows or one row per range.

Cases: null and empty texts have length 0 and count as documents; an empty table
gives an empty histogram, for which totals are 0 and quantiles null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelab.llm import bpe
from gaugelab.storage import written

RANGE = 4096


def histogram(docs: DataFrame, text_column: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    counted = bpe.lengths(docs.select(F.col(text_column).alias("text")), "text", path)
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For every length as a context limit: documents and tokens at or above it, and what cutting there leaves."""
    kept = written(counts.select("n_tokens", "n_docs"), "lengths").withColumn("part", F.floor(F.col("n_tokens") / RANGE))
    totals = kept.groupBy("part").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    totals = totals.select(
        "part",
        F.coalesce(F.sum("docs").over(above), zero).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), zero).alias("tokens_above"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("all_tokens"),
    )
    down = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = kept.join(totals, "part").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_above") + F.sum("n_docs").over(down)).alias("docs_at_least"),
        (F.col("tokens_above") + F.sum(F.col("n_tokens") * F.col("n_docs")).over(down)).alias("tokens_at_least"),
        "all_docs",
        "all_tokens",
    )
    docs_up_to = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        docs_up_to.alias("docs_up_to"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        "all_docs",
        "all_tokens",
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """One row per limit: tokens left when documents are cut there, documents cut, and tokens lost."""
    at_least = F.struct("docs_at_least", "tokens_at_least")
    picked = [F.min_by(F.when(F.col("n_tokens") >= x, at_least), F.when(F.col("n_tokens") >= x, F.col("n_tokens"))).alias(f"at_{i}") for i, x in enumerate(limits)]
    beyond = [F.min_by(F.when(F.col("n_tokens") > x, F.col("docs_at_least")), F.when(F.col("n_tokens") > x, F.col("n_tokens"))).alias(f"over_{i}") for i, x in enumerate(limits)]
    row = sums.agg(F.coalesce(F.max("all_tokens"), F.lit(0)).alias("total"), *picked, *beyond)
    zero = F.lit(0).cast("long")

    def answer(i: int, x: int):
        docs, tokens = F.coalesce(F.col(f"at_{i}.docs_at_least"), zero), F.coalesce(F.col(f"at_{i}.tokens_at_least"), zero)
        left = F.col("total") - tokens + docs * x
        return F.struct(F.lit(x).cast("long").alias("context_limit"), left.alias("tokens_left"), F.coalesce(F.col(f"over_{i}"), zero).alias("docs_cut"), (F.col("total") - left).alias("tokens_lost"))

    return row.select(F.inline(F.array(*[answer(i, x) for i, x in enumerate(limits)])))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row per share: the smallest length that at least this share of the documents does not exceed."""
    enough = [F.min(F.when(F.col("docs_up_to") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("all_docs"))), F.col("n_tokens"))).alias(f"q_{i}") for i, q in enumerate(shares)]
    pairs = [F.struct(F.lit(float(q)).alias("share"), F.col(f"q_{i}").alias("n_tokens")) for i, q in enumerate(shares)]
    return sums.agg(*enough).select(F.inline(F.array(*pairs)))
