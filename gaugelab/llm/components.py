"""Connected components of a graph given as an edge table.

Alternates the two star operations: every node hands its larger neighbours (large
star), then its smaller ones (small star), to the smallest node it knows. Each
keeps components together; in the end every node has one edge to the smallest of
its component. Both are one aggregation and one join per round. The minima are
written before they are joined, so that the join can split a node with very many
edges, and the edges of each round are written as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.storage import dropped, written


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, as (big, small); loops and null ends go."""
    return edges.select(F.greatest("big", "small").alias("big"), F.least("big", "small").alias("small")).where("big <> small").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smallest one, or such edges only come in: then those are the components."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("big").alias("node"), F.lit(1).alias("up")), F.struct(F.col("small").alias("node"), F.lit(0).alias("up")))))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return seen.where("up > 1 or (up = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, one: str, other: str) -> DataFrame:
    """id and component_id (the smallest id reachable) of every node that has an edge to another."""
    spark = edges.sparkSession
    now = written(_ordered(edges.select(F.col(one).alias("big"), F.col(other).alias("small")).dropna()), "edges")
    while not _done(now):
        both = now.select(F.col("small").alias("node"), F.col("big").alias("near")).unionByName(now.select(F.col("big").alias("node"), F.col("small").alias("near")))
        least = written(both.groupBy("node").agg(F.min("near").alias("least")), "least")
        large = written(_ordered(now.join(least, now.small == least.node).select("big", F.least("small", "least").alias("small"))), "edges")
        below = written(large.groupBy("big").agg(F.min("small").alias("least")), "least")
        known = large.join(below.withColumnRenamed("big", "node"), large.big == F.col("node"))
        small = known.select(F.inline(F.array(F.struct("big", F.col("least").alias("small")), F.struct(F.col("small").alias("big"), F.col("least").alias("small")))))
        after = written(_ordered(small), "edges")
        dropped(spark, now, least, large, below)
        now = after
    return now.select(F.col("big").alias("id"), F.col("small").alias("component_id")).unionByName(now.select(F.col("small").alias("id"), F.col("small").alias("component_id")).distinct())
