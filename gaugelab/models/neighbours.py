"""Exact k-nearest-neighbour voting.

Rows with equal coordinates are interchangeable except for their id, so at most
k of them can ever be among the neighbours: the reference set keeps the k
smallest ids per distinct point (pruned inside each task before the shuffle).
A reference set within a checked size is broadcast. Beyond it the space is cut
into boxes, and a row visits a box only if the box can hold a nearer point than
those found so far; boxes and visitors are worked on in bounded blocks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelab.models.fitted import SCORES, model_folder
from gaugelab.operators.features import Preparation

BROADCAST_POINTS = 100_000
BLOCK_ROWS = 20_000


def reference_points(prepared: DataFrame, names: Sequence[str], y: str, id_col: str, k: int) -> DataFrame:
    """(id, y, point): the k smallest ids per distinct point."""
    smallest = W.partitionBy(*names).orderBy("ref_id")
    kept = prepared.select(F.col(id_col).alias("ref_id"), F.col(y).cast("int").alias("ref_y"), *names).withColumn("_rank", F.row_number().over(smallest)).where(F.col("_rank") <= k)
    return kept.select("ref_id", "ref_y", F.array(*names).alias("point"))


def _nearest(points: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances, ids and labels of the k nearest points per row; equal distances by smaller id."""
    k = min(k, len(points))
    out_d, out_i, out_y = [], [], []
    step = max(1, 4_000_000 // max(1, len(points)))
    for start in range(0, len(rows), step):
        block = rows[start : start + step]
        # Differences, not the expanded square: equal points get equal distances.
        d = np.zeros((len(block), len(points)))
        for j in range(points.shape[1]):
            gap = block[:, j : j + 1] - points[:, j]
            d += gap * gap
        # Distances equal to nine decimals count as equal.
        d = np.round(d, 9)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        row, at = np.nonzero(d <= kth[:, None])
        order = np.lexsort((ids[at], d[row, at], row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, np.arange(len(block)))
        near = at[first[:, None] + np.arange(k)]
        out_d.append(np.take_along_axis(d, near, axis=1))
        out_i.append(ids[near])
        out_y.append(labels[near])
    none = np.zeros((0, k))
    return np.concatenate([none, *out_d]), np.concatenate([none.astype(ids.dtype), *out_i]), np.concatenate([none.astype(labels.dtype), *out_y])


def nearest_by_broadcast(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """Add ``neighbours`` (array of distance, id, label) when the reference fits on every executor."""
    local = reference.toPandas()
    points = np.array(local["point"].tolist(), dtype=float)
    held = queries.sparkSession.sparkContext.broadcast((points, local["ref_id"].to_numpy(), local["ref_y"].to_numpy()))

    @F.pandas_udf("array<struct<d:double,i:long,y:int>>")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, ids, labels = held.value
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series([], dtype=object)
                continue
            d, i, y = _nearest(at, ids, labels, np.vstack(batch.to_numpy()), k)
            yield pd.Series([[{"d": float(a), "i": int(b), "y": int(c)} for a, b, c in zip(*row)] for row in zip(d, i, y)])

    return queries.withColumn("neighbours", look_up("point"))


def _box_edges(reference: DataFrame, width: int, boxes: int) -> list[list[float]]:
    """Inner edges per coordinate that cut the reference into roughly ``boxes`` boxes."""
    per_axis = max(2, int(round(boxes ** (1.0 / max(1, min(width, 4))))))
    spread = reference.agg(*[F.stddev_pop(F.col("point")[j]).alias(f"s{j}") for j in range(width)]).first()
    axes = sorted(range(width), key=lambda j: -(spread[f"s{j}"] or 0.0))[:4]
    columns = reference.select(*[F.col("point")[j].alias(f"c{j}") for j in axes])
    cut = columns.approxQuantile([f"c{j}" for j in axes], [i / per_axis for i in range(1, per_axis)], 0.01)
    edges: list[list[float]] = [[] for _ in range(width)]
    for j, values in zip(axes, cut):
        edges[j] = sorted(set(values))
    return edges


def nearest_by_boxes(queries: DataFrame, reference: DataFrame, k: int, width: int, query_id: str, boxes: int = 4096, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same for any reference size, in two exact rounds.

    Round one looks in the row's own box and the k best found there bound the
    search radius. Round two visits every other box whose nearest face lies
    within that radius. Boxes are split into blocks of bounded size, and rows
    visiting a block into chunks, so no task holds a whole box or all its
    visitors, however unevenly the points are spread.
    """
    edges = _box_edges(reference, width, boxes)
    axes = [j for j in range(width) if edges[j]]

    def slot(coordinate, cuts):
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= coordinate)).cast("string")

    def box_code(point):
        return F.concat_ws("_", *[slot(point[j], edges[j]) for j in axes]) if axes else F.lit("all")

    homed = reference.withColumn("box", box_code(F.col("point")))
    sizes = homed.groupBy("box").agg(F.count(F.lit(1)).alias("box_rows"))
    # Bounds of what a box really holds; one row per non-empty box (at most `boxes` by construction).
    bounds = homed.groupBy("box").agg(
        F.count(F.lit(1)).alias("box_rows"), F.array(*[F.min(F.col("point")[j]) for j in range(width)]).alias("lo"), F.array(*[F.max(F.col("point")[j]) for j in range(width)]).alias("hi")
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.col("box_rows") / block_rows)).cast("int")
    stored = homed.join(sizes, "box").withColumn("block", F.pmod(F.xxhash64("ref_id"), blocks).cast("int")).select("box", "block", "ref_id", "ref_y", "point")

    asked = queries.select(F.col(query_id).alias("_q"), "point")
    home = asked.withColumn("box", box_code(F.col("point")))
    first = _visit(home.select("_q", "point", "box"), stored, sizes, k, block_rows)
    found = asked.join(first, "_q", "left")
    radius = F.when(F.size("neighbours") >= k, F.element_at("neighbours", k)["d"]).otherwise(F.lit(float("inf")))

    listed = bounds.collect()
    held = queries.sparkSession.sparkContext.broadcast(
        ([r["box"] for r in listed], np.array([r["lo"] for r in listed], dtype=float), np.array([r["hi"] for r in listed], dtype=float))
    )

    @F.pandas_udf("array<string>")
    def boxes_in_reach(point: pd.Series, radius: pd.Series, own: pd.Series) -> pd.Series:
        names, lo, hi = held.value
        out = []
        for p, r, mine in zip(point, radius, own):
            gap = np.maximum(np.maximum(lo - p, p - hi), 0.0)
            out.append([names[b] for b in np.flatnonzero((gap * gap).sum(axis=1) <= r + 1e-8) if names[b] != mine])
        return pd.Series(out)

    further = found.withColumn("own", box_code(F.col("point"))).withColumn("box", F.explode(boxes_in_reach("point", radius, "own")))
    second = _visit(further.select("_q", "point", "box"), stored, sizes, k, block_rows)
    every = first.unionByName(second).select("_q", F.explode("neighbours").alias("n"))
    best = _keep_best(every, k)
    return queries.join(best.withColumnRenamed("_q", query_id), query_id, "left")


def _keep_best(candidates: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("_q").orderBy("n.d", "n.i")
    kept = candidates.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return kept.groupBy("_q").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))


def _visit(visits: DataFrame, stored: DataFrame, sizes: DataFrame, k: int, block_rows: int) -> DataFrame:
    """k best per visitor over the blocks of the boxes it visits: (_q, neighbours)."""
    visitors = visits.groupBy("box").agg(F.count(F.lit(1)).alias("visitors"))
    plan = sizes.join(visitors, "box").select(
        "box",
        F.greatest(F.lit(1), F.ceil(F.col("box_rows") / block_rows)).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("visitors") / block_rows)).cast("int").alias("chunks"),
    )
    left = (
        visits.join(plan, "box")
        .withColumn("chunk", F.pmod(F.xxhash64("_q"), F.col("chunks")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("box", "block", "chunk", "_q", "point")
    )
    right = stored.join(plan, "box").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("box", "block", "chunk", "ref_id", "ref_y", "point")

    def search(rows: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(refs) == 0:
            return pd.DataFrame({"_q": pd.Series([], dtype="int64"), "d": pd.Series([], dtype="float64"), "i": pd.Series([], dtype="int64"), "y": pd.Series([], dtype="int32")})
        d, i, y = _nearest(np.vstack(refs["point"].to_numpy()), refs["ref_id"].to_numpy(), refs["ref_y"].to_numpy(), np.vstack(rows["point"].to_numpy()), k)
        repeated = np.repeat(rows["_q"].to_numpy(), d.shape[1])
        return pd.DataFrame({"_q": repeated, "d": d.ravel(), "i": i.ravel(), "y": y.ravel().astype("int32")})

    keys = ["box", "block", "chunk"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "_q long, d double, i long, y int")
    return _keep_best(near.select("_q", F.struct("d", "i", "y").alias("n")), k)


class NeighbourModel:
    """k-nearest-neighbour vote: y_proba is the share of positive neighbours."""

    def __init__(self, name: str, preparation: Preparation, reference: DataFrame, k: int, id_col: str, broadcast_points: int = BROADCAST_POINTS):
        self.name, self.preparation, self.reference = name, preparation, reference
        self.k, self.id_col, self.broadcast_points = k, id_col, broadcast_points
        self.output = "neighbours"
        self.sources: dict[str, str] = {}

    def neighbours(self, df: DataFrame) -> DataFrame:
        """The rows with ``neighbours`` added (squared distance, id, label)."""
        staged = df.withColumn("point", F.array(*[F.expr(e) for e in self.preparation.expressions()]))
        if self.reference.limit(self.broadcast_points + 1).count() <= self.broadcast_points:
            return nearest_by_broadcast(staged, self.reference, self.k).drop("point")
        # Rows may repeat an id (perturbed copies), so the search uses ids of its own.
        keyed = staged.withColumn("_row", F.monotonically_increasing_id())
        from gaugelab.storage import cut_lineage

        keyed = cut_lineage(keyed)
        return nearest_by_boxes(keyed, self.reference, self.k, len(self.preparation.outputs), "_row").drop("point", "_row")

    def transform(self, df: DataFrame) -> DataFrame:
        votes = F.aggregate("neighbours", F.lit(0), lambda acc, n: acc + n["y"])
        share = votes / F.size("neighbours").cast("double")
        found = self.neighbours(df).withColumns({"y_proba": share, "y_score": share, "y_pred": (share > 0.5).cast("int")})
        return found.select(*df.columns, *SCORES)

    def save(self, folder: str) -> str:
        path = f"{folder.rstrip('/')}/{model_folder(self.name)}"
        self.reference.write.mode("overwrite").parquet(f"{path}/reference")
        note = json.dumps({"name": self.name, "output": self.output, "preparation": self.preparation.to_json(), "k": self.k, "id_col": self.id_col})
        SparkSession.active().createDataFrame([(note,)], "value string").write.mode("overwrite").text(f"{path}/note")
        return path

    @staticmethod
    def load(path: str, note: dict) -> "NeighbourModel":
        reference = SparkSession.active().read.parquet(f"{path}/reference")
        return NeighbourModel(note["name"], Preparation.from_json(note["preparation"]), reference, note["k"], note["id_col"])


def fit_neighbours(name: str, train: DataFrame, preparation: Preparation, y: str = "y", id_col: str = "id", k: int = 7) -> NeighbourModel:
    prepared = train.select(id_col, y, *preparation.columns())
    return NeighbourModel(name, preparation, reference_points(prepared, preparation.outputs, y, id_col, k), k, id_col)
