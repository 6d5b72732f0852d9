"""A fitted ensemble of trees: a table of node arrays, broadcast once and applied to whole Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelab.models import growth
from gaugelab.models import trees as tr
from gaugelab.models.fitted import model_folder
from gaugelab.models.growth import Fit, Scorer


class FittedTrees:
    """Scores rows with the columns y_pred, y_proba and y_score.

    ``expressions`` make the features out of a row, ``edges`` their bins, ``table``
    holds the trees. A Python worker holds all trees: some 20 bytes a node.
    """

    def __init__(self, name: str, recipe_kind: str, expressions: Mapping[str, str], edges: Sequence[np.ndarray], table: DataFrame, sources: Mapping[str, str]):
        self.name, self.kind, self.expressions, self.edges, self.table = name, recipe_kind, dict(expressions), [np.asarray(e, float) for e in edges], table
        self.sources = dict(sources)  # output name -> raw column
        self._lent = None

    def trees(self) -> tuple[list[tr.Tree], float]:
        rows = sorted(self.table.collect(), key=lambda r: r["tree"])
        return [growth.tree_of(r) for r in rows], rows[0]["base"] if rows else 0.0

    def _broadcast(self):
        if self._lent is None:
            made, base = self.trees()
            self._lent = self.table.sparkSession.sparkContext.broadcast(Scorer(self.kind, made, base))
        return self._lent

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"_t{i}" for i in range(len(self.expressions))]
        staged = df.select("*", *[F.expr(e).cast("double").alias(n) for n, e in zip(names, self.expressions.values())])
        lent, edges, carried, columns = self._broadcast(), self.edges, len(df.columns), [*df.columns, "y_pred", "y_proba", "y_score"]

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = np.stack([batch.column(carried + j).to_numpy(zero_copy_only=False) for j in range(len(edges))], axis=1)
                proba = lent.value.proba(tr.coded(values, edges))
                side = pa.array((proba > 0.5).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:carried], side, pa.array(proba), pa.array(proba)], columns)

        return staged.mapInArrow(run, growth.score_schema(df))

    def importances(self) -> dict[str, float]:
        """Share of the gain per output, averaged over trees."""
        return dict(zip(self.expressions, tr.importances(self.trees()[0], len(self.edges)).tolist()))

    def save(self, folder: str) -> str:
        """Write under ``folder`` by model name; returns the path."""
        path = f"{folder.rstrip('/')}/{model_folder(self.name)}"
        self.table.write.mode("overwrite").parquet(f"{path}/trees")
        note = {"name": self.name, "output": "trees", "kind": self.kind, "expressions": self.expressions, "edges": [e.tolist() for e in self.edges], "sources": self.sources}
        SparkSession.active().createDataFrame([(json.dumps(note),)], "value string").write.mode("overwrite").text(f"{path}/note")
        return path

    @staticmethod
    def load(path: str, note: dict) -> "FittedTrees":
        table = SparkSession.active().read.parquet(f"{path}/trees")
        return FittedTrees(note["name"], note["kind"], note["expressions"], note["edges"], table, note["sources"])


def fit_trees(name: str, train: DataFrame, expressions: Mapping[str, str], sources: Mapping[str, str], y: str, recipe: tr.Recipe, bins: int, limit: int | None = None) -> FittedTrees:
    """Bin the rows, combine them to cells and grow the trees on those."""
    spark = train.sparkSession
    edges = growth.bin_edges(train, expressions, bins)
    cells = growth.cells_of(growth.with_key(train, expressions, edges, {"fold": "CAST(0 AS INT)", "y": f"CAST(`{y}` AS INT)"}))
    held = growth.small_cells(cells, edges, limit)
    if held is not None:
        table = growth.grown_trees(spark, held, [Fit(recipe)])
    else:
        table = growth.tree_table(spark, *growth.grow_wide(cells, Fit(recipe), edges, limit))
    return FittedTrees(name, recipe.kind, expressions, edges, table, {n: sources[n] for n in expressions})
