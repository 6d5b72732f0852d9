"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, components.

Equal vectors are taken together first. Each distinct vector then gets a sign
pattern in each of several tables; vectors of a label that share a pattern in a
table meet in a bucket, where all their cosines are computed in double precision.
A pair counts in the first table where it meets, so links are counted once.
Buckets of more than ``BLOCK`` vectors are cut into blocks, and each pair of
blocks is a group of its own, so a group has a fixed size however many vectors
share a pattern. Groups return sums and a forest of links, never all pairs.

The number of bits grows with the logarithm of the vectors, which keeps buckets
small, and the number of tables follows from the wanted recall at the threshold.

Cases: vectors that are null, all zero, or hold a null, NaN or infinite component
link with nothing, nor do those with a null label or a null id; vectors of
different lengths do not link; repeated rows are vectors of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx
from gaugelab.llm.components import components
from gaugelab.storage import written

THRESHOLD = 0.93
RECALL = 0.99
BLOCK = 512
LEAST_BITS = 8
PER_BUCKET_BITS = 8
SEED = 42


def parameters(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits per table and number of tables for so many vectors: a pair at the threshold meets with probability ``recall``."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(vectors, 2))) - PER_BUCKET_BITS)
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def _usable(id_: str, label: str, vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(id_).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lengths


def _planes(dimension: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension]).standard_normal((dimension, bits * tables))


def signatures(distinct: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row per vector and table: bucket, table, rep, n, vector and all its patterns."""
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits, dtype=np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                label, vector, rep, n = (part.column(part.schema.get_field_index(c)) for c in ("label", "vector", "rep", "n"))
                flat, lengths = _matrix(vector)
                ends = np.cumsum(lengths)
                for dimension in np.unique(lengths):
                    rows = np.flatnonzero(lengths == dimension)
                    values = np.stack([flat[ends[i] - dimension : ends[i]] for i in rows])
                    if dimension not in planes:
                        planes[dimension] = _planes(int(dimension), bits, tables)
                    sign = (values @ planes[dimension] >= 0).reshape(len(rows), tables, bits)
                    patterns = sign @ weights
                    take = pa.array(rows)
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [label.take(take), pa.array(np.full(len(rows), dimension, np.int32)), pa.array(np.full(len(rows), t, np.int32)), pa.array(patterns[:, t]), rep.take(take), n.take(take),
                             pa.array([v.tobytes() for v in values.astype(np.float32 if vector.type.value_type == pa.float32() else np.float64)], pa.binary()), pa.array([p.tobytes() for p in patterns], pa.binary())],
                            ["label", "dimension", "table", "pattern", "rep", "n", "vector", "patterns"],
                        )

    kind = distinct.schema["label"].dataType.simpleString()
    return distinct.select("label", "vector", "rep", "n").mapInArrow(run, f"label {kind}, dimension int, table int, pattern long, rep long, n long, vector binary, patterns binary")


KEY = ["label", "dimension", "table", "pattern"]


def _linked(values: np.ndarray, side: np.ndarray | None, patterns: np.ndarray, table: int, threshold: float) -> np.ndarray:
    """Which pairs of a group link and meet here for the first time."""
    norms = np.sqrt((values * values).sum(axis=1))
    unit = values / norms[:, None]
    near = unit @ unit.T >= threshold - 1e-9
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(near))
    # The cosine itself, for the few pairs at hand.
    exact = (values[i] * values[j]).sum(axis=1) / (norms[i] * norms[j]) >= threshold
    earlier = (patterns[i, :table] == patterns[j, :table]).any(axis=1) if table else np.zeros(len(i), bool)
    keep = exact & ~earlier
    near[:] = False
    near[i[keep], j[keep]] = True
    return near | near.T


def _roots(near: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    root = np.arange(len(near))
    while True:
        best = np.minimum(root, np.where(near, root[None, :], len(near)).min(axis=1, initial=len(near)))
        best = best[best]
        if (best == root).all():
            return root
        root = best


def groups(entries: DataFrame, threshold: float, width: int) -> DataFrame:
    """rep, links (vectors linked, first meetings only) and root (another vector of its component) per group and linked vector."""
    def solve(rows: pa.Table):
        m = rows.num_rows
        if m < 2:
            return None
        rows = rows.combine_chunks()
        values = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float32 if width == 4 else np.float64).reshape(m, -1).astype(np.float64)
        patterns = np.frombuffer(b"".join(rows.column("patterns").to_pylist()), np.int64).reshape(m, -1)
        lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
        side = rows.column("block").to_numpy() if lo != hi else None
        near = _linked(values, side, patterns, rows.column("table")[0].as_py(), threshold)
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            return None
        rep, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
        return rep[hit], (near[hit] @ n), rep[_roots(near)[hit]]

    def run(batches):
        for rows in tx.row_groups(batches, [*KEY, "lo", "hi"]):
            if (r := solve(rows)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in r], ["rep", "links", "root"])

    return entries.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    usable = rows.where(_usable("vec_id", "label", "vector"))
    distinct = written(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    bits, tables = parameters(distinct.count(), threshold, recall)
    entries = signatures(distinct, bits, tables)

    # Blocks of full buckets; the others are one group.
    full = entries.groupBy(*KEY).count().where(F.col("count") > BLOCK).select(*KEY, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    blocked = entries.join(written(full, "full"), KEY, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    blocked = blocked.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocked = blocked.select(*KEY, F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "rep", "n", "vector", "patterns")
    order = [*KEY, "lo", "hi"]
    width = 4 if rows.schema["vector"].dataType.elementType.simpleString() == "float" else 8
    found = written(groups(blocked.repartition(*order).sortWithinPartitions(*order), threshold, width), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.where("rep <> root"), "rep", "root")
    member = rows.join(distinct, ["label", "vector"], "left").withColumn("rep", F.when(_usable("vec_id", "label", "vector"), F.col("rep"))).select("vec_id", "rep", "n")
    known = member.join(links, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    zero = F.lit(0).cast("long")
    return known.select(
        "vec_id",
        F.when(F.col("rep").isNull(), zero).otherwise(F.col("n") - 1 + F.coalesce("links", zero)).alias("n_links"),
        F.coalesce("component_id", "rep", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))
