"""Growing trees with Spark: rows become binned cells once, then all trees of all fits are grown on the cells.

``bin_edges`` and ``cells_of`` reduce the rows: one sketch pass, one pass that codes
and combines them. Cells that fit into ``LIMIT_CELLS`` are broadcast, and every
block of trees (or boosted fit) of every variant is grown by a task of one job.
Boosted trees on more cells are grown by a job a level over parts that the Python workers
keep; the driver adds up their sums and chooses the splits. Where parts would be too large, and for
forests, larger tables are grown level by level: a job sums the statistics of all open
nodes where the cells lie, groups of (tree, node) choose the splits, and only the
splits come back; parts of forests below nodes of at most ``LIMIT_CELLS`` rows are
finished in one task each, with their rows shuffled there. Both ways see the same sums and the same
hashed draws, so they grow the same trees.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from gaugelab.models import trees as tr
from gaugelab.storage import dropped, written

#: Cells that may be broadcast (some 20 bytes each), and rows of a node that one task may finish.
LIMIT_CELLS = 1 << 20
TREES_PER_TASK = 25
#: Cells of a part of a boosted fit that workers keep (some 60 bytes each): at most, and as many as are worth a part; parts at most.
PART_MOST, PART_LEAST, MOST_PARTS = 6 << 20, 1 << 17, 64
#: Trees that grow together when cells are not broadcast.
WAVE = 16

_CELL = "fold int, key binary, y int, n long"


@dataclass(frozen=True)
class Fit:
    """One variant: a recipe, the fold it does not learn from (None: learns from all) and the features it may use."""

    recipe: tr.Recipe
    held: int | None = None
    allowed: tuple[bool, ...] | None = None


def bin_edges(rows: DataFrame, expressions: Mapping[str, str], bins: int) -> list[np.ndarray]:
    """Edges per output column, from one sketch pass over all of them."""
    names = [f"_f{i}" for i in range(len(expressions))]
    staged = rows.select(*[F.expr(e).cast("double").alias(n) for n, e in zip(names, expressions.values())])
    found = staged.approxQuantile(names, [i / bins for i in range(bins)], 1.0 / (4 * bins)) if names else []
    return [np.unique(np.array(q, dtype=float)) for q in found]


def with_key(rows: DataFrame, expressions: Mapping[str, str], edges: Sequence[np.ndarray], carry: Mapping[str, str]) -> DataFrame:
    """The carried expressions and ``key``, the bin codes of a row as bytes."""
    names = [f"_f{i}" for i in range(len(expressions))]
    kept = rows.select(*[F.expr(e).alias(c) for c, e in carry.items()], *[F.expr(e).cast("double").alias(n) for n, e in zip(names, expressions.values())])
    schema = StructType([*kept.schema.fields[: len(carry)], StructField("key", BinaryType())])
    edges, width, first = list(edges), len(names), len(carry)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(first + j).to_numpy(zero_copy_only=False) for j in range(width)], axis=1) if width else np.zeros((batch.num_rows, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], _binary(tr.coded(values, edges))], [*carry, "key"])

    return kept.mapInArrow(run, schema)


def _binary(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    at = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(np.ascontiguousarray(codes).tobytes())])


def cells_of(keyed: DataFrame) -> DataFrame:
    """Rows with equal fold, codes and label combined: fold, key, y, n; written."""
    return written(keyed.groupBy("fold", "key", F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).select("fold", "key", "y", "n"), "cells")


def _held(batch: pa.RecordBatch | pa.Table, edges: Sequence[np.ndarray]) -> tr.Cells:
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    joined = b"".join(batch.column("key").to_pylist())
    codes = np.frombuffer(joined, np.uint8).reshape(batch.num_rows, len(edges)) if len(edges) else np.zeros((batch.num_rows, 0), np.uint8)
    return tr.Cells(codes, get("y").astype(np.int8), get("n").astype(np.int64), get("fold").astype(np.int32), list(edges))


def small_cells(cells: DataFrame, edges: Sequence[np.ndarray], limit: int | None = None) -> tr.Cells | None:
    """The cells at hand, in a fixed order, or None if there are more than the limit."""
    limit = LIMIT_CELLS if limit is None else limit
    if cells.limit(limit + 1).count() > limit:
        return None
    table = cells.toArrow()
    return _held(table.sort_by([("fold", "ascending"), ("key", "ascending"), ("y", "ascending")]).combine_chunks(), edges)


def _units(fits: Sequence[Fit]) -> list[tuple[int, int, int]]:
    """(fit, first tree, end) of each task, the long ones first: forests in blocks, boosted fits whole."""
    found = []
    for i, f in enumerate(fits):
        step = TREES_PER_TASK if f.recipe.kind == "forest" else f.recipe.trees
        found += [(i, a, min(a + step, f.recipe.trees)) for a in range(0, f.recipe.trees, step)]
    return sorted(found, key=lambda u: (fits[u[0]].recipe.kind == "forest", -(u[2] - u[1]) * min(fits[u[0]].recipe.depth, 12), u))


def _mask(fit: Fit, features: int) -> np.ndarray:
    return np.ones(features, bool) if fit.allowed is None else np.array(fit.allowed, bool)


def _each_unit(spark: SparkSession, cells: tr.Cells, fits: Sequence[Fit], work, schema: str, label: str) -> DataFrame:
    """Run ``work`` once per unit, each in a task of its own, and write what it yields."""
    units = _units(fits)
    lent = spark.sparkContext.broadcast((cells, list(fits), units))

    def run(batches: Iterator[pa.RecordBatch]):
        held, variants, parts = lent.value
        for batch in batches:
            for u in batch.column(0).to_pylist():
                i, first, last = parts[u]
                train = np.flatnonzero(held.fold != variants[i].held) if variants[i].held is not None else np.arange(len(held.y))
                made, base = tr.grow_all(variants[i].recipe, held, train, _mask(variants[i], len(held.edges)), range(first, last))
                yield from work(i, first, variants[i], held, made, base)

    out = written(spark.range(0, len(units), 1, max(1, len(units))).mapInArrow(run, schema), label)
    lent.destroy()
    return out


_TREE = "fit int, tree int, base double, depth int, feature binary, cut binary, left binary, value binary, gain binary"


def _tree_row(fit: int, number: int, base: float, t: tr.Tree) -> tuple:
    return fit, number, base, t.depth, t.feature.tobytes(), t.cut.tobytes(), t.left.tobytes(), t.value.tobytes(), t.gain.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), *[pa.binary()] * 5]
    names = [c.split()[0] for c in _TREE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def tree_of(row) -> tr.Tree:
    read = lambda c, kind: np.frombuffer(row[c], kind)
    return tr.Tree(read("feature", np.int16), read("cut", np.int16), read("left", np.int32), read("value", np.float64), read("gain", np.float64), row["depth"])


def grown_trees(spark: SparkSession, cells: tr.Cells, fits: Sequence[Fit]) -> DataFrame:
    """One row per tree of every fit, written."""
    def work(i, first, fit, held, made, base):
        yield _batch([_tree_row(i, first + k, base, t) for k, t in enumerate(made)])

    return _each_unit(spark, cells, fits, work, _TREE, "trees")


_VOTE = "fit int, fold int, key binary, vote double, shares array<double>"


def held_votes(spark: SparkSession, cells: tr.Cells, fits: Sequence[Fit]) -> tuple[DataFrame, DataFrame]:
    """What every fit says of the fold it did not learn from, (fit, fold, key, proba), and (fit, shares), the importance of each feature."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.float64())]

    def work(i, first, fit, held, made, base):
        names = [c.split()[0] for c in _VOTE.split(", ")]
        shares = tr.importances(made, len(held.edges)) * len(made) / fit.recipe.trees
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((i, None, None, None, shares.tolist()), kinds)], names)
        if fit.held is None:
            return
        codes = np.unique(held.codes[held.fold == fit.held], axis=0)
        if not len(codes):
            return
        value = tr.added_values(made, codes)
        vote = value / fit.recipe.trees if fit.recipe.kind == "forest" else tr.sigmoid(base + value)
        n = len(codes)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, fit.held, np.int32)), _binary(codes), pa.array(vote), pa.nulls(n, kinds[4])], names)

    out = _each_unit(spark, cells, fits, work, _VOTE, "votes")
    votes = out.where("key is not null").groupBy("fit", "fold", "key").agg(F.sum("vote").alias("proba"))
    width = len(cells.edges)
    sums = [F.sum(F.col("shares")[j]).alias(f"s{j}") for j in range(width)]
    shares = out.where("key is null").groupBy("fit").agg(*sums).select("fit", F.array(*[f"s{j}" for j in range(width)]).alias("shares"))
    return votes, shares


# Cells that are not broadcast.

def _partial_sums(cells: DataFrame, recipe: tr.Recipe, edges: list[np.ndarray], growing: dict[int, tr.Growing], margins: bool) -> DataFrame:
    """(tree, node, sums) of every open node, as far as each task has met it."""
    offsets = tr.offsets_of(edges)
    trunks = {t: (g.finished_so_far(), g.open_numbers()) for t, g in growing.items()}
    lent = cells.sparkSession.sparkContext.broadcast(trunks)

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for t, node, _, stats, places, _ in _routed(batch, recipe, edges, lent.value, margins, offsets):
                names = np.unique(node)
                sums = tr.histogram(places, np.searchsorted(names, node), stats, len(names), int(offsets[-1]))
                for k, name in enumerate(names.tolist()):
                    known = held.get((t, name))
                    held[t, name] = sums[:, k] if known is None else known + sums[:, k]
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["tree", "node", "sums"])

    return cells.mapInArrow(run, "tree int, node int, sums binary")


def _routed(batch, recipe, edges, trunks, margins, offsets):
    """Per tree: its number, open node, rows, statistics, places and hash of the cells that stand at an open node."""
    if not batch.num_rows:
        return
    own = _held(batch, edges)
    hashes, y, n = tr.cell_hash(own), own.y.astype(np.float64), own.n.astype(np.float64)
    margin = batch.column("margin").to_numpy() if margins else None
    for t, (trunk, number) in trunks.items():
        weight = tr.tree_weights(recipe, t, hashes, n)
        stats = np.stack([weight, weight * y]) if recipe.kind == "forest" else tr.gradients(y, weight, margin)
        node = number[trunk.leaf_of(own.codes)]
        live = np.flatnonzero((node >= 0) & (weight > 0))
        if len(live):
            yield t, node[live], live, stats[:, live], own.codes[live] + offsets[:-1], own.codes[live]


def _chosen(partial: DataFrame, recipe: tr.Recipe, edges: list[np.ndarray], names: dict[int, np.ndarray], allowed: np.ndarray) -> list:
    """The splits of all open nodes: groups of a node, or of a whole tree where a level shares its split."""
    offsets, channels = tr.offsets_of(edges), 2 if recipe.kind == "forest" else 3
    schema = "tree int, node int, feature int, cut int, gain double, totals array<double>"

    def choose(rows: pa.Table) -> pa.Table:
        tree = rows.column("tree")[0].as_py()
        node = rows.column("node").to_numpy()
        sums = np.stack([np.frombuffer(b, np.float64).reshape(channels, -1) for b in rows.column("sums").to_pylist()])
        present = np.unique(node)
        total = np.zeros((channels, len(present), sums.shape[2]))
        np.add.at(total.transpose(1, 0, 2), np.searchsorted(present, node), sums)
        feature, cut, gain, totals = tr.best_splits(recipe, tree, names[tree][present], total, offsets, edges, tr.tree_features(recipe, tree, allowed))
        k = len(present)
        return pa.table({
            "tree": pa.array([tree] * k, pa.int32()), "node": pa.array(present, pa.int32()), "feature": pa.array(feature, pa.int32()), "cut": pa.array(cut, pa.int32()),
            "gain": pa.array(gain, pa.float64()), "totals": pa.array(totals.T.tolist(), pa.list_(pa.float64())),
        })

    return partial.groupBy("tree", *([] if recipe.level else ["node"])).applyInArrow(choose, schema).collect()


def _finished_below(cells: DataFrame, recipe: tr.Recipe, edges: list[np.ndarray], growing: dict[int, tr.Growing], allowed: np.ndarray) -> dict[int, dict[int, tr.Tree]]:
    """The rest of each tree below its open nodes, each grown where the cells of the node are brought together."""
    offsets = tr.offsets_of(edges)
    trunks = {t: (g.finished_so_far(), g.open_numbers()) for t, g in growing.items()}
    below = {t: (g.names, g.depth) for t, g in growing.items()}
    lent = cells.sparkSession.sparkContext.broadcast(trunks)

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for t, node, _, stats, _, codes in _routed(batch, recipe, edges, lent.value, False, offsets):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t, np.int32)), pa.array(node.astype(np.int32)), _binary(codes), pa.array(stats[0]), pa.array(stats[1])], ["tree", "node", "key", "a", "b"])

    def finish(rows: pa.Table) -> pa.Table:
        t, node = rows.column("tree")[0].as_py(), rows.column("node")[0].as_py()
        codes = np.frombuffer(b"".join(rows.column("key").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        names, depth = below[t]
        made = tr.grow(recipe, t, codes, np.stack([rows.column("a").to_numpy(), rows.column("b").to_numpy()]), edges, allowed, int(names[node]), depth)
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "made": pa.array([pickle.dumps(made)], pa.binary())})

    dealt = cells.mapInArrow(deal, "tree int, node int, key binary, a double, b double")
    out: dict[int, dict[int, tr.Tree]] = {t: {} for t in growing}
    for r in dealt.groupBy("tree", "node").applyInArrow(finish, "tree int, node int, made binary").collect():
        out[r["tree"]][growing[r["tree"]].closed + r["node"]] = pickle.loads(r["made"])
    return out


def grow_wide(cells: DataFrame, fit: Fit, edges: list[np.ndarray], limit: int | None = None) -> tuple[list[tr.Tree], float]:
    """The trees of one fit, level by level over cells that stay where they are, and the margin they start from."""
    limit = LIMIT_CELLS if limit is None else limit
    recipe, allowed = fit.recipe, _mask(fit, len(edges))
    own = cells if fit.held is None else cells.where(F.col("fold") != fit.held)
    sums = own.agg(F.sum(F.col("n") * F.col("y")).alias("one"), F.sum("n").alias("n")).first()
    base = tr.start_margin(recipe, np.array([1.0, 0.0]), np.array([sums["one"] or 0, (sums["n"] or 0) - (sums["one"] or 0)], float))
    boosted = recipe.kind == "boost"
    if boosted and (tasks := _tasks_together(own, edges, allowed)):
        return _grown_together(own, recipe, edges, allowed, base, tasks), base
    state = written(own.withColumn("margin", F.lit(base)), "margins") if boosted else own
    made: list[tr.Tree] = []
    step = 1 if boosted else WAVE
    for first in range(0, recipe.trees, step):
        growing = {t: tr.Growing(recipe, t) for t in range(first, min(first + step, recipe.trees))}
        ends: dict[int, dict[int, tr.Tree]] = {}
        while live := {t: g for t, g in growing.items() if g.open}:
            rows: dict[int, dict[int, tuple]] = {t: {} for t in live}
            for r in _chosen(_partial_sums(state, recipe, edges, live, boosted), recipe, edges, {t: g.names for t, g in live.items()}, allowed):
                rows[r["tree"]][r["node"]] = r
            for t, g in live.items():
                found = [rows[t].get(k) for k in range(g.open)]
                g.take(
                    np.array([r["feature"] if r else -1 for r in found]), np.array([r["cut"] if r else 0 for r in found]), np.array([r["gain"] if r else 0.0 for r in found]),
                    np.array([r["totals"] if r else [0.0] * (3 if boosted else 2) for r in found]).T,
                )
            live = {t: g for t, g in growing.items() if g.open}
            # Children hold fewer rows than their parents.
            if live and not boosted and all(r["totals"][0] <= limit for part in rows.values() for r in part.values()):
                ends = _finished_below(state, recipe, edges, live, allowed)
                break
        made += [tr.grafted(g.finished(), ends[t]) if t in ends else g.finished() for t, g in growing.items()]
        if boosted and first + step < recipe.trees:
            after = written(_with_margins(state, made[-1], edges), "margins")
            dropped(state.sparkSession, state)
            state = after
    return made, base


def _tasks_together(cells: DataFrame, edges: list[np.ndarray], allowed: np.ndarray) -> int:
    """The number of parts that workers may keep of the cells; 0 if those would be too large."""
    if not len(edges) or not allowed.any():
        return 0
    n, cores = cells.count(), cells.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, MOST_PARTS, n // PART_LEAST))
    return tasks if n <= tasks * PART_MOST else 0


#: Parts that this worker holds, the last used at the end; each can be made anew from its cells and the trees so far.
_KEPT: dict[tuple[str, int], tr.BoostedPart] = {}


def _part(run: str, number: int, packed: Iterator, make, trees: int, levels: int) -> tr.BoostedPart:
    found = _KEPT.pop((run, number), None)
    rows = None if found is not None and found.reaches(trees, levels) else list(packed)
    for _ in packed:  # a worker that leaves rows unread is not used again
        pass
    if rows is not None:
        found = make(rows)
    _KEPT[run, number] = found
    while len(_KEPT) > 1 and sum(p.size for p in _KEPT.values()) > 2 * PART_MOST:
        del _KEPT[next(iter(_KEPT))]
    return found


def _grown_together(cells: DataFrame, recipe: tr.Recipe, edges: list[np.ndarray], allowed: np.ndarray, base: float, tasks: int) -> list[tr.Tree]:
    """The trees of a boosted fit, a job a level; workers keep their part of the cells with margins and nodes from job to job.

    A worker that does not have the part, or has it at an earlier tree, brings it to where it should be.
    """
    width, run, drawn = len(edges), uuid.uuid4().hex, recipe.sample < 1.0

    def pack(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                own = _held(batch, edges)
                # Counts that are all one and folds that no draw needs are left out: every job reads this.
                values = [own.codes.tobytes(), own.y.tobytes(), b"" if (own.n == 1).all() else own.n.tobytes(), own.fold.tobytes() if drawn else b""]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["codes", "y", "n", "fold"])

    def make(rows):
        joined = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
        y = joined([r["y"] for r in rows], np.int8)
        n = joined([r["n"] or np.ones(len(r["y"]), np.int64).tobytes() for r in rows], np.int64)
        fold = joined([r["fold"] for r in rows], np.int32) if drawn else np.zeros(len(y), np.int32)
        return tr.BoostedPart(recipe, tr.Cells(joined([r["codes"] for r in rows], np.uint8).reshape(-1, width), y, n, fold, edges), base)

    dealt = cells.select("fold", "key", "y", "n").repartition(tasks).mapInArrow(pack, "codes binary, y binary, n binary, fold binary").rdd
    dealt.persist(StorageLevel.MEMORY_AND_DISK)
    made: list[tr.Tree] = []
    past: list[tuple[list[tr.Moves], np.ndarray]] = []
    try:
        for t in range(recipe.trees):
            before = pickle.dumps(past)

            def sums_of(moves, slot, nodes, used):
                def work(number, packed):
                    trees = pickle.loads(before)  # noqa: B023
                    yield _part(run, number, packed, make, len(trees), len(moves)).sums(trees, moves, slot, nodes, used)

                total = None
                for sums in dealt.mapPartitionsWithIndex(work).collect():
                    total = sums if total is None else total + sums
                return total

            tree, moves, value = tr.boosted_tree(recipe, t, edges, allowed, sums_of)
            made.append(tree)
            past.append((moves, value))
    finally:
        dealt.unpersist()
    return made


def _with_margins(cells: DataFrame, tree: tr.Tree, edges: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                own = _held(batch, edges)
                margin = batch.column("margin").to_numpy() + tree.value[tree.leaf_of(own.codes)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], [*batch.schema.names[:4], "margin"])

    return cells.select("fold", "key", "y", "n", "margin").mapInArrow(run, _CELL + ", margin double")


def tree_table(spark: SparkSession, made: Sequence[tr.Tree], base: float) -> DataFrame:
    """Trees at hand as rows like those of ``grown_trees``."""
    schema = spark.range(0).mapInArrow(lambda b: b, _TREE).schema
    return written(spark.createDataFrame([_tree_row(0, k, base, t) for k, t in enumerate(made)], schema), "trees")


def score_schema(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("y_pred", IntegerType()), StructField("y_proba", DoubleType()), StructField("y_score", DoubleType())])


def votes(cells: DataFrame, edges: list[np.ndarray], fits: Sequence[Fit], limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(fit, fold, key, proba) of the folds that fits did not learn from, and (fit, shares): importance per feature."""
    spark = cells.sparkSession
    held = small_cells(cells, edges, limit)
    if held is not None:
        return held_votes(spark, held, fits)
    found, shares = [], []
    for i, fit in enumerate(fits):
        made, base = grow_wide(cells, fit, edges, limit)
        shares.append((i, tr.importances(made, len(edges)).tolist()))
        if fit.held is not None:
            keys = cells.where(F.col("fold") == fit.held).select("fold", "key").distinct()
            found.append(written(_voted(keys, Scorer(fit.recipe.kind, made, base), len(edges)).select(F.lit(i).alias("fit"), "fold", "key", "proba"), "votes"))
    none = spark.range(0).select(F.lit(0).alias("fit"), F.lit(0).alias("fold"), F.lit(b"").alias("key"), F.lit(0.0).alias("proba"))
    for f in found:
        none = none.unionByName(f)
    return none, spark.createDataFrame(shares, "fit int, shares array<double>")


@dataclass
class Scorer:
    """Trees with what turns the sum of their values into a probability."""

    kind: str
    trees: list[tr.Tree]
    base: float

    def proba(self, codes: np.ndarray) -> np.ndarray:
        # Rows with the same codes are scored once.
        if not codes.shape[1]:
            distinct, back = codes[:1], np.zeros(len(codes), int)
        else:
            packed = np.ascontiguousarray(codes).view(f"V{codes.shape[1]}").ravel()
            _, first, back = np.unique(packed, return_index=True, return_inverse=True)
            distinct = codes[first]
        value = tr.added_values(self.trees, distinct)
        return (value / max(1, len(self.trees)) if self.kind == "forest" else tr.sigmoid(self.base + value))[back]


def _voted(keys: DataFrame, scorer: Scorer, width: int) -> DataFrame:
    lent = keys.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(batch.num_rows, width)
                yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("key"), pa.array(lent.value.proba(codes))], ["fold", "key", "proba"])

    return keys.mapInArrow(run, "fold int, key binary, proba double")
