from __future__ import annotations

import numpy as np

from gaugelab.llm import near_vectors, queries
from gaugelab.llm.components import components

SMALL_DIR = "/root/testdata/sf0.1"


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(300)]
    df = spark.createDataFrame([*pairs, (None, 3), (5, None)], "a long, b long")
    got = {r.id: r.component_id for r in components(df, "a", "b").collect()}
    want = closure(pairs, {n for p in pairs for n in p})
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert components(df.limit(0), "a", "b").count() == 0


def exact(rows):
    ids = [r[0] for r in rows]
    v = np.array([r[1] for r in rows], np.float64)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    return ids, near


def test_recall_and_precision(spark):
    df = spark.read.parquet(f"{SMALL_DIR}/embeddings.parquet")
    ids, near = exact([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    want = near.sum(axis=1)
    got = {r.vec_id: r for r in queries.QUERIES["op6_embedding_near_duplicates"](spark, SMALL_DIR).collect()}
    links = np.array([got[i].n_links for i in ids])
    assert (links <= want).all() and links.sum() >= 0.97 * want.sum()
    classes = closure([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b], ids)
    assert sum(got[i].component_id == classes[i] for i in ids) >= 0.97 * len(ids)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_large_groups_are_cut_and_exact(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    draw = np.random.default_rng(8)
    centre = draw.standard_normal(16)
    rows = [(i, [float(x) for x in (centre + 0.02 * draw.standard_normal(16)).astype(np.float32)], 1) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, component_id string")
    ids, near = exact(rows)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(df, recall=0.9999).collect()}
    assert [got[i].n_links for i in ids] == near.sum(axis=1).tolist()
    assert {got[i].component_id for i in ids} == {0}


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [float("inf"), 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (11, [2.0, 0.0], 1), (12, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df).collect())
    assert got[0][:2] == (-1, 0)
    assert got[1:] == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), *[(i, 0, i, True) for i in range(4, 11)], (11, 3, 1, False), (12, 0, 12, True)]
    assert near_vectors.near_duplicates(df.limit(0)).count() == 0
