"""Components against a plain union of the edges."""

from __future__ import annotations

import random

from gaugelab.llm.components import components


def plain(edges):
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    return root


def test_chains_stars_and_repeats(spark):
    draw = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(200, i) for i in range(201, 260)] + [(i, 150) for i in range(250, 255)]
    mixed = [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(70)]
    edges = chain + star + mixed + [(b, a) for a, b in chain[::3]] + star[:9] + [(5, 5), (None, 6), (7, None), (-3, 141)]
    draw.shuffle(edges)
    rows = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert len(rows) == len({r.id for r in rows})
    assert {r.id: r.component_id for r in rows} == plain(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
