from __future__ import annotations

import zlib

import numpy as np

from gaugelab.llm import quality, queries

SMALL_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op7_quality_classifier"](spark, SMALL_DIR).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SMALL_DIR}/labels.parquet").toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet").count()
    assert len(got) == docs and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index[:500])
    seen = got[got.held_out].join(labels, how="inner")
    good, bad = seen[seen.quality == 1], seen[seen.quality == 0]
    assert good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.03
    order = np.argsort(np.argsort(seen.score.to_numpy()))
    p = (seen.quality == 1).to_numpy()
    auc = (order[p].sum() - p.sum() * (p.sum() - 1) / 2) / (p.sum() * (~p).sum())
    assert auc > 0.99


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "ab " * 50000, 3), (2, "ab " * 50000, 3), (3, "word", None)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    constant = quality.fit(docs, labels)
    assert [r.score for r in quality.score(docs, constant).collect()] == [1.0] * 5
    assert quality.fit(docs, labels.limit(0)).constant == 0.5
    both = [(i, ("fine words here " if i % 2 else "junk*** junk### ") * 20, 0) for i in range(40)]
    some = spark.createDataFrame(both, "doc_id long, text string, score int")
    model = quality.fit(some, some.selectExpr("doc_id", "cast(doc_id % 2 as int) quality"))
    rows = quality.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and rows[2].score == rows[3].score and rows[0].score == rows[1].score
    assert quality.accepted(docs, model).columns == docs.columns
    assert quality.score(docs.limit(0), model).count() == 0


def test_scores_follow_the_share_of_the_labels(spark):
    """Texts that do not tell the labels apart score about the share of label 1, whatever it is."""
    draw = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in draw.integers(0, 300, 80))) for i in range(1500)], "doc_id long, text string")
    for of_ten in (2, 5):
        labels = docs.selectExpr("doc_id", f"cast(pmod(xxhash64(doc_id, 'label'), 10) < {of_ten} as int) quality")
        scored = quality.score(docs, quality.fit(docs, labels)).toPandas()
        assert abs(scored.score.mean() - of_ten / 10) < 0.12
