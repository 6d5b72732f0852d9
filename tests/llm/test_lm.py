from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gaugelab.llm import lm, queries

SMALL_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2:
            train.update([*split(t), None])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tokens = [*split(t), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2, len(tokens), sum(train[w] > 0 for w in tokens), n, base))
    return out


@pytest.mark.parametrize("frequent, part", [(1 << 20, 16 << 20), (500, 200_000)])
def test_exact_columns_and_gain(spark, monkeypatch, frequent, part):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "PART_BYTES", part)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL_DIR}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_model_scores"](spark, SMALL_DIR).collect()}
    assert len(got) == len(rows)
    for i, held, n, known, total, base in brute(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_filter_reads_counts_back():
    draw = np.random.default_rng(1)
    keys = draw.integers(1, 2**32, 20000).astype(np.uint64)
    keys = np.unique(keys)
    counts = np.maximum(1, (draw.pareto(0.7, len(keys)) * 2).astype(np.int64))
    segment = lm._segment(keys, counts, 1 << 30)
    model = lm.Model(1, segment, np.array([0]), np.array([len(segment) * 8 - 1], np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1)
    got = model.read(keys, keys)
    want = lm.LEVEL_VALUES[lm.levels(counts)]
    assert (got >= want).all() and (got == want).mean() > 0.98
    other = np.setdiff1d(draw.integers(1, 2**32, 20000).astype(np.uint64), keys)
    assert (model.read(other, other) > 0).mean() < 0.02


def test_levels():
    for c in range(1, 5000):
        q = int(lm.levels(np.array([c]))[0])
        assert lm.LEVEL_BASE ** (q - 1) <= c * (1 + 1e-9) and c < lm.LEVEL_BASE**q
        assert abs(lm.LEVEL_VALUES[q] - c) <= 0.25 * c + 0.5


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 100000), (3, "word " * 100000), (None, "word other"), (4, "WORD\tÉ\x0bé"), (9, " ")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = sorted(tuple(r) for r in lm.score(df.where("doc_id is not null")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect())
    want = sorted(brute([r for r in rows if r[0] is not None]))
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5])
    assert lm.score(df).count() == len(rows)
    assert lm.score(df.limit(0)).count() == 0
    alone = lm.score(df.where("crc32(cast(doc_id as string)) % 7 = 2")).collect()
    assert all(r.base_score == 0 and r.n_known == 0 for r in alone)


def test_tokens():
    word, text, before = lm.tokens(pa.array(["a b", None, "", "A"]))
    assert text.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert word[0] == word[5] == before[1] and before[0] == lm.END and (word[[2, 3, 4, 6]] == lm.END).all()


@pytest.mark.parametrize("docs", [2000, 16000])
def test_filter_grows_with_the_entries(spark, monkeypatch, docs):
    """Bits an entry and false hits are the same at each size, down to parts far below what once was the bound."""
    monkeypatch.setattr(lm, "PART_BYTES", 100_000)
    monkeypatch.setattr(lm, "MAX_FILTER_BYTES", 50_000, raising=False)
    draw = np.random.default_rng(docs)
    rows = [(i, " ".join(f"w{k}" for k in draw.integers(0, 3000, 50))) for i in range(docs)]
    _, counted = lm.fit(spark.createDataFrame(rows * 2, "doc_id long, text string"))
    read = [r for r in counted.select("segment", "n_entries").collect()]
    for r in read:
        assert 8 * len(r.segment) >= lm.BITS_PER_ENTRY * r.n_entries
    found = lm.figures(counted).first()
    assert found.bits_an_entry >= lm.BITS_PER_ENTRY and found.false_hits < 0.006


def test_pair_counts_reach_the_score(spark, monkeypatch):
    """Scores from counts by brute force, with many parts and more slices than one."""
    monkeypatch.setattr(lm, "PART_BYTES", 20_000)
    monkeypatch.setattr(lm, "FREQUENT", 100)
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in draw.zipf(1.3, 60) % 4000)) for i in range(3000)]
    singles, pairs, n = Counter(), Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            tokens = [None, *split(t), None]
            singles.update(tokens[1:])
            pairs.update(zip(tokens, tokens[1:]))
            n += len(tokens) - 1
    level = lambda c: lm.LEVEL_VALUES[int(lm.levels(np.array([c]))[0])] if c else 0.0
    want = {}
    for i, t in rows:
        tokens, total = [None, *split(t), None], 0.0
        for v, w in zip(tokens, tokens[1:]):
            c_v, c = level(singles[v]), pairs[v, w]
            weight = lm.LAMBDA if c_v else 0.0
            seen = min(level(c if c >= lm.PAIR_LEAST else 0), c_v) / max(c_v, 1)
            total += math.log10(weight * seen + (1 - weight) * (level(singles[w]) + 1) / (n + len(singles) + 1))
        want[i] = total
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    off = np.array([abs(got[i] - want[i]) for i, _ in rows])
    assert np.median(off) < 0.05 and off.mean() < 0.2 and all(got[i] >= want[i] - 1e-6 for i, _ in rows)


def test_pairs_seen_once_count(spark):
    """A text of pairs that each occur once in training scores higher than the same words in an order never seen."""
    words = [f"w{k}" for k in range(400)]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    train = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(train, " ".join(words)), (held[0], " ".join(words[100:300])), (held[1], " ".join(words[100:300][::-1]))]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Each word and each pair of the training text has a count of 1.
    seen, unseen = (math.log10(x + (1 - lm.LAMBDA) * 2 / (401 + 401 + 1)) for x in (lm.LAMBDA, 0))
    assert got[held[0]] == pytest.approx(199 * seen + 2 * unseen, abs=0.1)
    assert got[held[1]] < got[held[0]] - 100
