from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from gaugelab.llm import queries, repeats, suffix_array

SMALL_DIR = "/root/testdata/sf0.001"


def brute(texts, length):
    """Per text: bytes, removed, spans, digest; every string of the length counted one by one."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, many):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, 6)))
    passages = [" ".join(word() for _ in range(draw.choice([3, 12, 30, 80]))) for _ in range(12)]
    texts = []
    for _ in range(many):
        parts = [draw.choice(passages) if draw.random() < 0.5 else " ".join(word() for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(0, 6))]
        texts.append(draw.choice([" ", "\n", ""]).join(parts))
    texts += ["x" * n for n in (39, 40, 41, 300)] + ["ab" * 100, "", None, texts[0], texts[1], texts[1]]
    return texts


@pytest.mark.parametrize("length, most, part, shard", [(40, 4096, 16 << 20, 8 << 20), (40, 2, 3000, 2000), (7, 3, 10000, 1000), (200, 4096, 16 << 20, 8 << 20)])
def test_against_brute_force(spark, monkeypatch, length, most, part, shard):
    monkeypatch.setattr(repeats, "MOST_TEXTS", most)
    monkeypatch.setattr(repeats, "PART_BYTES", part)
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    texts = made(length + most, 120)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in repeats.removed(df, length=length).collect()}
    for i, want in enumerate(brute(texts, length)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == want, i
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_documents(spark):
    rows = spark.read.parquet(f"{SMALL_DIR}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op2_repeated_strings"](spark, SMALL_DIR).collect()}
    assert got == {r.doc_id: want for r, want in zip(rows, brute([r.text for r in rows], 200))}


def test_edge_cases(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(50000))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (None, long[100:]), (5, "y" * 500), (6, long[:250] + "é"), (6, long[:250] + "é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.removed(df).collect())
    want = sorted((r[0] or 0, *b) for r, b in zip(rows, brute([r[1] for r in rows], 200)))
    assert got == want
    assert repeats.removed(df.limit(0)).count() == 0
    assert repeats.removed(df.where("doc_id < 4")).agg({"n_removed": "sum"}).first()[0] == 0


def test_suffix_arrays(monkeypatch):
    draw = np.random.default_rng(1)
    monkeypatch.setattr(suffix_array, "SHORT", 8)
    for _ in range(400):
        n, letters = int(draw.integers(1, 120)), int(draw.integers(1, 5))
        monkeypatch.setattr(suffix_array, "FEW_LETTERS", int(draw.integers(0, 9)))
        body = draw.integers(1, letters + 1, n)
        s = np.append(np.tile(body, 3) if draw.random() < 0.3 else body, 0)
        data = s.tolist()
        order = suffix_array.suffix_array(s, letters + 1)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = suffix_array.common_prefixes(s, order, 20, stride=int(draw.integers(1, 9)))
        for j in range(1, len(s)):
            a, b = data[order[j - 1] :], data[order[j] :]
            k = next((k for k in range(min(len(a), len(b), 20)) if a[k] != b[k]), min(len(a), len(b), 20))
            assert shared[j] == k


@pytest.mark.parametrize("length", [7, 40, 200])
def test_blocks_do_not_depend_on_stretches(monkeypatch, length):
    data = [(t or "").encode() for t in made(length, 60)]
    offsets = np.cumsum([0, *map(len, data)])
    whole = np.frombuffer(b"".join(data), np.uint8)
    wanted = repeats.blocks(whole, offsets, length)
    assert len(wanted["n"]) > 100
    for stretch in (1, 500, 3001):
        monkeypatch.setattr(repeats, "STRETCH", stretch)
        got = repeats.blocks(whole, offsets, length)
        assert all(np.array_equal(got[k], wanted[k]) for k in wanted)


def test_blocks_hold_little():
    """The search for blocks holds a stretch at a time, also within one long text."""
    data = np.random.default_rng(3).integers(97, 123, 4 << 20).astype(np.uint8)
    for offsets in (np.array([0, len(data)]), np.append(np.arange(0, len(data), 2000), len(data))):
        tracemalloc.start()
        found = repeats.blocks(data, offsets)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found["n"].sum() == (np.diff(offsets) - repeats.LENGTH + 1).clip(0).sum()
        assert most < 30 * len(data)
