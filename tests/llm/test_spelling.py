from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from gaugelab.llm import spelling

SMALL_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def brute_counts(rows, every=0) -> dict[str, int]:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if every and h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def edits(word: str, alphabet) -> set[str]:
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    near = {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in alphabet} | {a + c + b for a, b in cut for c in alphabet}
    return near - {word}


def brute_variants(counts: dict[str, int], near_of=None) -> set[tuple]:
    alphabet = {c for w in counts for c in w}
    form, out = {}, []
    for w, n in counts.items():
        near = near_of(w) if near_of else [v for v in edits(w, alphabet) if v in counts]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * n:
            form[w] = best
        out.append((w, len(near)))
    rows = set()
    for w, n_near in out:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, counts[w], n_near, counts[form[w]] if w in form else None))
    return rows


def found(frame) -> set[tuple]:
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    counts = brute_counts(rows, 31)
    made = spelling.word_counts(docs, drop_every=31)
    assert {r["word"]: r["n"] for r in made.collect()} == counts
    answer = brute_variants(counts)
    assert found(spelling.variants(made)) == answer
    assert sum(r[1] is not None for r in answer) >= 5


def test_random_words_and_splits(spark):
    draw = random.Random(1)
    letters = "eianxéÀß"
    words = {"".join(draw.choice(letters[: draw.choice([2, 3, 8])]) for _ in range(draw.randint(7, 9))) for _ in range(1500)}
    counts = {w: 2 * 11 ** draw.randint(0, 4) for w in words}
    answer = brute_variants(counts)
    assert found(spelling.variants(table(spark, counts))) == answer
    assert found(spelling.variants(table(spark, counts), limit=40)) == answer  # more levels in the key
    assert found(spelling.variants(table(spark, counts), limit=1)) == answer  # all levels
    assert any(r[1] is not None and r[1] != r[2] for r in answer)


def test_search_with_small_leaves(spark, monkeypatch):
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("eatsl") for _ in range(draw.randint(7, 8))) for _ in range(600)})
    counts = np.array([[sum(c in g for c in w) for g in spelling.LEVELS] + [0] for w in words])
    everyone = np.ones(len(words), bool)
    budget = np.ones(len(words), np.int32)
    pairs = {(a, b) for a, w in enumerate(words) for b in range(a + 1, len(words)) if spelling.one_edit(w, words[b])}
    for leaf in (1, 64, 10_000):
        monkeypatch.setattr(spelling, "LEAF_WORDS", leaf)
        a, b = spelling.near_pairs(words, counts, everyone, budget, budget)
        assert len(a) == len(pairs) and {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == pairs


def test_one_edit():
    draw = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randint(1, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == (b in edits(a, "ab") and a != b), (a, b)


def test_checksum():
    draw = random.Random(6)
    texts = [bytes(draw.randrange(256) for _ in range(draw.choice([0, 1, 7, 40, 64, 65, 500]))) for _ in range(200)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(200)], np.uint32)
    assert spelling.crc_after(before, data, starts, ends).tolist() == [zlib.crc32(b"%d:" % i + t) for i, t in enumerate(texts)]


CASES = [
    (None, "Grösste grösste GRÖSSTE grösstes"), (1, None), (2, ""), (3, "12 34 ... -"), (4, "×÷×÷×÷× ×÷×÷×÷×"), (5, "letter" + "s" * 100_000 + " letter" + "s" * 100_001), (5, "letter" + "s" * 100_000 + " letter" + "s" * 100_001),
    (6, "ending"), (6, "endings"), (7, "endings endings"), (8, "Ａｆｕｌｌｗｉｄｔｈ naïveté—naïveté ŁódźŁódź"), (9, "abcdefg" * 3 + "İabcdefgh abcdefgh"),
]


def test_cases(spark):
    docs = spark.createDataFrame([(*r, "w", 7) for r in CASES], DOCS + ", word string, n int").repartition(3)
    for every in (0, 1, 3):
        counts = brute_counts(CASES, every)
        made = spelling.word_counts(docs, drop_every=every)
        assert {r["word"]: r["n"] for r in made.collect()} == counts
        # Words of 100,000 letters have too many edits to list; test_one_edit checks the comparison.
        assert found(spelling.variants(made)) == brute_variants(counts, lambda w: [v for v in counts if spelling.one_edit(v, w)])  # noqa: B023
    assert spelling.variants(spelling.word_counts(docs.limit(0))).count() == 0
