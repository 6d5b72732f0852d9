from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gaugelab.llm import periodic

SMALL_DIR = "/root/testdata/sf0.001"


def brute_runs(words, least=24, power=3):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for p in range(1, n // power + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, power * p):
                best.setdefault((i, j - i + p), p)
            i = j
    return sorted((s, length, p) for (s, length), p in best.items())


def brute_row(doc_id, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def samples():
    draw = random.Random(8)
    for _ in range(150):
        n = draw.randint(0, 160)
        yield [draw.choice("ab" if draw.random() < 0.5 else "abc") for _ in range(n)]
    for _ in range(150):
        out = []
        while len(out) < draw.randint(30, 200):
            root = [draw.choice("abcd") for _ in range(draw.randint(1, 12))]
            out += (root * draw.randint(1, 9))[draw.randint(0, 3) :] + [draw.choice("xyz")] * draw.randint(0, 2)
        yield out
    yield ["a"] * 300
    yield fibonacci(400)
    yield (["a"] * 5 + ["b"]) * 40
    yield ["a"] * 23
    yield ["a"] * 24
    yield list("abcdefgh") * 3
    yield (list("abcdefgh") * 3)[:-1]


def test_runs_of_many_texts_at_once():
    texts = list(samples())
    letters = np.array([ord(c) for t in texts for c in t], np.int64)
    for least, power in ((24, 3), (6, 2), (1, 4)):
        doc, start, length, period = periodic.runs_of(letters, np.array([len(t) for t in texts]), least, power)
        made = [[] for _ in texts]
        for d, *r in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
            made[d].append(tuple(r))
        for t, r in zip(texts, made):
            assert r == sorted(brute_runs(t, least, power), key=lambda r: (r[0], r[2])), "".join(t)


@pytest.mark.parametrize("chunk", [8, 64])
def test_grid_in_small_chunks(monkeypatch, chunk):
    sizes = np.array([0, 5, 24, 100, 23, 77])
    whole = np.concatenate([np.stack(g) for g in periodic._grid(sizes, 24, 3)], axis=1)
    monkeypatch.setattr(periodic, "_GRID_CHUNK", chunk)
    parts = np.concatenate([np.stack(g) for g in periodic._grid(sizes, 24, 3)], axis=1)
    assert (whole == parts).all()
    assert {(24, 8, 0)} <= {(int(sizes[d]), int(p), int(x)) for d, p, x in whole.T}
    # One point at least in every stretch that a run of the period could have.
    for d, p in {(int(d), int(p)) for d, p in whole[:2].T}:
        points = sorted(whole[2][(whole[0] == d) & (whole[1] == p)].tolist())
        step = max(24 - p, 2 * p)
        assert points == list(range(0, int(sizes[d]) - p, step))


def test_grammar_derives_its_text_and_answers_extensions():
    for text in samples():
        if not text:
            continue
        letters = [100, *[ord(c) - 97 for c in text], 101]
        made = periodic.Grammar(np.array(letters), keep_rules=True)
        assert len(made.symbols[-1]) == 1
        names = sorted(set(letters))
        for level in made.symbols:
            assert [names[k] for s in level.tolist() for k in made.expand(s)] == letters
        # Equal rules have one name.
        assert len(set(made.rules.values())) == len(made.rules)
        draw = random.Random(len(text))
        pairs = [(i, j) for i, j in ((draw.randint(1, len(letters) - 1), draw.randint(1, len(letters) - 1)) for _ in range(60)) if i != j]
        x, y = (np.array(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        for step in (1, -1):
            answer = []
            for i, j in pairs:
                k = 0
                while letters[(i + k) if step > 0 else (i - k - 1)] == letters[(j + k) if step > 0 else (j - k - 1)]:
                    k += 1
                answer.append(k)
            assert made.extension(x, y, step).tolist() == answer


CASES = [
    (1, None), (2, ""), (None, "a " * 30), (3, " \t\n\x0b\x0c\r "), (4, "a\x1cb " * 30), (5, "A a " * 30), (6, "é x  " * 30), (6, "b c d " * 12 + "c d " * 15), (6, "b c d " * 12 + "c d " * 15),
    *[(i, " ".join(f"w{(k * k + i) % 50}" for k in range(90 + i))) for i in range(100, 160)], (7, "a " * 3000 + "b c " * 2000),
]


def test_cases(spark):
    docs = spark.createDataFrame([(*c, 1, 2) for c in CASES], "doc_id long, text string, runs int, ID int").repartition(3)
    made = periodic.runs(periodic.with_periodic_tails(docs)).drop("runs")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted((brute_row(*c) for c in CASES), key=key)
    assert periodic.runs(docs.limit(0)).count() == 0


def test_runs_as_listed(spark):
    docs = spark.createDataFrame([("x", "b c d " * 12 + "c d " * 15)], "name string, body string")
    row = periodic.runs(docs, "name", "body").first()
    assert [tuple(r) for r in row["runs"]] == brute_runs(("b c d " * 12 + "c d " * 15).split())


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet")
    short = docs.where("length(text) < 12000")
    made = {r["doc_id"]: tuple(r) for r in periodic.runs(periodic.with_periodic_tails(docs)).drop("runs").collect()}
    rows = [tuple(r) for r in short.select("doc_id", "text").collect()]
    assert len(made) == docs.count()
    assert all(made[i] == brute_row(i, t) for i, t in rows)
    assert sum(made[i][1] > 0 for i, _ in rows) >= 10
