from __future__ import annotations

import hashlib
import random
import re

import pytest

from gaugelab.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def brute(text: str | None, items: list[tuple[str | None, str | None]]) -> tuple[int, int, int, str, bool]:
    """n_words, n_hit, n_items, items_sha256, contaminated, window by window."""
    w = words(text)
    hit, names = set(), set()
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(name or "")
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def longest(text: str | None, items: list[tuple[str | None, str | None]]) -> int:
    w, best = words(text), 0
    for _, item in items:
        v = words(item)
        n = min(10, len(v))
        for i in range(len(w)):
            for j in range(len(v) - n + 1):
                k = 0
                while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                    k += 1
                if n and k >= n:
                    best = max(best, k)
    return best


def tables(seed: int) -> tuple[list[tuple], list[tuple]]:
    draw = random.Random(seed)
    vocabulary = ["a", "b", "ab", "The", "é", "x9", "Zürich"]
    items: list[tuple] = [(f"i{k}", " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 9, 10, 11, 25])))) for k in range(25)]
    items = [i for i in items if len(words(i[1])) > 2]
    items += [("none", None), ("empty", ""), ("signs", "!? --"), (None, " ".join(vocabulary * 2)), ("twin", items[0][1]), ("Short", "only three here")]
    docs: list[tuple] = [(1, None), (2, ""), (3, "..."), (4, "Only, THREE here!"), (None, items[0][1]), (5, items[0][1]), (5, items[0][1])]
    for k in range(60):
        parts = [draw.choice([" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 12))), draw.choice(items)[1] or "", "plain filler"]) for _ in range(draw.randint(1, 6))]
        docs.append((10 + k, draw.choice([" ", ", ", "\n"]).join(parts)))
    docs.append((99, "some filler words " * 20000 + (items[1][1] or "") + " and on " * 20000))
    return docs, items


def key(row: tuple) -> tuple:
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 64}, {"shard_bytes": 200}])
def test_windows_by_brute_force(spark, options):
    docs, items = tables(5)
    made = contamination.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), **options).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in made), key=key)
    assert got == sorted(((i, *brute(t, items)) for i, t in docs), key=key)
    texts, named = dict(docs), {n or "": words(t) for n, t in items}
    for r in made:
        if r.doc_id is None or r.doc_id == 99:
            continue
        assert r.longest_match == longest(texts[r.doc_id], items), texts[r.doc_id]
        if r.longest_match:  # the match is where it is said to be
            found = words(texts[r.doc_id])[r.longest_at : r.longest_at + r.longest_match]
            item = named[r.longest_item]
            assert any(item[j : j + len(found)] == found for j in range(len(item)))
        else:
            assert r.longest_item is None and r.longest_at is None


def test_clean_keeps_columns_and_all_clean_rows(spark):
    docs, items = tables(6)
    rows = [(i, t, k) for k, (i, t) in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _items long")
    kept = contamination.clean(frame, spark.createDataFrame(items, "item_id string, text string"), block_bytes=100)
    assert kept.columns == frame.columns
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in rows if not brute(r[1], items)[-1])


def test_empty_tables(spark):
    docs, items = tables(7)
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert contamination.clean(documents, benchmark.limit(0)).count() == len(docs)
    assert contamination.report(documents, benchmark.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert contamination.report(documents.limit(0), benchmark).count() == 0
    assert contamination.clean(documents.limit(0), benchmark).columns == documents.columns
