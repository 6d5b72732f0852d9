from __future__ import annotations

import math

from gaugelab.llm import bpe, token_counts

SMALL_DIR = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet")
    machine = bpe.automaton()
    lengths = sorted(len(machine.encode(r.text or "")) for r in docs.collect())
    sums = token_counts.suffix_sums(token_counts.histogram(docs))
    rows = {r.n_tokens: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for x, r in rows.items():
        assert r.n_docs == lengths.count(x)
        assert r.docs_at_least == sum(n >= x for n in lengths)
        assert r.tokens_at_least == sum(n for n in lengths if n >= x)
        assert r.docs_up_to == sum(n <= x for n in lengths)
        assert r.truncated_total == sum(min(n, x) for n in lengths)
        assert (r.all_docs, r.all_tokens) == (len(lengths), sum(lengths))
    limits = [0, 1, 100, 512, 4096, 10**9]
    for x, r in zip(limits, token_counts.at_limits(sums, limits).collect()):
        assert (r.context_limit, r.tokens_left, r.docs_cut) == (x, sum(min(n, x) for n in lengths), sum(n > x for n in lengths))
        assert r.tokens_lost == sum(max(n - x, 0) for n in lengths)
    for r in token_counts.quantiles(sums, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        assert r.n_tokens == lengths[max(1, math.ceil(r.share * len(lengths))) - 1]


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a", 7), (3, "a", 7), (None, "a" * 9000, 7)], "doc_id long, text string, n_tokens int")
    rows = {r.n_tokens: r for r in token_counts.suffix_sums(token_counts.histogram(docs)).collect()}
    assert rows[0].n_docs == 2 and rows[1].n_docs == 2 and len(rows) == 3
    none = token_counts.suffix_sums(token_counts.histogram(docs.limit(0)))
    assert none.count() == 0
    assert token_counts.at_limits(none, [5]).collect()[0].tokens_left == 0
    assert token_counts.quantiles(none, [0.5]).collect()[0].n_tokens is None
