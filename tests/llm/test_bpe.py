"""The automaton against the public library, on texts of all kinds."""

from __future__ import annotations

import hashlib
import random

import pytest

from gaugelab.llm import bpe

SMALL_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


def samples() -> list[str]:
    draw = random.Random(5)
    letters = ["a", "b", "e", " ", "  ", "\n", "th", "the", "ing", "'s", "'ll", "é", "ß", "日本", "😀", "9", "12", ".", "!!", "***", "\t", " ", " ", "\x1c", "\x85", "aaaa", "<|endoftext|>", "<|endof", "İ", "²", "́"]
    made = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    made += [chr(c) + "a " + chr(c) + chr(c) + "1" for c in [*range(0, 0xD800), *range(0xE000, 0x11000, 3)]]
    made += ["a" * n for n in range(1, 90)] + [" " * n + "x" for n in range(40)] + ["", "x" * 5000]
    return made


def test_ids_and_text_equal_the_library(library):
    machine = bpe.automaton()
    texts = samples()
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = machine.encode(text)
        assert got == want.ids, repr(text)
        assert machine.decode(got) == library.decode(want.ids, skip_special_tokens=False), repr(text)


def test_documents_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL_DIR}/documents.parquet")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "same", None), (2, "same", None), (3, "long " * 30000, "z")], "doc_id long, text string, token_ids string")
    rows = bpe.digests(docs).collect()
    assert [r.n_tokens for r in rows][:2] == [0, 0] and rows[2] == rows[3]
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[0].ids_sha256 == rows[0].decoded_sha256 == empty
    back = bpe.decode(bpe.encode(docs)).select("text").collect()
    assert [r.text for r in back] == ["", "", "same", "same", "long " * 30000]
    assert bpe.digests(docs.limit(0)).count() == 0
    assert [r.n_tokens for r in bpe.lengths(docs).collect()][2:4] == [1, 1]
