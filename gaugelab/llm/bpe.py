"""Byte-pair encoding as a tokenization automaton.

The automaton has a start state and one state per token, entered by the arc that
emits the token. It begins with the byte tokens, every byte arc leaving every
state. Each merge (u, v) -> w adds one gadget, in merge order:

* arc w leaves every state that arc u leaves,
* the new state w gets the arcs that leave state v,
* arc v no longer leaves state u.

What remains are exactly the token sequences that byte-pair encoding produces,
one per byte string and hence one per prefix of it. Encoding a word therefore
keeps a single state per byte position: the arc that ends there and leaves the
state where it begins. Arcs are settled from the gadgets when first asked for
and then kept in a table. Decoding emits the byte labels of the arcs.

The tables of a worker are bounded: words and arcs beyond a fixed number start
them afresh, which costs time and never changes a result.

Cases: a null or empty text has no tokens and decodes to an empty text; strings
of added tokens in a text become these tokens, as in the file's own library; a
byte that is no token makes a vocabulary invalid; repeated documents and further
columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx

#: Fixed value: the pattern that splits a text into words before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cuts for texts of these characters alone, all of them plainly letter, digit, sign or space; found several times faster.
WESTERN = r"[\t\n\r -~À-ÖØ-öø-ɏ]*"
WESTERN_SPLIT = r" ?[a-zA-ZÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+"
KEPT_WORDS = 400_000
KEPT_ARCS = 2_000_000
KEPT_LENGTH = 64
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Path of a public vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return letters


class _Words(dict):
    """Encoded words of the automaton; a missing one is encoded and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str):
        ids = self.encode(word.encode())
        made = (ids, ",".join(map(str, ids)))
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = made
        return made


class Automaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        to_byte = {c: b for b, c in enumerate(byte_letters())}
        self.labels: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.labels[i] = bytes(to_byte[c] for c in token)
        self.tokens = {label: model["vocab"][token] for token, label in ((t, self.labels[i]) for t, i in model["vocab"].items())}
        self.longest = max(map(len, self.tokens))
        # For each merged token when its gadget was added and its two parts; a byte is as old as the automaton.
        self.born = [-1] * len(self.labels)
        self.parts: list[tuple[int, int]] = [(-1, -1)] * len(self.labels)
        self.gadget: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            u, v, w = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            if (u, v) not in self.gadget:
                self.gadget[u, v] = k
                if self.born[w] < 0:
                    self.born[w], self.parts[w] = k, (u, v)
        missing = [b for b in range(256) if bytes([b]) not in self.tokens]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.arcs: dict[int, bool] = {}
        self.words = _Words(self.encode_word)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.labels[i] = content.encode()
        self.cut = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.any_split = regex.compile(SPLIT).findall
        self.western, self.western_split = re.compile(WESTERN).fullmatch, re.compile(WESTERN_SPLIT).findall

    def leaves(self, state: int, token: int) -> bool:
        """Whether the arc of ``token`` leaves ``state`` once all gadgets are added.

        The question is taken back in time: to before the younger of the two was
        added, where an arc followed that of its first part and a state was a copy
        of that of its last part. A gadget in between that dropped the arc says no.
        At equal age the pair on the left was merged first, so its gadget counts.
        """
        gadget, born, parts = self.gadget, self.born, self.parts
        until = 1 << 60
        while True:
            k = gadget.get((state, token))
            if k is not None and k < until:
                return False
            if born[token] >= born[state]:
                if born[token] < 0:
                    return True
                until = born[token] + 1
                token = parts[token][0]
            else:
                until = born[state]
                state = parts[state][1]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        tokens, arcs = self.tokens, self.arcs
        whole = tokens.get(word)
        if whole is not None:
            return (whole,)
        if len(arcs) > KEPT_ARCS:
            arcs.clear()
        n, longest, width = len(word), self.longest, len(self.labels)
        states = [-1] * (n + 1)
        begins = [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - longest), end):
                token = tokens.get(word[begin:end])
                if token is None:
                    continue
                if begin:
                    key = states[begin] * width + token
                    known = arcs.get(key)
                    if known is None:
                        known = arcs[key] = self.leaves(states[begin], token)
                    if not known:
                        continue
                states[end], begins[end] = token, begin
                break
        ids = []
        while n:
            ids.append(states[n])
            n = begins[n]
        return tuple(ids[::-1])

    def split(self, text: str) -> list[str]:
        return self.western_split(text) if self.western(text) else self.any_split(text)

    def pieces(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """The encoded words of a text: ids, and the ids as joined text."""
        if self.cut is None or not any(c in text for c in self.added):
            return list(map(self.words.__getitem__, self.split(text)))
        found: list[tuple[tuple[int, ...], str]] = []
        for part in self.cut.split(text):
            if part in self.added:
                found.append(((self.added[part],), str(self.added[part])))
            else:
                found += map(self.words.__getitem__, self.split(part))
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for ids, _ in self.pieces(text)))

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_automata: dict[str, Automaton] = {}


def automaton(path: str | None = None) -> Automaton:
    """The automaton of a vocabulary file, built once per process."""
    path = path or vocabulary_path()
    if path not in _automata:
        _automata[path] = Automaton(path)
    return _automata[path]


def _texts(batch: pa.RecordBatch, column: str):
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py() or ""


def encode(docs: DataFrame, text_column: str = "text", path: str | None = None) -> DataFrame:
    """The documents with a column ``token_ids``, replacing one of that name."""
    kept = docs.drop("token_ids")
    schema = f"{_columns(kept)}, token_ids array<int>"

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            for part in tx.slices(batch, text_column):
                ids = pa.array([machine.encode(t) for t in _texts(part, text_column)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "token_ids"])

    return kept.mapInArrow(run, schema)


def decode(docs: DataFrame, ids_column: str = "token_ids", text_column: str = "text", path: str | None = None) -> DataFrame:
    """The documents with the text that their token ids stand for; null ids give an empty text."""
    kept = docs.drop(text_column)
    schema = f"{_columns(kept)}, `{text_column}` string"

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_column))
            texts = pa.array([machine.decode(i.as_py() or ()) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, text_column])

    return kept.mapInArrow(run, schema)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Per document the number of tokens, a digest of the ids, and a digest of the text decoded from them."""

    def run(batches):
        machine = automaton(path)
        labels = machine.labels.__getitem__
        for batch in batches:
            for part in tx.slices(batch, "text"):
                counts, of_ids, of_text = [], [], []
                for text in _texts(part, "text"):
                    pieces = machine.pieces(text)
                    ids = list(chain.from_iterable([p[0] for p in pieces]))
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join([p[1] for p in pieces]).encode()).hexdigest())
                    decoded = b"".join(map(labels, ids)).decode("utf-8", "replace")
                    of_text.append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def lengths(docs: DataFrame, text_column: str = "text", path: str | None = None) -> DataFrame:
    """The documents with a column ``n_tokens``, replacing one of that name."""
    kept = docs.drop("n_tokens")

    def run(batches):
        machine = automaton(path)
        for batch in batches:
            for part in tx.slices(batch, text_column):
                counts = [sum([len(p[0]) for p in machine.pieces(t)]) for t in _texts(part, text_column)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], [*part.schema.names, "n_tokens"])

    return kept.mapInArrow(run, f"{_columns(kept)}, n_tokens long")
