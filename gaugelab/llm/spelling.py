"""Spelling variants: words one letter apart, found with a trie over letter-group counts.

A word's vector counts its letters by group (``LEVELS``, a partition of all
letters). One inserted, deleted or replaced letter moves one count up by one, one
down by one, or both, or neither. So a trie whose levels are the groups is
searched depth first with a budget of one letter too many and one too few; the
words of the leaves that are reached are verified letter by letter.

The top levels of the trie are the shuffle key. A word is sent to its own node and
to those above it in the first count that differs, which is one side of each
pair; as many levels are taken as leave no node more than ``SHARD_WORDS`` words
(words whose vectors agree in all groups stay together). In a leaf, words are
looked up by their first and by their last half, one of which an edit leaves
alone, so that a large leaf is not compared in full.

A word's form is its most frequent near word (ties: the first in code-point
order) if that is ``TIMES`` as frequent; its root is where the forms lead to.
Counts grow along the forms, so they end.

Cases: null and empty texts have no words; a null id is an empty text where
letters are dropped; very long runs of letters are words like others; repeated
documents count again; empty tables give no rows; further columns are left out.
Equal runs within a slice of text are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx
from gaugelab.storage import written

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10

#: Letters that are counted together, level by level; the last level is all others.
LEVELS = ("ea", "iou", "nr", "ts", "l", "d", "hk", "c", "m", "pg", "bfv", "wyjqxz")
DEPTH = len(LEVELS) + 1
LEAST_TOP = 3
SHARD_WORDS = 100_000
#: Nodes with at most so many words are searched as one leaf.
LEAF_WORDS = 64

_HELD_WORDS = 400_000
_LONG_RUN = 64
_letters = np.arange(256)
_ASCII = ((_letters >= 65) & (_letters <= 90)) | ((_letters >= 97) & (_letters <= 122))


def _crc_steps() -> np.ndarray:
    """What each byte does to a CRC-32 (reflected, polynomial 0xEDB88320)."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> np.uint32(1)) ^ np.uint32(0xEDB88320), steps >> np.uint32(1))
    return steps


_CRC = _crc_steps()


def crc_after(before: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of a beginning, whose own CRC is given, followed by data[start:end]."""
    out = np.empty(len(starts), np.uint32)
    lengths = ends - starts
    for i in np.flatnonzero(lengths > _LONG_RUN).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    short = np.flatnonzero(lengths <= _LONG_RUN)
    short = short[np.argsort(-lengths[short], kind="stable")]
    state, at, left = ~before[short], starts[short], lengths[short]
    for j in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -j, side="left"))  # those longer than j
        now = state[:live]
        state[:live] = _CRC[(now ^ data[at[:live] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out[short] = ~state
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and code points of the maximal runs [A-Za-z\\u00C0-\\u00FF]+."""
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = inside[starts]
    starts, ends = starts[keep], ends[keep]
    leads = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, ends - starts - (leads[ends] - leads[starts])


def _count_slice(ids: list, column: pa.Array, drop_every: int, counts: Counter) -> None:
    data, offsets = tx.text_buffer(column)
    if not len(data):
        return
    starts, ends, row, length = letter_runs(data, offsets)
    keep = length >= LEAST_LENGTH
    starts, ends, row, length = starts[keep], ends[keep], row[keep], length[keep]
    low = tx.LOWER[data]
    if drop_every:
        before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = crc_after(before[row], low, starts, ends)
        dropped = crc % np.uint32(drop_every) == 0
        for i in np.flatnonzero(dropped & (length > LEAST_LENGTH)).tolist():
            word = low[starts[i] : ends[i]].tobytes().decode()
            at = int(crc[i]) % len(word)
            counts[word[:at] + word[at + 1 :]] += 1
        starts, ends = starts[~dropped], ends[~dropped]
    _, first, n = np.unique(tx.word_hashes(data, starts, ends), return_index=True, return_counts=True)
    whole = low.tobytes()
    for a, b, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist()):
        counts[whole[a:b].decode()] += k


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", drop_every: int = 0) -> DataFrame:
    """word and n (occurrences) of the words of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences or more, A-Z lower-cased.

    With ``drop_every``, each run whose CRC-32, behind the id and a colon, is
    divisible by it loses the letter that the CRC points at: misspellings dealt
    out over the corpus, the same in every run.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for whole in batches:
            for part in tx.slices(whole, "text"):
                _count_slice(part.column(0).to_pylist(), part.column(1), drop_every, counts)
                if len(counts) > _HELD_WORDS:
                    yield batch()
                    counts.clear()
        if counts:
            yield batch()

    texts = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).where("text is not null")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def vector() -> Column:
    """Letter-group counts of the column ``word``, a number a level."""
    size = F.length("word")
    counts = [size - F.length(F.translate("word", letters, "")) for letters in LEVELS]
    known = "".join(LEVELS)
    return F.array(*counts, F.length(F.translate("word", known, "")))


def top_levels(vectors: DataFrame, limit: int = SHARD_WORDS) -> int:
    """The fewest top levels that leave no node more than ``limit`` words, or all."""
    for top in range(LEAST_TOP, DEPTH):
        largest = vectors.groupBy(F.slice("vector", 1, top).alias("node")).count().agg(F.max("count")).first()[0]
        if largest is None or largest <= limit:
            return top
    return DEPTH


def sent(vectors: DataFrame, top: int) -> DataFrame:
    """One row per word and top node it is looked up at: node, word, n, vector, home and the budget (up, down) left.

    Of a pair, the word with the smaller first differing count travels.
    """
    moves = [(-1, -1), *[(i, -1) for i in range(top)], *[(i, j) for i in range(top) for j in range(i + 1, top)]]
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in moves])
    moved = lambda c, k: (c + (k == F.col("i")).cast("int") - (k == F.col("j")).cast("int")).cast("string")
    node = F.concat_ws(",", F.transform(F.slice("vector", 1, top), moved))
    rows = vectors.select("*", F.inline(each)).select(
        node.alias("node"), "word", "n", "vector", (F.col("i") < 0).alias("home"), (F.col("i") < 0).cast("int").alias("up"), (F.col("j") < 0).cast("int").alias("down")
    )
    # A count below zero is no node: nothing lives there.
    return rows.where("not contains(node, '-')")


def _leaves(residents: np.ndarray, queries: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Depth-first search of the trie of ``residents`` (vectors in order): range of residents and the queries that reach it."""
    stack = [(0, 0, len(residents), np.arange(len(queries)), up, down)]
    while stack:
        level, lo, hi, who, more, less = stack.pop()
        if level == residents.shape[1] or hi - lo <= LEAF_WORDS:
            yield lo, hi, who
            continue
        column = residents[lo:hi, level]
        begins = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        ends = np.append(begins[1:], hi - lo)
        have = queries[who, level]
        for a, b in zip(begins.tolist(), ends.tolist()):
            step = int(column[a]) - have
            fits = (step == 0) | ((step == 1) & (more > 0)) | ((step == -1) & (less > 0))
            if fits.any():
                d = step[fits]
                stack.append((level + 1, lo + a, lo + b, who[fits], more[fits] - (d == 1), less[fits] - (d == -1)))


def _halves(words: list[str]) -> np.ndarray:
    """Per word the hashes of first and last half, as one of two equally long words or the shorter one, then as the longer one."""
    out = np.empty((len(words), 4), np.int64)
    for i, w in enumerate(words):
        m = len(w)
        h, g = m // 2, (m - 1) // 2
        out[i] = hash((m, 0, w[:h])), hash((m, 1, w[h:])), hash((m - 1, 0, w[:g])), hash((m - 1, 1, w[g + 1 :]))
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells the words apart."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def _matches(held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal values."""
    order = np.argsort(held, kind="stable")
    low, high = np.searchsorted(held[order], asked, "left"), np.searchsorted(held[order], asked, "right")
    n = high - low
    q = np.repeat(np.arange(len(asked)), n)
    return order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], q


#: Columns of ``_halves`` that may meet: equally long, the asking word longer, the held word longer.
_MEET = ((0, 0), (1, 1), (0, 2), (1, 3), (2, 0), (3, 1))


def near_pairs(words: list[str], vectors: np.ndarray, home: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words, each once: of a word at home with another at home or with one sent here."""
    residents = np.flatnonzero(home)
    if vectors.shape[1]:
        residents = residents[np.lexsort(vectors[residents].T[::-1])]
    halves = _halves(words)
    left, right = [], []
    for lo, hi, who in _leaves(vectors[residents], vectors, up, down):
        here = residents[lo:hi]
        pairs = []
        for mine, theirs in _MEET:
            r, q = _matches(halves[here, mine], halves[who, theirs])
            pairs.append(np.stack([here[r], who[q]]))
        a, b = np.concatenate(pairs, axis=1)
        once = (a < b) | ~home[b]
        found = np.unique(a[once] * len(words) + b[once])
        a, b = found // len(words), found % len(words)
        true = [one_edit(words[i], words[j]) for i, j in zip(a.tolist(), b.tolist())]
        left.append(a[true])
        right.append(b[true])
    return np.concatenate(left or [residents[:0]]), np.concatenate(right or [residents[:0]])


_FOUND = "word string, n_near long, near_n long, near string"


def near_words(words: DataFrame, limit: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, near_n and near (the most frequent near word) of words that have any."""
    vectors = written(words.select("word", "n", vector().alias("vector")), "vectors")

    def solve(rows: pa.Table) -> pa.Table:
        none = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())]).empty_table()
        home = rows.column("home").to_numpy()
        if rows.num_rows < 2 or not home.any():
            return none
        word, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        counts = np.array(rows.column("vector").combine_chunks().flatten()).reshape(len(word), DEPTH)[:, top:]
        a, b = near_pairs(word, counts, home, rows.column("up").to_numpy(), rows.column("down").to_numpy())
        if not len(a):
            return none
        order = sorted(range(len(word)), key=lambda i: (-n[i], word[i]))
        rank = np.empty(len(word), np.int64)
        rank[order] = np.arange(len(word))
        best = np.full(len(word), len(word))
        np.minimum.at(best, a, rank[b])
        np.minimum.at(best, b, rank[a])
        near = np.bincount(a, minlength=len(word)) + np.bincount(b, minlength=len(word))
        hit = np.flatnonzero(near)
        chosen = [order[i] for i in best[hit].tolist()]
        return pa.table([pa.array([word[i] for i in hit.tolist()]), pa.array(near[hit]), pa.array(n[chosen]), pa.array([word[i] for i in chosen])], none.schema)

    top = top_levels(vectors, limit)
    found = sent(vectors, top).groupBy("node").applyInArrow(solve, _FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word with a form: each round doubles how far a word has followed."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(words: DataFrame, limit: int = SHARD_WORDS, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of a table of distinct words with their counts ``n``."""
    words = written(words.select("word", "n"), "words")
    known = words.join(near_words(words, limit), "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    judged = written(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
