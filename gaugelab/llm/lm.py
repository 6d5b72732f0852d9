"""Language-model scores from a log-frequency Bloom filter.

Training counts of words and word pairs are gathered exactly, in parts of bounded
size: tasks send sorted runs, and each part adds up its own. A part then fills its
segment of the filter: a pair's count c becomes a level q = 1 + floor(log_B(c)), and
the pair is entered once for each level up to q. A segment has ``BITS_PER_ENTRY``
bits for each entry at least, so the filter grows with the corpus; it is never held
in one place. A slice of documents sends each of its distinct pairs to the part that
has the segment, which reads the count back by probing level after level until one
is missing and answers with the level reached.

The model interpolates the pair's relative frequency with the smoothed word
frequency; pair counts come from such probes, word counts are exact and rounded to
the same levels:

    p(w | v) = L * min(c(v,w), c(v)) / c(v) + (1 - L) * (c(w) + 1) / (N + V + 1)

where L = LAMBDA, or 0 where v is unknown; the first word follows the end of a
text. Pairs enter the filter from a count of ``PAIR_LEAST`` on, that is, all of them.

The base score uses exact word counts as they are. The counts of the ``FREQUENT``
most frequent words at most are broadcast; all other words are asked of the parts
that hold their counts, together with the pairs.

Cases: a null or empty text is one token, its end; a null id is never held out;
without training rows every base is 0 (one chance in one); repeated documents
count each time; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx
from gaugelab.storage import written

LEVEL_BASE = 1.5
PROBES = 3
BITS_PER_ENTRY = 16
FREQUENT = 1 << 20
PAIR_LEAST = 1
LAMBDA = 0.4
PART_BYTES = 16 << 20

_U = np.uint64
END = tx.mixed(np.array([0xE2D], dtype=_U))[0]
_LOW = _U(0xFFFFFFFF)


def level_values() -> np.ndarray:
    """The count that each level stands for: the middle of the counts that have it. Level 0 is a count of 0."""
    values = [0.0]
    for q in range(1, 120):
        low, high = math.ceil(LEVEL_BASE ** (q - 1)), math.ceil(LEVEL_BASE**q) - 1
        values.append((low + max(low, high)) / 2)
    return np.array(values)


LEVEL_VALUES = level_values()


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-12).astype(np.int64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, the text of each, and the token before each."""
    data, offsets = tx.text_buffer(column)
    starts, ends, rows = tx.words(data, offsets, tx.SPACED)
    n = len(column)
    out = np.empty(len(starts) + n, _U)
    text = np.empty(len(out), np.int64)
    at = np.arange(len(starts)) + rows
    out[at], text[at] = tx.word_hashes(data, starts, ends), rows
    last = tx.row_starts(rows, n)[1:] + np.arange(n)
    out[last], text[last] = END, np.arange(n)
    before = np.empty(len(out), _U)
    if len(out):
        before[0] = END
        before[1:] = out[:-1]  # after an end follows the first word of the next text, whose context is an end too
    return out, text, before


def pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tx.mixed(before * _U(0x9FB21C651E98DF25) + word)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs."""
    s = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


def _pieces(part: np.ndarray):
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist() if len(part) else []
    return zip(cuts, [*cuts[1:], len(part)])


def _gathered(train: DataFrame, parts: int) -> DataFrame:
    """Counts of some documents as packed runs: part, words and their counts, pairs (last 32 bits) once seen, pairs seen more often and their counts."""
    names = ["part", "words", "word_counts", "once", "pairs", "pair_counts"]

    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                word, _, before = tokens(piece.column(0))
                w, wc = _runs(word)
                p, pc = _runs(pair_hashes(before, word))
                wp, pp = _part(w, parts), _part(p, parts)
                found: dict[int, list[bytes]] = {}
                for a, b in _pieces(wp):
                    found.setdefault(int(wp[a]), [b""] * 5)[:2] = [w[a:b].tobytes(), wc[a:b].astype(np.uint32).tobytes()]
                low = (p & _LOW).astype(np.uint32)
                for a, b in _pieces(pp):
                    one = pc[a:b] == 1
                    found.setdefault(int(pp[a]), [b""] * 5)[2:] = [low[a:b][one].tobytes(), low[a:b][~one].tobytes(), pc[a:b][~one].astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *(pa.array([v[i] for v in found.values()], pa.binary()) for i in range(5))], names)

    return train.mapInArrow(run, "part int, words binary, word_counts binary, once binary, pairs binary, pair_counts binary")


def _positions(keys: np.ndarray, level: np.ndarray, mask: np.ndarray | np.uint64):
    """Bit positions of keys at their levels, probe by probe."""
    h = tx.mixed(keys + level.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    step = (h >> _U(32)) | _U(1)
    for _ in range(PROBES):
        yield h & mask
        h = h + step


def _pair_keys(hashes: np.ndarray) -> np.ndarray:
    """What is entered of a pair, which is known by its part and its last 32 bits."""
    return (hashes & _LOW) * _U(2) + _U(1)


def _segment(keys: np.ndarray, counts: np.ndarray, most_bits: int = 1 << 62) -> np.ndarray:
    """A part's segment of the filter, a power of two of bits; by default as many as its entries ask for."""
    q = levels(counts) if len(counts) else np.zeros(0, np.int64)
    wanted = max(64, int(q.sum()) * BITS_PER_ENTRY)
    bits = min(1 << (wanted - 1).bit_length(), 1 << (max(64, most_bits).bit_length() - 1))
    held = np.zeros(bits, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        reach = keys[q >= level]
        for position in _positions(reach, np.full(len(reach), level), _U(bits - 1)):
            held[position] = True
    return np.packbits(held, bitorder="little")


def _counted(runs: DataFrame, parts: int) -> DataFrame:
    """Per part: exact word counts, packed and sorted, the segment of the filter and how many entries it has."""

    def run(batches):
        for rows in tx.row_groups(batches, ["part"]):
            def column(name, kind):
                return [np.frombuffer(v.as_buffer(), kind) for v in rows.column(name)]

            words, counts = _added(column("words", _U), [c.astype(np.int64) for c in column("word_counts", np.uint32)])
            once, more = column("once", np.uint32), column("pairs", np.uint32)
            pairs, pair_counts = _added([*once, *more], [*(np.ones(len(o), np.int64) for o in once), *(c.astype(np.int64) for c in column("pair_counts", np.uint32))])
            pairs, pair_counts = pairs[pair_counts >= PAIR_LEAST].astype(_U), pair_counts[pair_counts >= PAIR_LEAST]
            segment = _segment(_pair_keys(pairs), pair_counts)
            yield pa.RecordBatch.from_arrays(
                [rows.column("part")[:1].combine_chunks(), pa.array([words.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([segment.tobytes()], pa.binary()), pa.array([len(words)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([int(levels(pair_counts).sum())], pa.int64())],
                ["part", "words", "counts", "segment", "n_words", "n_tokens", "n_entries"],
            )

    return runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "part int, words binary, counts binary, segment binary, n_words long, n_tokens long, n_entries long")


def _frequent(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words from the lowest count on that at most ``most`` words reach, sorted by hash, with their counts."""
    share = math.log(1.02)

    def sizes(batches):
        for batch in batches:
            for blob in batch.column(0):
                grade = np.floor(np.log(np.frombuffer(blob.as_buffer(), np.int64)) / share).astype(np.int64)
                g, n = np.unique(grade, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], ["grade", "n"])

    # A grade is a range of counts, of which there are a few thousand at any size.
    graded = counted.select("counts").mapInArrow(sizes, "grade long, n long").groupBy("grade").agg(F.sum("n").alias("n")).collect()
    least, held = 1 << 62, 0
    for row in sorted(graded, reverse=True):
        if held + row.n > most:
            break
        least, held = row.grade, held + row.n

    def picked(batches):
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1)):
                c = np.frombuffer(counts.as_buffer(), np.int64)
                keep = np.floor(np.log(c) / share).astype(np.int64) >= least
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(words.as_buffer(), _U)[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], ["words", "counts"])

    rows = counted.select("words", "counts").mapInArrow(picked, "words binary, counts binary").collect()
    words = np.concatenate([np.zeros(0, _U), *(np.frombuffer(r.words, _U) for r in rows)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.counts, np.int64) for r in rows)])
    order = np.argsort(words)
    return words[order], counts[order]


@dataclass
class Model:
    """The segments of the filter that are at hand, the frequent words, and the totals."""

    parts: int
    bits: np.ndarray
    begin: np.ndarray
    mask: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    n: int
    v: int

    def read(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts by repeated probes: the value of the highest level up to which all are there."""
        return LEVEL_VALUES[self.reached(hashes, keys)]

    def reached(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which all are there."""
        part = _part(hashes, self.parts)
        reached = np.zeros(len(keys), np.int64)
        going = np.arange(len(keys))
        level = 0
        while len(going):
            level += 1
            begin, mask = self.begin[part[going]], self.mask[part[going]]
            here = np.ones(len(going), bool)
            for position in _positions(keys[going], np.full(len(going), level), mask):
                at = begin + (position >> _U(3)).astype(np.int64)
                here &= (self.bits[at] >> (position & _U(7)).astype(np.uint8)) & 1 == 1
            going = going[here]
            reached[going] = level
            if level >= len(LEVEL_VALUES) - 1:
                break
        return reached

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of frequent words, -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], -1)

    def log_probabilities(self, c_word: np.ndarray, c_before: np.ndarray, c_pair: np.ndarray) -> np.ndarray:
        """log10 p of each token after the one before it."""
        weight = np.where(c_before > 0, LAMBDA, 0.0)
        seen = np.minimum(c_pair, c_before) / np.maximum(c_before, 1)
        return np.log10(weight * seen + (1 - weight) * (c_word + 1) / (self.n + self.v + 1))


_NO_WORDS, _NO_COUNTS = np.zeros(0, _U), np.zeros(0, np.int64)


def _one_segment(segment: np.ndarray) -> Model:
    return Model(1, segment, np.zeros(1, np.int64), np.array([len(segment) * 8 - 1], _U), _NO_WORDS, _NO_COUNTS, 0, 0)


def held_out(id_column: str, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds == fold


def fit(train: DataFrame, text_column: str = "text") -> tuple[Model, DataFrame]:
    """The totals and frequent words of all documents given, and by part the exact word counts and the filter."""
    texts = train.select(F.col(text_column).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / PART_BYTES))
    counted = written(_counted(_gathered(texts, parts), parts), "counts")
    totals = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    words, counts = _frequent(counted, FREQUENT)
    return Model(parts, np.zeros(0, np.uint8), _NO_COUNTS, _NO_WORDS, words, counts, int(totals[0]), int(totals[1])), counted


def figures(counted: DataFrame) -> DataFrame:
    """Entries of the filter, bits an entry, and the share of absent pairs that pass the first level."""

    def run(batches):
        for batch in batches:
            for segment, n in zip(batch.column(0), batch.column(1)):
                bits = np.frombuffer(segment.as_buffer(), np.uint8)
                share = (np.bitwise_count(bits).sum() / (8 * len(bits))) ** PROBES
                yield pa.RecordBatch.from_arrays([pa.array([n.as_py()], pa.int64()), pa.array([8 * len(bits)], pa.int64()), pa.array([float(share)])], ["entries", "bits", "share"])

    # Parts get equal shares of the absent pairs.
    by_part = counted.select("segment", "n_entries").mapInArrow(run, "entries long, bits long, share double")
    return by_part.agg(F.sum("entries").alias("entries"), (F.sum("bits") / F.sum("entries")).alias("bits_an_entry"), F.avg("share").alias("false_hits"))


def _sliced(texts: DataFrame) -> DataFrame:
    """The documents in slices, each packed and with a name of its own; to be written before anything refers to it."""

    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(piece)
                name = int.from_bytes(os.urandom(8), "big") >> 1
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["run", "docs"])

    return texts.mapInArrow(run, "run long, docs binary")


def _opened(docs: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(docs.as_buffer()).read_next_batch()


def _asked(slices: DataFrame, shared: Broadcast) -> DataFrame:
    """Per slice and part: the distinct words that are not frequent, and the last 32 bits of the distinct pairs, both by hash."""

    def run(batches):
        m = shared.value
        for batch in batches:
            for name, docs in zip(batch.column(0), batch.column(1)):
                word, _, before = tokens(_opened(docs).column(2))
                w, p = np.unique(word), np.unique(pair_hashes(before, word))
                w = w[m.exact(w) < 0]
                found: dict[int, list[bytes]] = {}
                for i, hashes, kind in ((0, w, _U), (1, p, np.uint32)):
                    part = _part(hashes, m.parts)
                    for a, b in _pieces(part):
                        found.setdefault(int(part[a]), [b""] * 2)[i] = (hashes[a:b] if kind is _U else hashes[a:b] & _LOW).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name.as_py())), pa.array(list(found), pa.int32()), *(pa.array([v[i] for v in found.values()], pa.binary()) for i in range(2))], ["run", "part", "words", "pairs"])

    return slices.mapInArrow(run, "run long, part int, words binary, pairs binary")


def _answered(asked: DataFrame, counted: DataFrame, parts: int) -> DataFrame:
    """Per slice and part: the exact counts of the words and the levels of the pairs, in the order in which they were asked."""
    nothing = F.lit(None).cast("binary")
    have = counted.select("part", F.lit(0).alias("order"), F.lit(None).cast("long").alias("run"), "words", F.col("segment").alias("pairs"), "counts")
    asks = asked.select("part", F.lit(1).alias("order"), "run", "words", "pairs", nothing.alias("counts"))
    both = have.unionByName(asks).repartition(parts, "part").sortWithinPartitions("part", "order")

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["run", "part", "counts", "levels"])

    def run(batches):
        part, words, counts, held = None, _NO_WORDS, _NO_COUNTS, None
        for batch in batches:
            rows = []
            for p, order, name, w, asked_pairs, c in zip(*(batch.column(i) for i in range(6))):
                if p.as_py() != part:
                    part, words, counts, held = p.as_py(), _NO_WORDS, _NO_COUNTS, None
                w = np.frombuffer(w.as_buffer(), _U)
                if order.as_py() == 0:
                    words, counts = w, np.frombuffer(c.as_buffer(), np.int64)
                    held = _one_segment(np.frombuffer(asked_pairs.as_buffer(), np.uint8))
                    continue
                pairs = np.frombuffer(asked_pairs.as_buffer(), np.uint32).astype(_U)
                known = np.zeros(len(w), np.int64)
                if len(words):
                    at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                    known = np.where(words[at] == w, counts[at], 0)
                level = held.reached(pairs, _pair_keys(pairs)) if held else np.zeros(len(pairs), np.int64)
                rows.append((name.as_py(), part, known.tobytes(), level.astype(np.uint8).tobytes()))
                if len(rows) == 512:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    return both.mapInArrow(run, "run long, part int, counts binary, levels binary")


def _scored(slices: DataFrame, answers: DataFrame, shared: Broadcast, parts: int, id_type: str) -> DataFrame:
    """The documents of each slice, scored with the answers of all parts."""
    nothing = F.lit(None).cast("binary")
    docs = slices.select("run", F.lit(-1).alias("part"), "docs", nothing.alias("counts"), nothing.alias("levels"))
    both = docs.unionByName(answers.select("run", "part", nothing.alias("docs"), "counts", "levels")).repartition(parts, "run").sortWithinPartitions("run", "part")

    def run(batches):
        m = shared.value
        for rows in tx.row_groups(batches, ["run"]):
            # Parts ascend with the hashes, so the answers in a row are by hash again.
            def answer(name, kind):
                return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in rows.column(name).slice(1)])

            piece = _opened(rows.column("docs")[0])
            n = piece.num_rows
            word, text, before = tokens(piece.column(2))
            known, inverse = np.unique(word, return_inverse=True)
            exact = m.exact(known)
            exact[exact < 0] = answer("counts", np.int64)
            sizes = np.bincount(text, minlength=n)
            base = np.bincount(text, weights=np.log10(exact + 1.0)[inverse], minlength=n) - sizes * math.log10(m.n + m.v + 1)
            n_known = np.bincount(text, weights=(exact > 0)[inverse], minlength=n).astype(np.int64)
            single = np.where(exact > 0, LEVEL_VALUES[levels(np.maximum(exact, 1))], 0.0)
            c_word = single[inverse]
            c_before = np.append(single[np.searchsorted(known, END)], c_word[:-1])
            _, inverse = np.unique(pair_hashes(before, word), return_inverse=True)
            c_pair = LEVEL_VALUES[answer("levels", np.uint8)][inverse]
            score = np.bincount(text, weights=m.log_probabilities(c_word, c_before, c_pair), minlength=n)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(sizes.astype(np.int64)), pa.array(n_known), pa.array(np.full(n, m.n, np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return both.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document, with the model learnt from the documents that are not held out."""
    texts = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    model, counted = fit(texts.where("not held_out"))
    slices = written(_sliced(texts), "slices")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    answers = _answered(_asked(slices, shared), counted, model.parts)
    return _scored(slices, answers, shared, model.parts, texts.schema["doc_id"].dataType.simpleString())
