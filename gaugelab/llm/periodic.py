"""Runs of repeated words, found by recompression.

The words of a slice of texts are one sequence of symbols with a separator of its
own behind each text. It is compressed in turns: each block of equal symbols
becomes one symbol (a rule symbol -> symbol^count), then each pair of a left and a
right symbol does (a rule symbol -> left right), the sides being dealt by a hash,
until one symbol is left. Symbols have equal names if they have equal rules, so
the rules are a run-length grammar of the sequence, and equal stretches are
compressed alike but for their ends.

The grammar answers how far two positions agree, forwards and backwards: climb
while the symbols beside both positions agree, taking single symbols where only
one of the two begins a symbol of the next level, then walk down the rules to the
first difference. All queries of a slice climb together.

A run of period p with at least ``LEAST_WORDS`` words and ``LEAST_POWER`` periods has
a stretch of words equal to those p further on that is at least
max(LEAST_WORDS - p, (LEAST_POWER - 1) p) long. So one position of a grid of that
step meets it; over all periods the grids are a harmonic sum. Positions of the grid
whose own word and a neighbour agree are candidates; the grammar gives the exact
extension. Of equal stretches the smallest period counts.

Cases: null and empty texts have no words and no runs; texts are whole, however
long; repeated rows are judged one by one, also with a null id; empty tables give
no rows; further columns are left out. Words are told apart by 64-bit hashes; the
names of the grammar are exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx

LEAST_WORDS = 24
LEAST_POWER = 3

#: Bytes of text that share a grammar, and grid positions looked at together.
SLICE_BYTES = 1 << 20
_GRID_CHUNK = 1 << 20

_U = np.uint64


def _starts_to_rank(starts: np.ndarray, n: int) -> np.ndarray:
    """For each boundary 0..n of a level its number one level up, or -1 inside a symbol."""
    rank = np.full(n + 1, -1, np.int32)
    rank[starts] = np.arange(len(starts), dtype=np.int32)
    rank[n] = len(starts)
    return rank


class Grammar:
    """Run-length grammar of a sequence of non-negative numbers, level by level.

    ``symbols[k]`` is the sequence at level k, ``down[k]`` the boundaries of level k
    among those of level k - 1, ``up[k]`` the other way. ``rules`` maps a name to
    (left, right) or (symbol, -count).
    """

    def __init__(self, sequence: np.ndarray, keep_rules: bool = False):
        self.symbols = [np.unique(sequence, return_inverse=True)[1].astype(np.int64)]
        self.letters = self.names = int(self.symbols[0].max()) + 1 if len(sequence) else 0
        self.down: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.up: list[np.ndarray] = []
        self.blocks: list[bool] = []  # whether the step from level k upwards is of blocks
        self.rules: dict[int, tuple[int, int]] | None = {} if keep_rules else None
        turn = 0
        while len(self.symbols[-1]) > 1:
            if not self._blocks():
                while not self._pairs(turn):
                    turn += 1
                turn += 1

    def _level(self, starts: np.ndarray, merged: np.ndarray, first: np.ndarray, second: np.ndarray, blocks: bool) -> None:
        """The next level: symbols begin at ``starts``; those of ``merged`` get the names of their rules."""
        now = self.symbols[-1]
        n = len(now)
        after = now[starts]
        if len(merged):
            keys, at, name = np.unique(first * np.int64(max(self.names, n) + 1) + second, return_index=True, return_inverse=True)
            after[merged] = self.names + name
            if self.rules is not None:
                self.rules |= {self.names + i: (int(first[a]), -int(second[a]) if blocks else int(second[a])) for i, a in enumerate(at.tolist())}
            self.names += len(keys)
        self.up.append(_starts_to_rank(starts, n))
        self.down.append(np.append(starts, n).astype(np.int32))
        self.symbols.append(after)
        self.blocks.append(blocks)

    def _blocks(self) -> bool:
        now = self.symbols[-1]
        same = now[1:] == now[:-1]
        if not same.any():
            return False
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.diff(np.append(starts, len(now)))
        merged = np.flatnonzero(count > 1)
        self._level(starts, merged, now[starts[merged]], count[merged], True)
        return True

    def _pairs(self, turn: int) -> bool:
        now = self.symbols[-1]
        left = tx.mixed(now.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(turn)) & _U(1) == 0
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        first = np.flatnonzero(one if one.sum() >= other.sum() else other)
        if not len(first):
            return False
        begins = np.ones(len(now), bool)
        begins[first + 1] = False
        starts = np.flatnonzero(begins)
        self._level(starts, (np.cumsum(begins) - 1)[first], now[first], now[first + 1], False)
        return True

    def expand(self, symbol: int) -> list[int]:
        """The letters that a symbol derives."""
        out, stack = [], [symbol]
        while stack:
            s = stack.pop()
            if s < self.letters:
                out.append(s)
            elif self.rules[s][1] < 0:
                stack += [self.rules[s][0]] * -self.rules[s][1]
            else:
                stack += self.rules[s][::-1]
        return out

    def extension(self, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
        """How many symbols agree from boundaries i and j on, forwards (step 1) or backwards (-1).

        The sequence must have a difference on that side of every i and j.
        """
        shift = 0 if step > 0 else -1
        a, b = i.astype(np.int64).copy(), j.astype(np.int64).copy()
        top = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for level in range(len(self.symbols) - 1):  # upwards, until the symbols differ
            x, y = a[live], b[live]
            symbols = self.symbols[level]
            same = symbols[x + shift] == symbols[y + shift]
            live, x, y = live[same], x[same], y[same]
            if not len(live):
                break
            up = self.up[level]
            edges = (up[x] >= 0) & (up[y] >= 0)
            inner = np.flatnonzero(~edges)
            if len(inner):  # one of the two is inside a symbol of the next level
                p, q, same = self._advance(level, x[inner], y[inner], step)
                x[inner], y[inner] = p, q
                a[live[inner]], b[live[inner]] = p, q
                keep = np.ones(len(live), bool)
                keep[inner[~same]] = False
                live, x, y = live[keep], x[keep], y[keep]
            a[live], b[live] = up[x], up[y]
            top[live] = level + 1
        for level in range(int(top.max(initial=0)), 0, -1):  # downwards, to the first difference
            live = np.flatnonzero(top >= level)
            x, y = self.down[level][a[live]].astype(np.int64), self.down[level][b[live]].astype(np.int64)
            symbols = self.symbols[level - 1]
            same = np.flatnonzero(symbols[x + shift] == symbols[y + shift])
            if len(same):
                x[same], y[same], _ = self._advance(level - 1, x[same], y[same], step)
            a[live], b[live] = x, y
        return (a - i) * step

    def _advance(self, level: int, x: np.ndarray, y: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Past the equal symbols at x and y, within the symbols of the next level; and whether both then end one."""
        if self.blocks[level]:
            down = self.down[level + 1]
            # What is left of the block on either side.
            if step > 0:
                rest = [down[np.searchsorted(down, v, side="right")] - v for v in (x, y)]
            else:
                rest = [v - down[np.searchsorted(down, v, side="left") - 1] for v in (x, y)]
            k = np.minimum(*rest)
            return x + step * k, y + step * k, rest[0] == rest[1]
        return x + step, y + step, (self.up[level][x + step] >= 0) & (self.up[level][y + step] >= 0)


def _grid(sizes: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and position in the text of every grid point, some at a time."""
    most = np.where(sizes >= least, sizes // power, 0)
    begins = np.concatenate([[0], np.cumsum(most)])
    total, at = int(begins[-1]), 0
    while at < total:
        upto = min(total, at + _GRID_CHUNK // 8)
        pair = np.arange(at, upto)
        doc = np.searchsorted(begins, pair, side="right") - 1
        period = pair - begins[doc] + 1
        step = np.maximum(least - period, (power - 1) * period)
        points = (sizes[doc] - period + step - 1) // step
        # Few pairs have very many points; chunks are cut by points.
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(points), np.arange(_GRID_CHUNK, points.sum(), _GRID_CHUNK)), [0, len(pair)]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            n = points[lo:hi]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(doc[lo:hi], n), np.repeat(period[lo:hi], n), place * np.repeat(step[lo:hi], n)
        at = upto


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST_WORDS, power: int = LEAST_POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run, in that order, of texts laid end to end; ``words`` are any 64-bit numbers."""
    none = np.zeros(0, np.int64)
    if not (sizes >= least).any():
        return none, none, none, none
    # Letters first, then a separator in front and one of its own behind each text.
    name = np.unique(words, return_inverse=True)[1]
    behind = np.cumsum(sizes + 1)
    sequence = np.empty(int(behind[-1]) + 1, np.int64)
    cut = np.concatenate([[0], behind])
    inside = np.ones(len(sequence), bool)
    inside[cut] = False
    sequence[inside] = name
    sequence[cut] = len(words) + np.arange(len(cut))
    first = cut[:-1] + 1
    grammar = None
    found = []
    for doc, period, place in _grid(sizes, least, power):
        x = first[doc] + place
        y = x + period
        hit = sequence[x] == sequence[y]
        doc, period, x, y = doc[hit], period[hit], x[hit], y[hit]
        hit = (sequence[x + 1] == sequence[y + 1]) | (sequence[x - 1] == sequence[y - 1])
        doc, period, x, y = doc[hit], period[hit], x[hit], y[hit]
        if not len(x):
            continue
        grammar = grammar or Grammar(sequence)
        more = grammar.extension(x, y)
        some = grammar.extension(x, y, -1)
        length = more + some + period
        keep = length >= np.maximum(least, power * period)
        found.append(np.stack([doc, x - some - first[doc], length, period])[:, keep])
    rows = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), np.int64)
    # In order of text, start, length, period: the first of an equal stretch has the smallest period.
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    rows = rows[:, fresh]
    rows = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
    return rows[0], rows[1], rows[2], rows[3]


def word_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+, and how many words each text has."""
    data, offsets = tx.text_buffer(column)
    starts, ends, row = tx.words(data, offsets, tx.SPACED)
    return tx.word_hashes(data, starts, ends, lower=False), np.bincount(row, minlength=len(column))


_REPORT = "id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def _judged(column: pa.Array, least: int, power: int) -> Iterator[tuple]:
    values, sizes = word_values(column)
    doc, start, length, period = runs_of(values, sizes, least, power)
    begins = np.searchsorted(doc, np.arange(len(column) + 1)).tolist()
    for i, text in enumerate(column.to_pylist()):
        a, b = begins[i], begins[i + 1]
        # bytes.split cuts at the same six signs as the word pattern; str.split does not.
        words = text.encode().split() if text else []
        if a == b:
            yield 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), []
            continue
        runs = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()))
        best = runs[0]
        for r in runs[1:]:  # exactly: length / period as a fraction
            if r[1] * best[2] > best[1] * r[2]:
                best = r
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start[a:b] + period[a:b], 1)
        np.add.at(change, start[a:b] + length[a:b], -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        yield (
            len(runs), *best, 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join([words[k] for k in kept])).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs],
        )


def runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_WORDS, power: int = LEAST_POWER) -> DataFrame:
    """One row per document: the id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), digests of all runs and of the words that stay when each run is cut to its first period, and the runs."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for part in tx.slices(whole, "text", SLICE_BYTES):
                columns = list(zip(*_judged(part.column(1), least, power)))
                arrays = [pa.array(list(c), t) for c, t in zip(columns, _TYPES)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["id", *_NAMES])

    return texts.mapInArrow(run, _REPORT.format(id=kind)).withColumnRenamed("id", id_column)


_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
_TYPES = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]


def periodic_tail(doc_id: object, text: str) -> str:
    """One document in ten gets a periodic end, dealt by the CRC-32 of its id: known cases for the search."""
    h = zlib.crc32(str(doc_id).encode())
    words = text.encode().split() if h % 10 == 0 else []
    if not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    repeated = tail * -(-(n - a) // p)
    return b" ".join(words[:a] + repeated[: n - a]).decode()


def with_periodic_tails(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and text, some of the texts with a periodic end; null ids and texts stay as they are."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            chosen = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids]
            mask = pc.and_(pa.array(chosen, pa.bool_()), pc.is_valid(batch.column(1)))
            rows = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
            some = batch.column(1).take(pa.array(rows)).to_pylist()
            made = pa.array([periodic_tail(ids[i], t) for i, t in zip(rows.tolist(), some)], batch.column(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.replace_with_mask(batch.column(1), mask, made)], ["doc_id", "text"])

    return texts.mapInArrow(run, texts.schema)
