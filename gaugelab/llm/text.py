"""Vectorised work on the bytes of an Arrow text column: words, word hashes, shingles.

All functions take the column's own buffers, so no Python string is made per
document. Texts are handled in slices of a few MB; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20


def positional(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The table with columns named by position, so that none clashes with a working column, and the new names of some."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    return docs.toDF(*names), [names[lower.index(c.lower())] for c in columns]

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A pseudo-random 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))

_letters = np.arange(256, dtype=np.uint8)
LOWER = np.where((_letters >= 65) & (_letters <= 90), _letters + 32, _letters).astype(np.uint8)

#: Bytes of words that end only at white space: [^\x20\x09-\x0D]
SPACED = ~((_letters == 32) | ((_letters >= 9) & (_letters <= 13)))
#: Bytes of words of letters, digits and everything outside ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
PLAIN = ((_letters >= 48) & (_letters <= 57)) | ((_letters >= 65) & (_letters <= 90)) | ((_letters >= 97) & (_letters <= 122)) | (_letters >= 128)


#: Powers are a product of two: a low one from a kept table and a high one, so that a worker keeps 32 KB a base whatever its texts.
_LOW_BITS = 12


def _run_of_powers(base: int, n: int) -> np.ndarray:
    step = np.full(n, base, dtype=_U)
    step[:1] = 1
    return np.multiply.accumulate(step)


_LOW_POWERS = {base: _run_of_powers(base, 1 << _LOW_BITS) for base in (_BASE, _BASE_INVERSE)}


def _high_powers(base: int, n: int) -> np.ndarray:
    """Every 2^12th power up to the n-th."""
    return _run_of_powers(pow(base, 1 << _LOW_BITS, 1 << 64), (n >> _LOW_BITS) + 1)


def _power_table(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1, made anew."""
    return np.multiply.outer(_high_powers(base, n), _LOW_POWERS[base]).ravel()[:n]


def _powers_at(base: int, exponents: np.ndarray, most: int) -> np.ndarray:
    """Some powers, of exponents up to ``most``."""
    return _high_powers(base, most)[exponents >> _LOW_BITS] * _LOW_POWERS[base][exponents & ((1 << _LOW_BITS) - 1)]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of each text; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``limit`` bytes; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    first = 0
    while first < batch.num_rows:
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    inner = cuts[cuts > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by default with A-Z lower-cased, from one running sum over the bytes."""
    n = len(data)
    running = np.empty(n + 1, dtype=_U)
    running[0] = 0
    values = _power_table(_BASE, n)
    values *= (BYTE_VALUES[LOWER] if lower else BYTE_VALUES)[data]
    np.cumsum(values, out=running[1:])
    raw = (running[ends] - running[starts]) * _powers_at(_BASE_INVERSE, starts, n)
    return mixed(raw + (ends - starts).astype(_U))


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of n texts begin, with the end of the last; ``rows`` ascends."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingle_hashes(hashes: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and their text number; a shorter, non-empty text is one shingle."""
    counts = np.diff(begins)
    n = len(hashes)
    if n == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    factor = mixed(np.arange(11, 11 + size, dtype=_U)) | _U(1)
    padded = np.concatenate([hashes, np.zeros(size, _U)])
    total = np.zeros(n, _U)
    for j in range(size):
        total += padded[j : j + n] * factor[j]
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - begins[:-1][text]
    keep = place <= np.maximum(counts[text] - size, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    values = mixed(total)
    for t in short:  # the words that exist, with their number, so that no longer shingle equals it
        a, b = begins[t], begins[t + 1]
        values[a] = mixed((hashes[a:b] * factor[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a))[0]
        keep[a + 1 : b] = False
    return values[keep], text[keep]


def row_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys; rows must come sorted by them. Keys are not null."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        change = np.zeros(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held
