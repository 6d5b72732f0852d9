"""Benchmark decontamination with suffix arrays of the training text.

Documents are cut into shards of a few MB inside each task. A shard's suffix
array holds the word positions whose first words may begin a benchmark window,
sorted by their next words. Every benchmark suffix that begins a window is
binary-searched in every shard's array; what lies in its range is an occurrence,
and comparing on gives the longest verbatim match and where it is.

The benchmark is broadcast in blocks of a fixed size, one pass over the documents
per block, so no broadcast grows with it. Word positions are kept or not by a
bit table of fixed size; its false hits only make an array longer.

Cases: a null or empty text has no words and no hits; an item without words has
no window; items with equal text all count; a null item id is listed as an empty
string; an empty benchmark leaves every document clean; further columns of the
documents are carried along by ``clean`` and ignored by ``report``; repeated
documents are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx
from gaugelab.storage import written

WINDOW = 10
LEAD = 3
TABLE_BITS = 22
BLOCK_BYTES = 2 << 20
SHARD_BYTES = 4 << 20
NOTHING = hashlib.sha256(b"").hexdigest()

_U = np.uint64
_LEAD_FACTORS = tx.mixed(np.arange(71, 71 + LEAD, dtype=_U)) | _U(1)


def _lead(columns: list[np.ndarray]) -> np.ndarray:
    """Slot in the bit table of the first one, two or three words."""
    total = np.full(len(columns[0]), len(columns), dtype=_U)
    for j, c in enumerate(columns):
        total += c * _LEAD_FACTORS[j]
    return (total * _U(0x9E3779B97F4A7C15) >> _U(64 - TABLE_BITS)).astype(np.int64)


class Probes:
    """The windows of one block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int = WINDOW):
        data, offsets = tx.text_buffer(pa.array(texts, pa.large_string()))
        starts, ends, rows = tx.words(data, offsets, tx.PLAIN)
        self.ids, self.window = ids, window
        self.words = np.concatenate([tx.word_hashes(data, starts, ends), np.zeros(window, _U)])
        begins = tx.row_starts(rows, len(texts))
        counts = np.diff(begins)
        place = np.arange(len(starts)) - begins[:-1][rows]
        first = np.flatnonzero(place <= np.maximum(counts[rows] - window, 0))
        length = np.minimum(counts[rows[first]], window)
        keys = np.stack([np.where(d < length, self.words[first + d], _U(0)) for d in range(window)]) if len(first) else np.zeros((window, 0), _U)
        # Equal windows are searched for once; their items follow from the list of each.
        order = np.lexsort(keys[::-1]) if len(first) else np.zeros(0, np.int64)
        keys, first, length = keys[:, order], first[order], length[order]
        fresh = np.ones(len(first), bool)
        if len(first):
            fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
        self.group = np.flatnonzero(np.append(fresh, True))
        self.member_item, self.member_first = rows[first], first
        self.member_left = (begins[1:][rows[first]] - first) if len(first) else first
        self.keys, self.length = keys[:, fresh], length[fresh]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.leads = sorted({int(n) for n in np.unique(np.minimum(self.length, LEAD))})
        for n in self.leads:
            of = np.minimum(self.length, LEAD) == n
            self.table[_lead([self.keys[d][of] for d in range(n)])] = True


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of each value in its own range of a column that ascends there."""
    a, b = lo.copy(), hi.copy()
    while True:
        open_ = a < b
        if not open_.any():
            return a
        middle = (a + b) >> 1
        seen = column[np.minimum(middle, len(column) - 1)]
        less = (seen <= value) if after else (seen < value)
        a, b = np.where(open_ & less, middle + 1, a), np.where(open_ & ~less, middle, b)


class Shard:
    """Words of some documents and the suffix array over the positions that may matter."""

    def __init__(self, column: pa.Array, probes: Probes):
        data, offsets = tx.text_buffer(column)
        starts, ends, self.rows = tx.words(data, offsets, tx.PLAIN)
        self.n_docs = len(column)
        n, w = len(starts), probes.window
        self.words = np.concatenate([tx.word_hashes(data, starts, ends), np.zeros(w, _U)])
        self.begins = tx.row_starts(self.rows, self.n_docs)
        self.probes = probes
        may = np.zeros(n, bool)
        for k in probes.leads:
            may |= probes.table[_lead([self.words[d : d + n] for d in range(k)])] if n else may
        at = np.flatnonzero(may)
        last = self.begins[1:][self.rows[at]]
        keys = [np.where(at + d < last, self.words[at + d], _U(0)) for d in range(w)]
        self.array = np.lexsort(keys[::-1]) if len(at) else np.zeros(0, np.int64)
        self.keys = [k[self.array] for k in keys]
        self.array = at[self.array]
        self.left = self.begins[1:][self.rows[self.array]] - self.array if len(at) else self.array

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in the suffix array, window) of every occurrence."""
        p = self.probes
        query = np.arange(p.keys.shape[1])
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(self.array), np.int64)
        for d in range(p.window):
            going = (lo < hi) & (p.length > d)
            query_d = np.flatnonzero(going)
            if not len(query_d):
                break
            value = p.keys[d][query_d]
            low = _bound(self.keys[d], lo[query_d], hi[query_d], value, False)
            hi[query_d] = _bound(self.keys[d], low, hi[query_d], value, True)
            lo[query_d] = low
        found = np.flatnonzero(lo < hi)
        size = (hi - lo)[found]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[found], size)
        return place, np.repeat(found, size)

    def hits(self) -> tuple[np.ndarray, list[dict]]:
        """Which words are hit, and for each document with hits its items and its longest match."""
        p = self.probes
        marks = np.zeros(len(self.rows) + 1, np.int64)
        found: dict[int, dict] = {}
        if len(self.array) and p.keys.shape[1]:
            place, window = self.matches()
            position = self.array[place]
            np.add.at(marks, position, 1)
            np.add.at(marks, position + p.length[window], -1)
            size = p.group[window + 1] - p.group[window]
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(p.group[window], size)
            place = np.repeat(place, size)
            at, item = self.array[place], p.member_item[member]
            reach = np.repeat(p.length[window], size)
            room = np.minimum(self.left[place], p.member_left[member])
            going = np.flatnonzero(reach < room)
            while len(going):  # on from the window, word by word, for all matches at once
                same = self.words[at[going] + reach[going]] == p.words[p.member_first[member[going]] + reach[going]]
                going = going[same]
                reach[going] += 1
                going = going[reach[going] < room[going]]
            doc = self.rows[at] if len(at) else at
            # Per document the longest match, the first of equal ones.
            order = np.lexsort((item, at, -reach, doc))
            for i in order:
                d = int(doc[i])
                one = found.setdefault(d, {"items": set(), "longest": int(reach[i]), "item": p.ids[item[i]], "at": int(at[i] - self.begins[d])})
                one["items"].add(p.ids[item[i]])
        return np.cumsum(marks[:-1]) > 0, found


def probe_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Probes]:
    """The benchmark in blocks of at most ``block_bytes`` of text (or one item)."""
    ids: list[str] = []
    texts: list[str] = []
    held = 0
    for row in benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(F.col(text_column), F.lit(""))).toLocalIterator():
        if ids and held + len(row[1]) > block_bytes:
            yield Probes(ids, texts, window)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1])
    yield Probes(ids, texts, window)


_FOUND = "_hit_words binary, _items array<string>, _longest int, _longest_item string, _longest_at long, _n_words long"


def _scan(docs: DataFrame, probes: Probes, text_column: str, shard_bytes: int) -> DataFrame:
    """One pass: adds what this block hits to the columns of ``_FOUND``."""
    names = [f.name for f in docs.schema.fields]
    given = [n for n in names if not n.startswith("_hit_words")]
    shared = docs.sparkSession.sparkContext.broadcast(probes)
    earlier = "_hit_words" in names
    keep = [n for n in given if n not in ("_items", "_longest", "_longest_item", "_longest_at", "_n_words")] if earlier else names
    kept = docs.select(*[F.col(f"`{n}`") for n in keep])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}, {_FOUND}"

    def run(batches):
        p = shared.value
        for batch in batches:
            for part in tx.slices(batch, text_column, shard_bytes):
                shard = Shard(part.column(part.schema.get_field_index(text_column)), p)
                hit, found = shard.hits()
                counts = np.diff(shard.begins)
                rows = [part.column(part.schema.get_field_index(n)) for n in keep]
                old = part.to_pydict() if earlier else None
                masks, items, longest, which, at = [], [], [], [], []
                for d in range(part.num_rows):
                    f = found.get(d)
                    mask = hit[shard.begins[d] : shard.begins[d + 1]] if f else None
                    held = {"items": set(f["items"]), "longest": f["longest"], "item": f["item"], "at": f["at"]} if f else {"items": set(), "longest": 0, "item": None, "at": None}
                    if old and old["_hit_words"][d]:
                        before = np.unpackbits(np.frombuffer(old["_hit_words"][d], np.uint8), count=counts[d]).astype(bool)
                        mask = before if mask is None else mask | before
                        held["items"] |= set(old["_items"][d])
                        if old["_longest"][d] >= held["longest"]:
                            held |= {"longest": old["_longest"][d], "item": old["_longest_item"][d], "at": old["_longest_at"][d]}
                    masks.append(np.packbits(mask).tobytes() if mask is not None else b"")
                    items.append(sorted(held["items"]))
                    longest.append(held["longest"])
                    which.append(held["item"])
                    at.append(held["at"])
                rows += [pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(which, pa.string()), pa.array(at, pa.int64()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, [*keep, "_hit_words", "_items", "_longest", "_longest_item", "_longest_at", "_n_words"])

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", benchmark_id: str = "item_id", benchmark_text: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with their hit words (a bit per word), items, and longest match with its item and word position."""
    blocks = probe_blocks(benchmark, benchmark_id, benchmark_text, window, block_bytes)
    found = _scan(docs, next(blocks), text_column, shard_bytes)
    for probes in blocks:
        found = _scan(written(found, "contamination"), probes, text_column, shard_bytes)
    return found


def report(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, longest match."""
    found = scan(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), benchmark, "text", **options)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        _set_bits(F.col("_hit_words")).cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.size("_items") > 0).alias("contaminated"),
        F.col("_longest").alias("longest_match"),
        F.col("_longest_item").alias("longest_item"),
        F.col("_longest_at").alias("longest_at"),
    )


def _set_bits(binary):
    """Set bits of a byte string, in SQL: ones of its hex digits."""
    digits = F.hex(binary)
    ones = F.translate(digits, "0123456789ABCDEF", "0112122312232334")
    return sum((F.length(ones) - F.length(F.replace(ones, F.lit(str(k)), F.lit("")))) * k for k in range(1, 5))


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    rows, (text,) = tx.positional(docs, text_column)
    found = scan(rows, benchmark, text, **options)
    return found.where(F.size("_items") == 0).select(*rows.columns).toDF(*docs.columns)
