"""Removal of byte strings that occur more than once in a corpus, with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts anywhere
else. What may match is gathered into shards, each sorted by its suffix array:

1. Each start of such a string belongs to the least 32-byte gram (by hash) within
   it, so equal strings choose the same place. Starts at like distances from a
   place form a block; a block's core is the text that all its strings share.
2. Blocks whose core occurs once are done with: none of their strings repeats.
   Cores are counted in parts of bounded size, from one entry per slice of a few
   MB and distinct block text, however often it occurs there.
3. Of blocks with equal text one is kept, with whether there are more. The texts
   of a core go to one shard; its suffix array is made by induced sorting, and the
   common prefixes of neighbours tell which strings repeat.
4. A core with more than ``MOST_TEXTS`` different texts (the border of a passage
   that very many documents hold) is split further, by the whole strings.
5. The repeated starts return to all blocks of that text, and bytes are removed.

Results depend on texts only, so equal texts are worked on once where it matters.

Cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; equal
texts of that length or more lose everything, also when id and text repeat; a null
id is an id like others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelab.llm import text as tx
from gaugelab.llm.suffix_array import common_prefixes, suffix_array
from gaugelab.storage import written

LENGTH = 200
GRAM = 32
PART_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
MOST_TEXTS = 4096
#: Starts whose blocks are sought at once.
STRETCH = 1 << 19

_U = np.uint64
#: A byte that no UTF-8 text has.
BETWEEN = 0xFF


class Hashes:
    """Hashes of any stretch of a byte array, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.running = np.empty(n + 1, _U)
        self.running[0] = 0
        np.cumsum(tx.BYTE_VALUES[data] * tx._power_table(tx._BASE, n), out=self.running[1:])
        self.inverse = tx._power_table(tx._BASE_INVERSE, n + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tx.mixed((self.running[end] - self.running[begin]) * self.inverse[begin] + (end - begin).astype(_U))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def blocks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """The blocks of some texts: text, first start (in the text), number of starts, hash of the core, hash of the block's text."""
    kinds = {"text": np.int64, "start": np.int64, "n": np.int64, "core": _U, "whole": _U}
    found: dict[str, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in kinds.items()}
    # Some ten arrays of 64 bits a byte are held, so starts are taken a stretch at a time, from a block's first one on.
    begin, end = 0, len(data) - length + 1
    while begin < end:
        stop = min(begin + max(STRETCH, 2 * length), end)
        one = _blocks_from(data, offsets, length, begin, stop)
        last = len(one["n"]) - 1
        if stop < end and last >= 0 and one["at"][last] + one["n"][last] == stop:
            stop = int(one["at"][last])  # it may go on behind the stretch
            one = {k: v[:last] for k, v in one.items()}
        for k, v in found.items():
            v.append(one[k])
        begin = stop
    return {k: np.concatenate(v) for k, v in found.items()}


def _blocks_from(data: np.ndarray, offsets: np.ndarray, length: int, begin: int, stop: int) -> dict[str, np.ndarray]:
    """The blocks of the starts from ``begin`` to ``stop``, and where in the data each begins."""
    gram = min(GRAM, max(1, length // 2))
    width = length - gram + 1
    grid = (width + 1) // 2
    data = data[begin : stop - 1 + length]
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    bits = _U(len(data).bit_length())
    key = (hashes.of(at, at + gram) >> bits << bits) | at.astype(_U)
    place = (_least(key, width) & ((_U(1) << bits) - _U(1))).astype(np.int64)
    # Starts whose string ends within their text.
    within = np.searchsorted(offsets, [begin, stop - 1], side="right") - 1
    some = np.arange(within[0], within[1] + 1)
    lowest, highest = np.maximum(offsets[some], begin), np.minimum(offsets[some + 1] - length, stop - 1)
    many = np.maximum(highest - lowest + 1, 0)
    start = np.arange(many.sum()) + np.repeat(lowest - begin - (np.cumsum(many) - many), many)
    place = place[start]
    step = (place - start) // grid
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (step[1:] != step[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(start)))
    opens, last = start[first], place[first] - grid * step[first]
    text = np.repeat(some, many)[first]
    return {
        "at": opens + begin,
        "text": text,
        "start": opens + begin - offsets[text],
        "n": count,
        "core": hashes.of(last, last - grid + 1 + length),
        "whole": hashes.of(opens, opens + count - 1 + length),
    }


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    fresh = np.ones(len(keys[0]), bool)
    for k in keys:
        fresh[1:] &= k[1:] == k[:-1]
    fresh[1:] = ~fresh[1:]
    return np.flatnonzero(fresh)


#: Kind 0, one row per slice: its texts and blocks. Kind 1, one row per slice and part: cores and block texts, each pair once, with how often.
_GATHERED = "kind int, run long, part int, base long, a binary, b binary, c binary, d binary, e binary, f binary"


def _gathered(docs: DataFrame, parts: int, length: int) -> DataFrame:
    names = [c.split()[0] for c in _GATHERED.split(", ")]

    def row(*values):
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*values, *[None] * (10 - len(values))], kinds)], names)

    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                data, offsets = tx.text_buffer(piece.column(piece.schema.get_field_index("text")))
                found = blocks(data, offsets, length)
                if not len(found["n"]):
                    continue
                run_id = int.from_bytes(os.urandom(8), "big") >> 1
                part = _part(found["core"], parts)
                low = (found["core"] & _U(0xFFFFFFFF)).astype(np.uint32)
                order = np.lexsort((found["whole"], low, part))
                first = _cuts(part[order], low[order], found["whole"][order])
                group = np.empty(len(order), np.uint32)
                group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
                times = np.diff(np.append(first, len(order))).astype(np.uint32)
                keys = [np.ascontiguousarray(piece.column(piece.schema.get_field_index(k)).to_numpy()).tobytes() for k in ("k1", "k2", "tag")]
                blocks_of = np.stack([found["text"], found["start"], found["n"], group.astype(np.int64)]).astype(np.uint32)
                yield row(0, run_id, None, None, *keys, blocks_of.tobytes())
                one = order[first]
                cut = _cuts(part[one])
                for a, b in zip(cut, [*cut[1:].tolist(), len(one)]):
                    yield row(1, run_id, int(part[one[a]]), int(a), low[one[a:b]].tobytes(), found["whole"][one[a:b]].tobytes(), times[a:b].tobytes())

    return docs.mapInArrow(run, _GATHERED)


REP, MORE, SPLIT = 1, 2, 4


def _counted(gathered: DataFrame, parts: int) -> DataFrame:
    """Per slice and part, of the entries whose core repeats: index, shard key, class, and flags."""
    asked = gathered.where("kind = 1").select("part", "run", "base", "a", "b", "c").repartition(parts, "part").sortWithinPartitions("part")

    def run(batches):
        for rows in tx.row_groups(batches, ["part"]):
            core = [np.frombuffer(v.as_buffer(), np.uint32) for v in rows.column("a")]
            source = np.repeat(np.arange(len(core)), [len(c) for c in core])
            index = np.concatenate([np.arange(len(c)) for c in core]) + np.repeat(rows.column("base").to_numpy(), [len(c) for c in core])
            core = np.concatenate(core)
            whole = np.concatenate([np.frombuffer(v.as_buffer(), _U) for v in rows.column("b")])
            times = np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in rows.column("c")]).astype(np.int64)
            order = np.argsort(core, kind="stable")
            core, whole, times, source, index = core[order], whole[order], times[order], source[order], index[order]
            first = _cuts(core)
            size = np.diff(np.append(first, len(core)))
            keep = np.repeat(np.add.reduceat(times, first) > 1, size)
            core, whole, times, source, index = core[keep], whole[keep], times[keep], source[keep], index[keep]
            if not len(core):
                continue
            order = np.lexsort((whole, core))
            core, whole, times, source, index = core[order], whole[order], times[order], source[order], index[order]
            first = _cuts(core, whole)
            size = np.diff(np.append(first, len(core)))
            flags = np.zeros(len(core), np.uint8)
            flags[first] |= REP
            flags[np.repeat(np.add.reduceat(times, first) > 1, size)] |= MORE
            of_core = _cuts(core[first])
            texts = np.diff(np.append(of_core, len(first)))
            flags[np.repeat(np.repeat(texts > MOST_TEXTS, texts), size)] |= SPLIT
            part = rows.column("part")[0].as_py()
            shard = (np.int64(part) << np.int64(32)) + core.astype(np.int64)
            named = tx.mixed(whole + tx.mixed(shard.view(_U))).view(np.int64)
            order = np.argsort(source, kind="stable")
            cut = _cuts(source[order])
            runs = rows.column("run").to_numpy()
            for a, b in zip(cut, [*cut[1:].tolist(), len(order)]):
                o = order[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([runs[source[o[0]]]]), pa.array([index[o].astype(np.uint32).tobytes()], pa.binary()), pa.array([shard[o].tobytes()], pa.binary()), pa.array([named[o].tobytes()], pa.binary()), pa.array([flags[o].tobytes()], pa.binary())], ["run", "a", "b", "c", "d"])

    return asked.mapInArrow(run, "run long, a binary, b binary, c binary, d binary")


_CANDIDATES = "k1 long, k2 long, tag long, wanted boolean, starts binary, sizes binary, shards binary, classes binary, flags binary"


def _returned(gathered: DataFrame, counted: DataFrame, slices: int) -> DataFrame:
    """Per text with blocks whose core repeats: their starts, sizes, shards, classes and flags."""
    no = F.lit(None).cast("binary")
    own = gathered.where("kind = 0").select("run", F.lit(0).alias("kind"), "a", "b", "c", "d")
    back = counted.select("run", F.lit(1).alias("kind"), "a", "b", "c", "d")
    both = own.unionByName(back).repartition(slices, "run").sortWithinPartitions("run", "kind")
    names = [c.split()[0] for c in _CANDIDATES.split(", ")]

    def solve(rows: pa.Table):
        if rows.num_rows < 2:
            return None
        k1, k2, tag = (np.frombuffer(rows.column(c)[0].as_buffer(), np.int64) for c in "abc")
        text, start, n, group = np.frombuffer(rows.column("d")[0].as_buffer(), np.uint32).reshape(4, -1)
        groups = int(group.max()) + 1
        shard, named, flags = np.zeros(groups, np.int64), np.zeros(groups, np.int64), np.zeros(groups, np.uint8)
        there = np.zeros(groups, bool)
        for i in range(1, rows.num_rows):
            index = np.frombuffer(rows.column("a")[i].as_buffer(), np.uint32)
            shard[index] = np.frombuffer(rows.column("b")[i].as_buffer(), np.int64)
            named[index] = np.frombuffer(rows.column("c")[i].as_buffer(), np.int64)
            flags[index] = np.frombuffer(rows.column("d")[i].as_buffer(), np.uint8)
            there[index] = True
        take = np.flatnonzero(there[group])
        text, start, n, group = text[take], start[take], n[take], group[take]
        flag = flags[group]
        # The first block of a class in the slice stands for it, if the slice does.
        _, first = np.unique(group, return_index=True)
        later = np.ones(len(group), bool)
        later[first] = False
        flag = np.where(later, flag & ~np.uint8(REP), flag)
        cut = _cuts(text)
        out: list[list] = [[] for _ in names]
        for a, b in zip(cut, [*cut[1:].tolist(), len(text)]):
            t = text[a]
            values = (k1[t], k2[t], tag[t], bool((flag[a:b] & REP).any()), start[a:b].tobytes(), n[a:b].astype(np.uint16).tobytes(), shard[group[a:b]].tobytes(), named[group[a:b]].tobytes(), flag[a:b].tobytes())
            for o, v in zip(out, values):
                o.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_()), *(pa.array(o, pa.binary()) for o in out[4:])], names)

    def run(batches):
        for rows in tx.row_groups(batches, ["run"]):
            if (found := solve(rows)) is not None:
                yield found

    return both.mapInArrow(run, _CANDIDATES)


def _block_texts(texts: DataFrame, length: int) -> DataFrame:
    """One row per class: shard, class, flags, number of starts and text of the block. A split one has its starts' hashes instead."""
    names = ["shard", "class", "more", "split", "n", "block"]

    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                column = {c: piece.column(piece.schema.get_field_index(c)) for c in ("text", "starts", "sizes", "shards", "classes", "flags")}
                out: list[list] = [[] for _ in names]
                for i in range(piece.num_rows):
                    data = np.frombuffer(column["text"][i].as_buffer(), np.uint8)
                    flags = np.frombuffer(column["flags"][i].as_buffer(), np.uint8)
                    start, n = np.frombuffer(column["starts"][i].as_buffer(), np.uint32).astype(np.int64), np.frombuffer(column["sizes"][i].as_buffer(), np.uint16).astype(np.int64)
                    shard, named = (np.frombuffer(column[c][i].as_buffer(), np.int64) for c in ("shards", "classes"))
                    hashes = None
                    for j in np.flatnonzero(flags & REP).tolist():
                        split = bool(flags[j] & SPLIT)
                        if split:
                            hashes = hashes or Hashes(data)
                            s = np.arange(start[j], start[j] + n[j])
                            block = hashes.of(s, s + length).tobytes()
                        else:
                            block = data[start[j] : start[j] + n[j] - 1 + length].tobytes()
                        for o, v in zip(out, (int(shard[j]), int(named[j]), bool(flags[j] & MORE), split, int(n[j]), block)):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()))], names)

    return texts.mapInArrow(run, "shard long, class long, more boolean, split boolean, n int, block binary")


def repeated_starts(texts: list[bytes], counts: np.ndarray, more: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For some block texts with so many starts each, which of the starts' strings occur elsewhere, from their suffix array."""
    sizes = np.array([len(t) + 1 for t in texts])
    joined = np.frombuffer(bytes([BETWEEN]).join(texts) + bytes([BETWEEN]), np.uint8)
    s = np.zeros(len(joined) + 1, np.uint16)
    s[:-1] = joined
    s[:-1] += 1
    order = suffix_array(s, 257)
    shared = common_prefixes(s, order, length) >= length
    again = np.zeros(len(s), bool)
    again[order] = shared | np.append(shared[1:], False)
    begin = np.cumsum(sizes) - sizes
    return [again[b : b + n] | m for b, n, m in zip(begin.tolist(), counts.tolist(), more.tolist())]


def _shards(block_texts: DataFrame, shards: int, length: int) -> DataFrame:
    """class and starts (a bit for each start that repeats) of the classes with any."""
    rows = block_texts.where("not split").select("shard", "class", "more", "n", "block").repartition(shards, "shard").sortWithinPartitions("shard")

    def solve(held: list[pa.Table]):
        table = pa.concat_tables(held)
        found = repeated_starts(table.column("block").to_pylist(), table.column("n").to_numpy(), table.column("more").to_numpy(), length)
        any_ = [bool(f.any()) for f in found]
        classes = table.column("class").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(classes[any_]), pa.array([np.packbits(f).tobytes() for f, a in zip(found, any_) if a], pa.binary())], ["class", "starts"])

    def run(batches):
        held, size = [], 0
        for group in tx.row_groups(batches, ["shard"]):
            held.append(group)
            size += group.nbytes
            if size >= SHARD_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    return rows.mapInArrow(run, "class long, starts binary")


def _by_strings(block_texts: DataFrame) -> DataFrame:
    """The same for classes whose core was split: their strings are counted one by one."""

    def opened(batches):
        for batch in batches:
            for named, more, block in zip(*(batch.column(i) for i in range(3))):
                hashes = np.frombuffer(block.as_buffer(), np.int64)
                m = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, named.as_py())), pa.array(np.full(m, more.as_py())), pa.array(np.arange(m, dtype=np.int32)), pa.array(hashes)], ["class", "more", "place", "string"])

    strings = block_texts.where("split").select("class", "more", "block").mapInArrow(opened, "class long, more boolean, place int, string long")
    often = strings.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select("string")
    again = strings.where("not more").join(written(often, "strings"), "string", "left_semi").unionByName(strings.where("more"))
    grouped = again.groupBy("class").agg(F.collect_set("place").alias("places"))  # at most the starts of a block

    def bits(batches):
        for batch in batches:
            out = []
            for places in batch.column(1):
                p = places.values.to_numpy()
                mask = np.zeros(int(p.max()) + 1, bool)
                mask[p] = True
                out.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["class", "starts"])

    return grouped.mapInArrow(bits, "class long, starts binary")


def _opened(candidates: DataFrame) -> DataFrame:
    """A row per block: text, start, class."""

    def run(batches):
        for batch in batches:
            for piece in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                starts = [np.frombuffer(v.as_buffer(), np.uint32) for v in piece.column(2)]
                times = [len(s) for s in starts]
                classes = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in piece.column(3)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(piece.column(0).to_numpy(), times)), pa.array(np.repeat(piece.column(1).to_numpy(), times)), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(classes)], ["k1", "k2", "at", "class"])

    return candidates.select("k1", "k2", "starts", "classes").mapInArrow(run, "k1 long, k2 long, at long, class long")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.encode(F.col(text_column), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text", F.length("text")).alias("k2"), F.xxhash64("doc_id").alias("tag"))


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """k1, k2 (naming a text) and found, an array of (at, starts): from offset ``at`` on, a bit for each repeated start."""
    texts = _keyed(docs, id_column, text_column).where(F.length("text") >= length)
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / PART_BYTES))
    gathered = written(_gathered(texts.select("k1", "k2", "tag", "text"), parts, length), "blocks")
    candidates = written(_returned(gathered, _counted(gathered, parts), parts), "candidates")
    wanted = candidates.where("wanted").select("k1", "k2", "tag", "starts", "sizes", "shards", "classes", "flags")
    block_texts = written(_block_texts(texts.join(wanted, ["k1", "k2", "tag"]).select("text", "starts", "sizes", "shards", "classes", "flags"), length), "texts")
    classes = written(_shards(block_texts, parts, length).unionByName(_by_strings(block_texts)), "classes")
    # Equal texts have equal blocks: one row of each does.
    once = candidates.groupBy("k1", "k2").agg(F.min(F.struct("tag", "starts", "classes")).alias("one")).select("k1", "k2", "one.starts", "one.classes")
    known = _opened(once).join(classes, "class")
    return written(known.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "starts")).alias("found")), "repeats")


def removed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: bytes, removed bytes, removed spans (start, end), the kept bytes' digest, and the kept bytes."""
    found = repeated(docs, id_column, text_column, length)
    rows = _keyed(docs, id_column, text_column).select("doc_id", "text", "k1", "k2").join(found, ["k1", "k2"], "left").select("doc_id", "text", "found")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"]

    def run(batches):
        for batch in batches:
            for piece in tx.slices(batch, "text"):
                out: list[list] = [[] for _ in names[1:]]
                for text, blocks_ in zip(piece.column(1), piece.column(2)):
                    data = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
                    spans: list[dict[str, int]] = []
                    kept = data
                    if blocks_.is_valid:
                        mask = np.zeros(len(data) + 1, np.int32)
                        for one in blocks_.as_py():
                            s = one["at"] + np.flatnonzero(np.unpackbits(np.frombuffer(one["starts"], np.uint8)))
                            mask[s] += 1
                            mask[s + length] -= 1
                        gone = np.cumsum(mask[:-1]) > 0
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    for o, v in zip(out, (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)):
                        o.append(v)
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(o, t) for o, t in zip(out, kinds))], names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string, kept binary")
