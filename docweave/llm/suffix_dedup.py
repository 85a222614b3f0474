"""Removal of long byte strings that repeat, by column-wise suffix sorting (operator 12).

Strings of ``WIDTH`` bytes are looked for. The collection is cut at anchors: a
string's anchor is the first of its 100-byte grams with the least hash, so equal
strings have equal anchors at equal places. Anchors are counted over the corpus;
those that occur once decide that none of their strings repeats. What lies around
the others, ``WIDTH`` bytes to each side at most, are the documents of the
construction, dealt so that all that share an anchor meet.

The construction inserts one symbol per document each round, from the right to
the left, in the columns that the anchor sets: the order of all suffixes that
begin in a column follows from the order of the column before by a stable sort of the new
symbols, which are the next column of the Burrows-Wheeler transform, and common
prefixes follow from the least of those between two suffixes of one symbol. Suffixes with ``WIDTH``
bytes in common with a neighbour repeat. A shard holds a bounded number of bytes for the corpus' size, so
its order and prefixes stay in memory, and shuffle files take the place of the
sequential external files between shards.

Anchors with more than ``MOST`` occurrences would make large shards. Their
strings are counted one by one, by two 64-bit hashes, each block's different ones once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, documents, mix, partitions, text_slices
from docweave.llm.counting import pack_blocks, pack_counts, pack_keys, replies, unpack_counts, unpack_keys, unpack_rows

#: Bytes of the strings that may not repeat, and of the grams that are anchors.
WIDTH, GRAM = 400, 100
#: Occurrences of an anchor that meet in one shard at most.
MOST = 1024
#: Bytes of text in a block, behind a shard, and handled by one vectorised step.
BLOCK_BYTES, SHARD_BYTES, STEP_BYTES = 4 << 20, 8 << 20, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_ANCHOR_REQUEST = "shard long, block long, level int, keys binary, counts binary"
_REQUEST = "shard long, block long, kind int, size long, low binary, high binary, n binary, at binary, body binary"
_SPANS = "block long, starts binary, lengths binary"
_RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_rng = np.random.default_rng(20250612)
_CODES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base, and those of its inverse, modulo 2 ** 64."""
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b)])) for b in (base, inverse))


class Sums:
    """Hashes of any substring of some bytes, from sums of weighted codes."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        powers, self.inverse = _powers(STEP_BYTES + 2 * WIDTH)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """The least key of each run of ``window`` keys: of the rest of one piece and the begin of the next."""
    rows = -(-len(keys) // window)
    padded = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    pieces = padded.reshape(rows, window)
    begin = np.minimum.accumulate(pieces, axis=1).ravel()
    rest = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - window + 1
    return np.minimum(rest[:n], begin[window - 1 : window - 1 + n])


class Runs:
    """Runs of strings with one anchor in a piece of bytes: from ``low`` to ``high``, around ``anchor``; ``content`` stands for all of a run's bytes."""

    def __init__(self, data: np.ndarray, valid: np.ndarray, width: int, gram: int):
        """``valid``: whether a string of ``width`` bytes that begins at each place lies in one document."""
        self.data = data
        at = np.flatnonzero(valid)
        if not len(at):
            self.low = self.high = self.anchor = np.zeros(0, np.int64)
            self.keys = self.content = np.zeros(0, np.uint64)
            return
        sums, begins = Sums(data, _CODES[0]), np.arange(len(data) - gram + 1)
        grams = sums.of(begins, begins + gram)
        bits = np.uint64((STEP_BYTES + 2 * WIDTH).bit_length())
        # Cut hashes, alike in pieces of any length, with the place in the low bits: of equal ones the first is the least.
        anchor = (_least(grams >> bits << bits | begins.astype(np.uint64), width - gram + 1)[at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0)]))
        self.low, self.high, self.anchor = at[first], at[np.append(first[1:], len(at)) - 1], anchor[first]
        # Least hashes are small; mixed again they fall into all shards alike.
        self.keys, self.content = mix(~grams[self.anchor]), sums.of(self.low, self.high + width)


def pieces(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(place of its first byte, bytes, valid begins)`` of pieces that begin strings at ``STEP_BYTES`` places at most; a long text is several."""
    base = 0
    for _, _, data, bounds in text_slices(column, STEP_BYTES):
        change = np.zeros(len(data) + 1, np.int32)
        long = np.flatnonzero(np.diff(bounds) >= width)
        change[bounds[:-1][long]] += 1
        change[bounds[1:][long] - width + 1] -= 1
        valid = np.cumsum(change[:-1]) > 0
        for first in range(0, len(data), STEP_BYTES):
            part = data[first : first + STEP_BYTES + width - 1]
            if len(part) >= width:
                yield base + first, part, valid[first : first + STEP_BYTES][: len(part) - width + 1]
        base += len(data)


def _cut(sorted_keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """``(shard, from, to)`` of the shards that hold any of the keys; a shard is what agrees in the first ``bits`` bits."""
    shards = (sorted_keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_keys), np.int64)
    first = np.flatnonzero(np.diff(shards, prepend=-1))
    return list(zip(shards[first].tolist(), first.tolist(), np.append(first, len(shards))[1:].tolist(), strict=True))


def repeats(body: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document of a shard, whether each of its strings, begun from ``low`` to ``high``, is one of another document's at the same column.

    ``anchor``: where in ``body`` column 0 of each document lies; its columns go from ``low`` to ``high + width - 1``.
    """
    size = high - low + 1
    at = np.concatenate([[0], np.cumsum(size)])
    found = np.zeros(int(at[-1]), bool)
    by_end = np.argsort(-high, kind="stable")
    ends, entered = -high[by_end] - width + 1, 0
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
    for column in range(int(high.max()) + width - 1, int(low.min()) - 1, -1):
        upto = int(np.searchsorted(ends, -column, "right"))
        if upto > entered:  # documents whose last symbol this is: empty suffixes come first
            order = np.concatenate([by_end[entered:upto], order])
            common = np.concatenate([np.zeros(upto - entered, np.int32), common])
            entered = upto
        before = np.flatnonzero(low[order] <= column)
        if not len(before):
            order, common = order[:0], common[:0]
            continue
        symbols = body[anchor[order[before]] + column]
        by = np.argsort(symbols, kind="stable")
        now, symbols = before[by], symbols[by]
        common = _common(common, now, symbols)
        order = order[now]
        if column <= high.max():
            same = common >= width
            same[:-1] |= same[1:]
            hit = order[same]
            found[at[hit] + column - low[hit]] = True
    return np.split(found, at[1:-1])


def _common(common: np.ndarray, now: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Common prefixes of neighbours in the new order, whose suffixes had the places ``now`` before: of one symbol, one more than the least between the two places."""
    out = np.zeros(len(now), common.dtype)
    at = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
    left, right = now[at - 1] + 1, now[at]
    span = right - left + 1
    least = common[right]
    level, table, wide = 0, common, span > 1
    at_level = np.frexp(span)[1] - 1  # so many times two go into the span
    for k in range(1, int(at_level.max(initial=0)) + 1):
        table = np.minimum(table[: -(1 << level)], table[1 << level :])
        level = k
        some = np.flatnonzero(wide & (at_level == k))
        least[some] = np.minimum(table[left[some]], table[right[some] - (1 << k) + 1])
    out[at] = least + 1
    return out


class _Packed:
    """Requests of one block, as rows of ``_REQUEST``."""

    NAMES = [x.split(" ")[0] for x in _REQUEST.split(", ")]

    def __init__(self, block: int):
        self.block, self.rows = block, []

    def add(self, shard: int, kind: int, low: np.ndarray, high: np.ndarray, n: np.ndarray, at: np.ndarray, body: bytes) -> None:
        squeeze = lambda x: pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)
        self.rows.append((shard, self.block, kind, len(n), squeeze(low), squeeze(high), squeeze(n.astype(np.int64)), squeeze(at.astype(np.int64)), pa.compress(body, codec="zstd", asbytes=True) if body else b""))

    def table(self) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 5
        return pa.table({name: pa.array([r[n] for r in self.rows], kind) for n, (name, kind) in enumerate(zip(self.NAMES, kinds, strict=True))})


def _inflate(raw: bytes, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=size * np.dtype(kind).itemsize, codec="zstd"), kind) if size else np.zeros(0, kind)


def _ask_anchors(width: int, gram: int, bits: int):
    """Each block's different anchors and their counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                keys, counts = np.unique(_block_keys(raw.as_py(), width, gram), return_counts=True)
                parts = _cut(keys, bits)
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array([0] * len(parts), pa.int32()),
                    pa.array([pack_keys(keys[a:b]) for _, a, b in parts], pa.binary()), pa.array([pack_counts(counts[a:b]) for _, a, b in parts], pa.binary()),
                ], names=["shard", "block", "level", "keys", "counts"])

    return run


def _block_keys(raw: bytes, width: int, gram: int) -> np.ndarray:
    found = [Runs(data, valid, width, gram).keys for _, data, valid in pieces(unpack_rows(raw).column("text").combine_chunks(), width)]
    return np.concatenate([np.zeros(0, np.uint64), *found])


def _ask_strings(width: int, gram: int, bits: int, most: int):
    """For a block and the counts of its anchors: documents of the construction (kind 0), and strings whose anchors are too frequent (kind 1)."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _Packed(0).table()
        packed = _Packed(blocks.column("block")[0].as_py())
        text = unpack_rows(blocks.column("rows")[0].as_py()).column("text").combine_chunks()
        found = [(base, Runs(data, valid, width, gram)) for base, data, valid in pieces(text, width)]
        all_keys = np.concatenate([np.zeros(0, np.uint64), *[r.keys for _, r in found]])
        keys = np.unique(all_keys)
        got = {r["shard"]: r["counts"] for r in answers.select(["shard", "counts"]).to_pylist()}
        total = np.concatenate([np.zeros(0, np.int64), *[unpack_counts(got[s], b - a) for s, a, b in _cut(keys, bits)]])
        rows, strings, held = [], [], []
        for piece, (base, runs) in enumerate(found):
            times = total[np.searchsorted(keys, runs.keys)]
            some = np.flatnonzero((times > 1) & (times <= most))
            low, high = runs.low[some], runs.high[some]
            rows.append(np.stack([runs.keys[some], runs.content[some], (low - runs.anchor[some]).view(np.uint64), (high - low).view(np.uint64), (low + base).view(np.uint64), np.full(len(some), piece, np.uint64), low.view(np.uint64)]))
            hot = np.flatnonzero(times > most)
            if len(hot):
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(runs.low[hot].tolist(), runs.high[hot].tolist(), strict=True)])
                strings.append(np.stack([*[Sums(runs.data, codes).of(at, at + width) for codes in _CODES], (at + base).view(np.uint64)]))
            held.append(runs.data)
        if rows:
            _documents(packed, np.concatenate(rows, axis=1), held, width, bits)
        if strings:
            _strings(packed, np.concatenate(strings, axis=1), bits)
        return packed.table()

    return run


def _grouped(columns: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns sorted by their first rows, where each different one begins, and how often it is there."""
    columns = columns[:, np.lexsort(columns[:keys][::-1])]
    first = np.flatnonzero(np.concatenate([[True], (columns[:keys, 1:] != columns[:keys, :-1]).any(axis=0)])) if columns.shape[1] else np.zeros(0, np.int64)
    return columns, first, np.diff(np.append(first, columns.shape[1]))


def _documents(packed: _Packed, rows: np.ndarray, held: list[np.ndarray], width: int, bits: int) -> None:
    rows, first, n = _grouped(rows, 4)  # equal ones of a block go once
    signed = rows[2:].view(np.int64)
    at = np.append(first, rows.shape[1])
    for shard, a, b in _cut(rows[0][first], bits):
        own = first[a:b]
        body = b"".join(held[p][x : x + size + width].tobytes() for p, x, size in zip(signed[3, own].tolist(), signed[4, own].tolist(), signed[1, own].tolist(), strict=True))
        packed.add(shard, 0, signed[0, own].astype(np.int32), signed[1, own].astype(np.int32), n[a:b], signed[2, at[a] : at[b]], body)


def _strings(packed: _Packed, rows: np.ndarray, bits: int) -> None:
    rows, first, n = _grouped(rows, 2)
    at = np.append(first, rows.shape[1])
    for shard, a, b in _cut(rows[0][first], bits):
        packed.add(shard, 1, rows[0][first[a:b]], rows[1][first[a:b]], n[a:b], rows[2].view(np.int64)[at[a] : at[b]], b"")


def _answer(width: int):
    """For the requests of a shard, where strings that repeat begin in each block."""

    def constructed(rows: list[dict], n: list[np.ndarray]) -> Iterator[tuple[dict, np.ndarray]]:
        low = [_inflate(r["low"], len(k), np.int32).astype(np.int64) for r, k in zip(rows, n, strict=True)]
        more = [_inflate(r["high"], len(k), np.int32).astype(np.int64) for r, k in zip(rows, n, strict=True)]
        sizes = np.concatenate(more) + width
        body = np.concatenate([_inflate(r["body"], int((x + width).sum()), np.uint8) for r, x in zip(rows, more, strict=True)])
        lows = np.concatenate(low)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        found = repeats(body, begin - lows, lows, lows + np.concatenate(more), width)
        k = 0
        for r, own in zip(rows, n, strict=True):
            at = _inflate(r["at"], int(own.sum()), np.int64)
            starts, where = [], 0
            for times in own.tolist():
                hit = np.arange(len(found[k])) if times > 1 else np.flatnonzero(found[k])
                if len(hit):
                    starts.append((at[where : where + times, None] + hit).ravel())
                where, k = where + times, k + 1
            yield r, np.concatenate([np.zeros(0, np.int64), *starts])

    def counted(rows: list[dict], n: list[np.ndarray]) -> Iterator[tuple[dict, np.ndarray]]:
        both = np.stack([np.concatenate([_inflate(r[c], len(k), np.uint64) for r, k in zip(rows, n, strict=True)]) for c in ("low", "high")])
        order = np.lexsort(both[::-1])
        group = np.cumsum(np.concatenate([[0], (both[:, order[1:]] != both[:, order[:-1]]).any(axis=0)]))
        total = np.bincount(group, weights=np.concatenate(n)[order])
        again = np.empty(len(order), bool)
        again[order] = total[group] > 1
        for r, own, hit in zip(rows, n, np.split(again, np.cumsum([len(k) for k in n])[:-1]), strict=True):
            yield r, _inflate(r["at"], int(own.sum()), np.int64)[np.repeat(hit, own)]

    def run(table: pa.Table) -> pa.Table:
        out = {"block": [], "starts": [], "lengths": []}
        rows = table.to_pylist()
        for kind, answer in ((0, constructed), (1, counted)):
            some = [r for r in rows if r["kind"] == kind]
            n = [_inflate(r["n"], r["size"], np.int64) for r in some]
            for r, starts in answer(some, n) if some else ():
                starts = np.unique(starts)
                first = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1])) if len(starts) else np.zeros(0, np.int64)
                out["block"].append(r["block"])
                out["starts"].append(starts[first].tobytes())
                out["lengths"].append(np.diff(np.append(first, len(starts))).tobytes())
        return pa.table({"block": pa.array(out["block"], pa.int64()), "starts": pa.array(out["starts"], pa.binary()), "lengths": pa.array(out["lengths"], pa.binary())})

    return run


def _removed(width: int):
    """The rows of a block with what its spans leave of them."""

    def run(blocks: pa.Table, spans: pa.Table) -> pa.Table:
        names = [x.split(" ")[0] for x in _RESULT.split(", ", 4)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        out = {name: [] for name in names}
        for block in blocks.column("rows"):
            table = unpack_rows(block.as_py())
            starts, lengths = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x.as_py(), np.int64) for x in spans.column(c)]]) for c in ("starts", "lengths"))
            base = 0
            doc_ids = table.column("doc_id").to_pylist()
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], (starts + lengths + width - 1)[order]
            for first, end, data, bounds in text_slices(table.column("text").combine_chunks(), STEP_BYTES):
                change = np.zeros(len(data) + 1, np.int64)
                a, b = np.searchsorted(starts, [base, base + len(data)])
                np.add.at(change, starts[a:b] - base, 1)
                np.add.at(change, ends[a:b] - base, -1)
                gone = np.cumsum(change[:-1]) > 0
                for k in range(end - first):
                    own, text = gone[bounds[k] : bounds[k + 1]], data[bounds[k] : bounds[k + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
                    out["doc_id"].append(doc_ids[first + k])
                    out["n_bytes"].append(len(own))
                    out["n_removed"].append(int(own.sum()))
                    out["spans"].append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
                    out["kept"].append(text[~own].tobytes() if len(edge) else text.tobytes())
                base += len(data)
        return pa.table({name: pa.array(out[name], kind) for name, kind in zip(names, kinds, strict=True)})

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of each row of ``docs(doc_id, text, ...)``.

    Each byte that lies in a string of ``width`` bytes that begins anywhere else too, in this text or another, is
    removed; strings do not cross texts, may overlap, and are judged on the input. ``spans`` are the maximal removed
    runs, in bytes from 0, ends exclusive; ``kept`` is the rest, which need not be whole characters.

    Null counts as the empty text; texts under ``width`` bytes stay whole, very long ones are read in pieces.
    Rows that repeat a text lose all of it, if it has ``width`` bytes, whatever their doc_ids are; rows are told apart one by one, so
    ids may be null or repeat. Further columns are ignored; an empty table gives no rows.
    """
    if not 0 < gram <= width <= WIDTH:
        raise ValueError(f"width is at most {WIDTH}, and gram at most width")
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.save(pack_blocks(rows, BLOCK_BYTES).withColumn("size", F.length("rows")), "blocks")
    packed = blocks.agg(F.sum("size")).first()[0] or 0
    shards = max(partitions(scratch.spark), math.ceil(3 * packed / SHARD_BYTES))
    bits = max(0, (shards - 1).bit_length())
    blocks, dealt = blocks.drop("size"), max(partitions(scratch.spark), math.ceil(packed / BLOCK_BYTES))
    asked = blocks.mapInArrow(_ask_anchors(width, gram, bits), _ANCHOR_REQUEST).withColumn("shard", F.col("shard").cast("int"))
    counts = scratch.save(replies(asked.repartition(dealt, "shard")).select("block", "shard", "counts"), "counts")
    wanted = blocks.repartition(dealt, "block").groupBy("block").cogroup(counts.repartition(dealt, "block").groupBy("block")).applyInArrow(_ask_strings(width, gram, bits, most), _REQUEST)
    spans = scratch.save(wanted.repartition(dealt, "shard").groupBy("shard").applyInArrow(_answer(width), _SPANS), "spans")
    return blocks.repartition(dealt, "block").groupBy("block").cogroup(spans.repartition(dealt, "block").groupBy("block")).applyInArrow(_removed(width), _RESULT)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 400 bytes."""
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
