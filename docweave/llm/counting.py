"""Counts of n-grams over a corpus, and their return to the texts that hold them.

Each input partition packs its texts into blocks of a bounded size, compressed,
one row a block. A block asks for each n-gram in it once: it sends its distinct
hashes with its own counts, cut into shards by value, as packed rows. A shard
adds the counts of all blocks and answers each block in the order of its
question. So the corpus crosses the network once as compressed text, and n-grams
only as a few bytes for each block that holds them; no table of counts is ever
broadcast or held by one task. Blocks and shards have a fixed size, so their
numbers, and those of the partitions that they are dealt into, follow the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import mix, partitions, text_slices, word_hashes

#: Bytes of text in a block and behind a shard, and with it the memory of one task.
BLOCK_BYTES = 6 << 20
#: Blocks, or shards, in one shuffle partition.
PER_PARTITION = 4
#: Different words that a task collects before it passes them on.
WORDS_AT_ONCE = 1 << 20
#: Stand for the start and the end of a text.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_LINK = np.uint64(0xD6E8FEB86659FD93)
_REQUEST = "shard int, block long, level int, keys binary, counts binary"
_REPLY = "block long, shard int, level int, counts binary"


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, high bytes first, so that a compressing shuffle takes little for them."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as byte planes, low bytes first: nearly all of the high planes is zero and takes nothing when compressed."""
    width = max(1, (int(counts.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
        wide[:, : len(planes)] = planes.T
    return wide.view(np.int64).ravel()


def hash_bits(total_bytes: int) -> int:
    """Bits of the hashes of n-grams of two and more words: one in 65,536 or fewer meets a stranger in a corpus of that size."""
    return min(64, max(48, int(total_bytes).bit_length() + 16))


def shard_bounds(keys: np.ndarray, shards: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """``(shard, from, to)`` of the shards that hold any of the sorted hashes of so many bits; each has a range of values, the last one the rest."""
    own = np.minimum(keys // np.uint64((1 << bits) // shards), np.uint64(shards - 1)).astype(np.int64) if shards > 1 else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    return list(zip(own[first].tolist(), first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True))


class Grams:
    """The n-grams of some texts: each text is START, its words, END, all of which but START are tokens."""

    def __init__(self, column: pa.Array, order: int, bits: int = 64):
        hashes, sizes = [], []
        for _, _, data, bounds in text_slices(column):
            words, at = word_hashes(data, bounds)
            hashes.append(words), sizes.append(np.diff(at))
        words = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 2)])
        row = np.empty(int(self.starts[-1]), np.uint64)
        inner = np.ones(len(row), bool)
        inner[self.starts[:-1]] = inner[self.starts[1:] - 1] = False
        row[inner] = words
        row[self.starts[:-1]], row[self.starts[1:] - 1] = START, END
        #: For each place the number of places before it in its text.
        self.place = np.arange(len(row)) - np.repeat(self.starts[:-1], self.sizes + 2)
        #: Bits of the hashes of each level: all 64 of single words.
        self.bits = [64, *[bits] * (order - 1)]
        longest, self.keys = row, [row]
        with np.errstate(over="ignore"):
            for level in range(1, order):
                longer = np.zeros(len(row), np.uint64)
                longer[1:] = mix(longest[:-1] * _LINK + row[1:] + np.uint64(level))
                self.keys.append(longer >> np.uint64(64 - bits))
                longest = longer
        #: Places at which the n-gram of each level lies within its text.
        self.valid = [self.place >= level for level in range(order)]

    def token(self) -> np.ndarray:
        return self.place > 0


def blocks_of(total_bytes: int, fewest: int) -> int:
    """The number of shards, and about that of blocks, for a corpus of that size."""
    return max(fewest, math.ceil(total_bytes / BLOCK_BYTES))


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, rows``: the rows of ``docs(text, ...)`` packed in the order of their partition.

    Rows that repeat lie wherever they are read, so none makes a block larger; a text
    beyond ``block_bytes`` is a block by itself. ``docs`` has to give the same rows in the same order when a task is run again, as files do.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(docs.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, n = TaskContext.get().partitionId(), [], 0, 0

        def emit() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for batch in held:
                    writer.write_batch(batch)
            return pa.RecordBatch.from_arrays([pa.array([part << 33 | n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(c).cast(schema.field(c).type) for c in schema.names], names=schema.names)
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy()
            first = 0
            for k, one in enumerate(sizes.tolist()):
                if size and size + one > block_bytes:
                    held.append(batch.slice(first, k - first))
                    yield emit()
                    held, size, n, first = [], 0, n + 1, k
                size += one
            held.append(batch.slice(first))
        if held and sum(b.num_rows for b in held):
            yield emit()

    return docs.mapInArrow(pack, "block long, rows binary")


def in_blocks(docs: DataFrame, blocks: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What ``pack_blocks`` gives, dealt over partitions by block."""
    return pack_blocks(docs, block_bytes).repartition(max(1, math.ceil(blocks / PER_PARTITION)), "block")


def unpack_rows(raw: bytes) -> pa.Table:
    """The rows of a block."""
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def requests(dealt: DataFrame, shards: int, order: int, bits: int, counted: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Each block's distinct n-grams and how often the texts that ``counted`` selects hold them, dealt by shard."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                table = unpack_rows(raw.as_py())
                grams = Grams(table.column("text").combine_chunks(), order, bits)
                use = np.repeat(counted(table), grams.sizes + 2)
                for level in range(order):
                    valid = grams.valid[level]
                    keys, back = np.unique(grams.keys[level][valid], return_inverse=True)
                    counts = np.bincount(back, weights=use[valid], minlength=len(keys)).astype(np.int64)
                    parts = shard_bounds(keys, shards, grams.bits[level])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s for s, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([level] * len(parts), pa.int32()),
                        pa.array([pack_keys(keys[a:b]) for _, a, b in parts], pa.binary()), pa.array([pack_counts(counts[a:b]) for _, a, b in parts], pa.binary()),
                    ], names=["shard", "block", "level", "keys", "counts"])

    return dealt.mapInArrow(ask, _REQUEST).repartition(max(1, math.ceil(shards / PER_PARTITION)), "shard")


def replies(asked: DataFrame) -> DataFrame:
    """The corpus counts for every request, in its order."""

    def run(table: pa.Table) -> pa.Table:
        out = {"block": [], "shard": [], "level": [], "counts": []}
        rows = table.to_pylist()
        for level in sorted({r["level"] for r in rows}):
            some = [r for r in rows if r["level"] == level]
            keys = [unpack_keys(r["keys"]) for r in some]
            counts = np.concatenate([unpack_counts(r["counts"], len(k)) for r, k in zip(some, keys, strict=True)])
            _, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, weights=counts).astype(np.int64)[back]
            for r, part in zip(some, np.split(total, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                for name in ("block", "shard", "level"):
                    out[name].append(r[name])
                out["counts"].append(pack_counts(part))
        return pa.table({"block": pa.array(out["block"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()), "level": pa.array(out["level"], pa.int32()), "counts": pa.array(out["counts"], pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, _REPLY)


def known_counts(grams: Grams, answers: pa.Table, shards: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level the corpus counts of the different n-grams, in the order of their hashes, the first place of each, and each place's n-gram (-1 for none)."""
    got = {(r["level"], r["shard"]): r["counts"] for r in answers.select(["level", "shard", "counts"]).to_pylist()}
    out = []
    for level, (row, valid) in enumerate(zip(grams.keys, grams.valid, strict=True)):
        places = np.flatnonzero(valid)
        keys, first, back = np.unique(row[places], return_index=True, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        for s, a, b in shard_bounds(keys, shards, grams.bits[level]):
            total[a:b] = unpack_counts(got[level, s], b - a)
        found = np.full(len(row), -1, np.int32)
        found[places] = back
        out.append((total, places[first].astype(np.int32), found))
    return out


def distinct_words(docs: DataFrame) -> tuple[int, int]:
    """The number of tokens (words and ends) and of different tokens of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens = np.zeros(0, np.uint64), 0

        def emit(keys: np.ndarray, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([n] + [0] * (len(keys) - 1), pa.int64())], names=["hash", "tokens"])

        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column("text"), BLOCK_BYTES // 4):
                words, _ = word_hashes(data, bounds)
                tokens += len(words) + len(bounds) - 1
                seen = np.union1d(seen, np.append(words, END))
                if len(seen) > WORDS_AT_ONCE:
                    yield emit(seen, tokens)
                    seen, tokens = np.zeros(0, np.uint64), 0
        if len(seen):
            yield emit(seen, tokens)

    found = docs.select("text").mapInArrow(run, "hash long, tokens long").groupBy("hash").agg(F.sum("tokens").alias("tokens"))
    found = found.agg(F.sum("tokens"), F.count("*")).first()
    return found[0] or 0, found[1] or 0
