"""Token ids, packed best-fit-decreasing into rows of a binary matrix (operator 2).

Texts become token ids of a public vocabulary. Longer texts than a row are
split, without loss, into full rows and a rest; the pieces go, largest first,
into the row with the least free space that still holds them, which a segment
tree over the free spaces finds. Each output row has its ids as little-endian
16-bit integers, the cumulative lengths of its segments, and the places at which
positions start again from 0.

Rows are packed within the input partition, in groups of ``GROUP_TOKENS``, so
ids never cross the network and memory does not depend on the partition's size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import bound_batches, documents

#: The vocabulary: one line a token, its bytes in base64 and its id.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with the vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids in a row, and the id that fills its free space.
ROW_TOKENS, FILL = 2048, 50256
#: Tokens that are packed together.
GROUP_TOKENS = 1 << 21
_SCHEMA = "shard int, row long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"


class FreeSpace:
    """A segment tree over free spaces 0..capacity; its leaves hold the rows with that much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = self.size + free
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns ``(free, row)`` with the least free space of at least ``least``."""
        at = self.size + least
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at ^ 1]):  # up to the first subtree to the right that holds rows
                at >>= 1
            if at <= 1:
                return None
            at ^= 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.size
        row = self.rows[free].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return free, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The indexes of the items in each row; ties in the order given."""
    space, rows = FreeSpace(capacity), []
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = space.take(sizes[item])
        free, row = found or (capacity, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(item)
        if free > sizes[item]:
            space.add(free - sizes[item], row)
    return rows


def encoder(lines: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pack_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The packed rows of all texts of ``docs(doc_id, text, ...)``.

    ``shard`` is the input partition and ``row`` counts within it. ``input_ids``
    has ``row_tokens`` ids, filled up with ``FILL`` after the first ``n_tokens``.
    ``cu_seqlens`` starts with 0 and ends with ``n_tokens``; segment k is of
    document ``doc_ids[k]``, from its token ``doc_offsets[k]`` on, and begins at
    ``position_resets[k]``, where positions start again from 0. ``unpack``
    restores the texts.

    The vocabulary file is read by the driver and sent along (it has a fixed size,
    under 1 MB). Null and empty texts have no tokens, hence no segment. Repeated
    rows are packed one by one, null doc_ids like others; further columns are
    ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        lines = file.read()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, done = encoder(lines).encode_ordinary, TaskContext.get().partitionId(), 0
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def emit() -> pa.RecordBatch:
            nonlocal pieces, held, done
            rows = [[pieces[k] for k in row] for row in best_fit_decreasing([len(p[2]) for p in pieces], row_tokens)]
            lengths = [[0, *np.cumsum([len(p[2]) for p in row]).tolist()] for row in rows]
            ids = []
            for row, at in zip(rows, lengths, strict=True):
                matrix = np.full(row_tokens, FILL, "<u2")
                matrix[: at[-1]] = np.concatenate([p[2] for p in row])
                ids.append(matrix.tobytes())
            columns = [
                pa.array([shard] * len(rows), pa.int32()), pa.array(range(done, done + len(rows)), pa.int64()), pa.array([at[-1] for at in lengths], pa.int32()), pa.array(ids, pa.binary()),
                pa.array(lengths, pa.list_(pa.int32())), pa.array([at[:-1] for at in lengths], pa.list_(pa.int32())),
                pa.array([[p[0] for p in row] for row in rows], pa.list_(pa.int64())), pa.array([[p[1] for p in row] for row in rows], pa.list_(pa.int64())),
            ]
            done, pieces, held = done + len(rows), [], 0
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array(encode(text or ""), "<u2")
                for start in range(0, len(ids), row_tokens):
                    pieces.append((doc_id, start, ids[start : start + row_tokens]))
                held += len(ids)
                if held >= group_tokens:
                    yield emit()
        if pieces:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, _SCHEMA)


def unpack(packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` again from packed rows; doc_ids have to be unique, and texts without tokens are not among them."""
    with open(vocabulary, "rb") as file:
        lines = file.read()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, bounds, ids, offsets in zip(*(batch.column(c).to_pylist() for c in ("input_ids", "cu_seqlens", "doc_ids", "doc_offsets")), strict=True):
                row = np.frombuffer(raw, "<u2")
                out += [(doc, at, row[a:b].tobytes()) for doc, at, (a, b) in zip(ids, offsets, pairwise(bounds), strict=True)]
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "at", "ids"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoding = encoder(lines).decode_bytes
        for batch in batches:
            texts = [decoding(np.frombuffer(b"".join(part), "<u2").tolist()).decode("utf-8", "replace") for part in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    parts = packed.mapInArrow(segments, "doc_id long, at long, ids binary")
    whole = parts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"]).alias("parts"))
    return whole.mapInArrow(decode, "doc_id long, text string")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet with a binary id column."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in rows of 2048 ids."""
    return pack_tokens(documents(spark, sf_dir))
