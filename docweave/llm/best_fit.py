"""Conflict-constrained best-fit packing (operator 1).

Documents go into bins of a fixed number of words. Open bins are kept in the
order of their free space, and each carries a bitmap of the sources and of the
duplicate clusters in it. A document goes into the tightest bin that has room
and whose bitmap has none of its bits: the search starts at the first bin with
room and goes on to its successors until one is compatible.

Bins are local to a shard of about ``SHARD_ROWS`` documents, dealt by hash, so
a hot source or cluster is spread over all shards and none is gathered anywhere.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import WORD, Scratch, documents, word_count

#: Words that a bin holds.
CAPACITY = 2048
_BLANKS = r"[\x20\x09-\x0D]*"
#: Documents that are packed together.
SHARD_ROWS = 4096
_SCHEMA = "doc_id long, source string, cluster long, piece int, n_pieces int, start_word long, words long, shard long, bin int, bin_offset long, bin_words long"


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each ``(size, conflict bits)`` item, in the order given."""
    order: list[int] = []  # free space << 32 | bin, ascending
    bits: list[int] = []
    out = []
    for size, own in items:
        at = bisect_left(order, size << 32)
        while at < len(order) and bits[order[at] & 0xFFFFFFFF] & own:
            at += 1
        if at < len(order):
            entry = order.pop(at)
            free, one = entry >> 32, entry & 0xFFFFFFFF
        else:
            free, one = capacity, len(bits)
            bits.append(0)
        bits[one] |= own
        out.append((one, capacity - free))
        if free > size:
            insort(order, free - size << 32 | one)
    return out


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(
            table.select(["doc_id", "source", "cluster", "size", "shard"]).to_pylist(),
            key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["cluster"] or 0, r["source"] is None, r["source"] or ""),
        )
        sources = {s: 1 << k for k, s in enumerate(dict.fromkeys(r["source"] for r in rows))}
        several = [c for c, n in Counter(r["cluster"] for r in rows if r["cluster"] is not None).items() if n > 1]
        clusters = {c: 1 << len(sources) + k for k, c in enumerate(several)}
        items, pieces = [], []
        for r in rows:
            n = max(1, -(-r["size"] // capacity))
            for k in range(n):
                pieces.append((r, k, n))
                items.append((min(capacity, r["size"] - k * capacity), sources[r["source"]] | clusters.get(r["cluster"], 0)))
        placed = best_fit(items, capacity)
        full: Counter = Counter()
        for (one, _), (size, _) in zip(placed, items, strict=True):
            full[one] += size
        out = [(r["doc_id"], r["source"], r["cluster"], k, n, k * capacity, size, r["shard"], one, offset, full[one]) for (r, k, n), (size, _), (one, offset) in zip(pieces, items, placed, strict=True)]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        return pa.table({name: pa.array([x[i] for x in out], kinds[c.split()[1]]) for i, (name, c) in enumerate(zip(names, _SCHEMA.split(", "), strict=True))})

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cluster: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece of each row of ``docs(doc_id, text, source, ...)``: which bin it is in, and where.

    Columns: ``doc_id, source, cluster, piece, n_pieces, start_word, words,
    shard, bin, bin_offset, bin_words``; a bin is named by ``(shard, bin)``.
    No bin holds two pieces of one source or of one duplicate cluster, and none
    more than ``capacity`` words. A longer document is split, without loss, into
    pieces of ``capacity`` words and a rest. Documents are placed by doc_id.
    ``cluster`` names a long column of duplicate clusters; without it documents
    with equal texts form a cluster.

    A null source is a source of its own; null clusters conflict with nothing.
    Very long texts are counted in words only and split into as many pieces as they need; of bins with
    equally little room the one opened first is taken. Null and empty texts take no room, yet get a bin. Repeated rows are placed
    one by one. Further columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.col(cluster) if cluster else F.when(F.col("text").isNotNull(), F.xxhash64("text"))).cast("long").alias("cluster"),
        word_count().alias("size"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = scratch.save(rows, "rows")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(shards))).drop("_row")
    return dealt.groupBy("shard").applyInArrow(_pack(capacity), _SCHEMA)


def with_texts(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``pack_documents(docs)`` with ``text``, what of its document's text a piece holds.

    A piece goes from its first word to the next piece's, blanks included, and the first one from the start of
    the text, so the pieces of a document joined are its text. Rows that repeat doc_id and text are
    the same here. Texts meet their pieces by doc_id and hash. ``docs`` were packed without a ``cluster`` column.
    """
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), "text").groupBy("_id", "_key").agg(F.first("text").alias("_text"))
    met = packed.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("cluster") == F.col("_key")), "left")
    words = F.regexp_extract_all("_text", F.lit(f"{WORD}{_BLANKS}"), F.lit(0))
    lead = F.when(F.col("piece") == 0, F.regexp_extract("_text", f"^{_BLANKS}", 0)).otherwise("")
    part = F.concat(lead, F.array_join(F.slice(words, (F.col("start_word") + 1).cast("int"), F.col("words").cast("int")), ""))
    return met.withColumn("text", F.when(F.col("n_pieces") == 1, F.col("_text")).otherwise(part)).drop("_id", "_key", "_text")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in bins of 2048 words."""
    return pack_documents(documents(spark, sf_dir))
