"""Ranked lexical search by MaxScore within shards (operator 11).

Documents are indexed once for a set of items: a shard of documents is one row
with the posting lists of the items' terms. Statistics of the corpus are sums
over shards. A shard then ranks each item. Its terms are sorted by upper bound,
the most that any document of the shard gets from them. The terms whose bounds
together stay below the item's threshold, its k-th score so far, are
non-essential: no document qualifies by them alone. Essential posting lists are
added up; documents that they hit are looked up in the non-essential
lists, highest bound first, only while score and remaining bounds reach the threshold.
Thresholds go on from shard to shard in a task; winners of tasks meet in a window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, documents

#: Documents, and bytes of their texts, after which a shard ends.
SHARD_DOCS, SHARD_BYTES = 2048, 8 << 20
#: Bytes of item texts that are looked up in one pass; more items take more passes, so what goes to all tasks is bounded.
SET_BYTES = 4 << 20
_KEEP = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
_INDEX = "n_docs long, n_terms long, doc_ids array<long>, sizes array<long>, terms array<int>, df array<long>, slots binary, tfs binary"
_FOUND = "q long, item_id long, doc_id long, score long"


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: ASCII letters, in lower case, digits, and all that is not ASCII."""
    return raw.translate(_TABLE).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()))


def _indexed(vocabulary: dict[bytes, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("slots", pa.binary()), ("tfs", pa.binary())])

    def shard(ids: list, sizes: list[int], postings: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
        known = sorted(postings)
        flat = np.array([x for t in known for x in postings[t]], np.int64).reshape(-1, 2)
        row = [len(ids), sum(sizes), ids, sizes, known, [len(postings[t]) for t in known], flat[:, 0].astype(np.int32).tobytes(), flat[:, 1].astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, postings, held = [], [], {}, 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), _texts(batch.column("text")), strict=True):
                counts = Counter(terms_of(raw))
                if not counts:
                    continue
                for term in counts.keys() & vocabulary.keys():
                    postings.setdefault(vocabulary[term], []).append((len(ids), counts[term]))
                ids.append(doc_id), sizes.append(counts.total())
                held += len(raw)
                if len(ids) >= SHARD_DOCS or held >= SHARD_BYTES:
                    yield shard(ids, sizes, postings)
                    ids, sizes, postings, held = [], [], {}, 0
        if ids:
            yield shard(ids, sizes, postings)

    return run


class Shard:
    """The posting lists of a shard, with what each posting adds to a score for each unit of its term's weight."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        ids = row["doc_ids"]
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        self.no_id = np.array([x is None for x in ids], bool)
        slots, tfs = np.frombuffer(row["slots"], np.int32), np.frombuffer(row["tfs"], np.int64)
        wide = 25 * max(row["sizes"], default=0) * n_docs >= 1 << 63
        sizes = np.array(row["sizes"], object if wide else np.int64)
        length = (75 + 25 * sizes * n_docs // max(n_terms, 1)).astype(np.int64)
        gains = 1_000_000_000 * tfs // (1000 * tfs + 12 * length[slots])
        at = np.concatenate([[0], np.cumsum(row["df"])]).astype(np.int64)
        self.lists = {t: (slots[a:b], gains[a:b], int(gains[a:b].max())) for t, a, b in zip(row["terms"], at[:-1].tolist(), at[1:].tolist(), strict=True)}

    def best(self, weighted: list[tuple[int, int]], k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """``(slots, scores)``: all documents that score at least ``threshold``, but for some that at least ``k`` others of the shard beat."""
        held = sorted((w * self.lists[t][2], w, t) for t, w in weighted if t in self.lists)
        bounds = np.cumsum([bound for bound, _, _ in held])
        first = int(np.searchsorted(bounds, threshold, "left"))
        scores = np.zeros(len(self.ids), np.int64)
        for _, w, t in held[first:]:
            slots, gains, _ = self.lists[t]
            scores[slots] += w * gains
        alive = np.flatnonzero(scores)
        if len(alive) > k:
            threshold = max(threshold, int(np.partition(scores[alive], -k)[-k]))
        for at in range(first - 1, -1, -1):
            alive = alive[scores[alive] + bounds[at] >= threshold]
            _, w, t = held[at]
            slots, gains, _ = self.lists[t]
            where = np.minimum(np.searchsorted(slots, alive), len(slots) - 1)
            hit = slots[where] == alive
            scores[alive[hit]] += w * gains[where[hit]]
        alive = alive[scores[alive] >= threshold]
        return alive, scores[alive]


def _ranked(items: list[tuple[int, int | None, list[tuple[int, int]]]], n_docs: int, n_terms: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For each item scores, doc_ids and whether they are null, best first.
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(items)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n_docs, n_terms)
                for n, (_, _, weighted) in enumerate(items):
                    scores, ids, no_id = best[n]
                    slots, found = shard.best(weighted, k, int(scores[-1]) if len(scores) == k else 1)
                    if len(slots):
                        scores, ids, no_id = np.concatenate([scores, found]), np.concatenate([ids, shard.ids[slots]]), np.concatenate([no_id, shard.no_id[slots]])
                        order = np.lexsort((ids, no_id, -scores))[:k]
                        best[n] = scores[order], ids[order], no_id[order]
        for (q, item_id, _), (scores, ids, no_id) in zip(items, best, strict=True):
            if len(scores):
                n = len(scores)
                yield pa.RecordBatch.from_arrays([pa.array([q] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(ids, pa.int64(), mask=no_id), pa.array(scores, pa.int64())], names=["q", "item_id", "doc_id", "score"])

    return run


def _search(scratch: Scratch, docs: DataFrame, asked: list, k: int, name: str) -> DataFrame:
    """The best of every task for the items of one set, ``q, item_id, raw text`` each."""
    counts = [Counter(terms_of(bytes(row["raw"]))) for row in asked]
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
    index = scratch.save(docs.mapInArrow(_indexed(vocabulary), _INDEX), f"index{name}")
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    lists = index.select(F.inline(F.arrays_zip("terms", "df"))).groupBy("terms").agg(F.sum("df").alias("df"))
    weight = {r["terms"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in lists.collect()}  # no more than the set's terms
    weighted = [[(vocabulary[t], weight[vocabulary[t]] * n) for t, n in c.items() if vocabulary[t] in weight] for c in counts]
    items = [(row["q"], row["item_id"], terms) for row, terms in zip(asked, weighted, strict=True)]
    return index.mapInArrow(_ranked(items, n_docs, n_terms, k), _FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each item.

    ``docs(doc_id, text, ...)`` and ``items(item_id, text, ...)``; further columns are ignored. Texts are
    read whole; null and empty ones have no terms, so they neither count nor are found, and such items
    find nothing. Rows that repeat are documents, and items, one by one, so rank 1 comes once for each row of an item_id.
    Equal scores go by doc_id, null last. Empty tables give no rows.

    Items go to all tasks, ``SET_BYTES`` of text at a time; each further set reads the documents once more.
    """
    scratch = Scratch(docs.sparkSession, "search")
    asked = items.select(F.monotonically_increasing_id().alias("q"), F.col("item_id").cast("long").alias("item_id"), F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8").alias("raw"))
    asked = scratch.save(asked, "items")
    sets = max(1, math.ceil((asked.agg(F.sum(F.length("raw"))).first()[0] or 0) / SET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for n in range(sets):
        some = asked.where(F.pmod(F.xxhash64("q"), F.lit(sets)) == n).orderBy("q").collect()
        part = _search(scratch, rows, some, k, str(n))
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for every benchmark item, the best 20 of each."""
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)
