"""Filter interaction audit by the subset-zeta transform (operator 13).

Each document gets a mask with one bit for each filter that it fails. Masks are
counted for each part, so at most ``2 ** filters`` rows of a part leave a task.
The subset-zeta transform turns a part's mask counts into the sums over all
subsets of each mask: the documents that fail nothing outside it, which are the
survivors of the other filters. What a filter removes after others is then the
difference between two neighbouring subsets, for every order, and so for labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, documents

#: One letter for each bit of a mask, lowest first.
FILTERS = "ABCDE"
_BLANKS = r"[\x20\x09-\x0D]+"
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_COUNTED = ("n", "good", "toxic")


def zeta(counts: np.ndarray, filters: int) -> np.ndarray:
    """``out[..., mask]``: the sum of ``counts`` over all subsets of ``mask``; one addition of halves for each bit."""
    out = counts.copy()
    for bit in range(filters):
        halves = out.reshape(*out.shape[:-1], -1, 2, 1 << bit)
        halves[..., 1, :] += halves[..., 0, :]
    return out


def _steps(filters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders, and for each order and step the subset applied before it and the step's own bit."""
    orders = ["".join(p) for p in permutations(filters)]
    own = np.array([[1 << filters.index(letter) for letter in order] for order in orders])
    return orders, np.cumsum(own, axis=1) - own, own


def _audit(filters: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size, names = 1 << len(filters), [x.split(" ")[0] for x in _SCHEMA.split(", ")]
    orders, before, own = _steps(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(_COUNTED), size), np.int64)
            for k, masks in enumerate(batch.column("masks").to_pylist()):
                for row in masks:
                    counts[k, :, row["mask"]] = [row[c] for c in _COUNTED]
            # The survivors of a subset fail at most what is outside it.
            survivors = zeta(counts, len(filters))[..., ::-1]
            lost = survivors[..., before] - survivors[..., before | own]
            kept, removed = survivors[:, 0][:, before | own], lost[:, 0]
            fails = survivors[:, 0, :1, None] - survivors[:, 0][:, own]
            unique = survivors[:, 0][:, (size - 1) ^ own] - survivors[:, 0, -1, None, None]
            total = np.zeros((batch.num_rows, size), np.int64)
            for bit in np.unique(own):
                total[:, bit] = (removed * (own == bit)).sum(axis=(1, 2))
            values = [kept, removed, fails - removed, unique, lost[:, 1], lost[:, 2], total[:, own]]
            each = own.size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), each))),
                    pa.array(np.tile(np.repeat(orders, len(filters)), batch.num_rows).tolist(), pa.string()),
                    pa.array(np.tile(np.arange(1, len(filters) + 1), batch.num_rows * len(orders)), pa.int32()),
                    *[pa.array(np.ascontiguousarray(v).ravel(), pa.int64()) for v in values],
                ],
                names=names,
            )

    return run


def audit_masks(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of ``filters`` and step, from ``masks(part, mask, good, toxic, ...)``.

    ``mask`` has bit ``k`` where a document fails ``filters[k]`` (null: fails none);
    ``good`` and ``toxic`` are booleans (null: false). The orders are all
    permutations, so their number bounds the letters to a few.
    """
    if len(set(filters)) != len(filters) or not 0 < math.factorial(len(filters)) <= 5040:
        raise ValueError("filters are one to seven different letters")
    counted = masks.groupBy("part", F.coalesce(F.col("mask"), F.lit(0)).cast("int").alias("mask")).agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTED)).alias("masks"))
    return parts.mapInArrow(_audit(filters), _SCHEMA)


def text_mask(text: str) -> Column:
    """The bits A to D of a text that is not null; ``_words`` holds its words."""
    words, different = F.size("_words").cast("long"), F.size(F.array_distinct("_words"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [words < 50, 100 * different < 65 * words, 100 * capitals > 5 * F.length(text), F.col(text).rlike("[#$%&*|]")]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, doc_id, mask, good, toxic`` of each row of ``docs(doc_id, text, source, ...)``.

    A text without words fails A only, besides E if it repeats: null counts as the empty text. A row fails E if
    a row with a smaller doc_id anywhere in the table has the same text (128-bit
    hash); rows of one doc_id do not fail for one another, and a null doc_id is
    neither smaller nor larger. Repeated rows count one by one. Labels of one doc_id count together: good or toxic if any row
    of ``labels(doc_id, quality, toxic, ...)`` says so. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", _BLANKS, -1), ""))
    rows = scratch.save(rows.select("part", "doc_id", F.unhex(F.md5("_text")).alias("key"), text_mask("_text").alias("mask")), "rows")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = scratch.save(first, "first")
    named = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    named = scratch.save(named.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("salt"), "good", "toxic"), "labels")
    # By shuffles that adaptive execution splits, so that all sizes behave alike; null doc_ids are dealt out by their text.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(0)
    found = rows.join(first.hint("merge"), "key", "left").withColumn("salt", salt).join(named.hint("merge"), ["doc_id", "salt"], "left")
    repeats = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return found.select("part", "doc_id", (F.col("mask") + repeats).alias("mask"), "good", "toxic")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over ``docs`` and ``labels``; empty tables of documents give no rows."""
    return audit_masks(document_masks(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by source, with their labels."""
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
