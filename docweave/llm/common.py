"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.store import Store, bound_batches

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one vectorised step handles; temporary arrays take about sixty times as much.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_CODE[_SPACE] = 0
_BYTE_CODE[65:91] = _BYTE_CODE[97:123]  # A-Z count as a-z


class Scratch(Store):
    """Intermediate tables of one operator call, in the folder that all executors share."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        bound_batches(spark)


@contextmanager
def shuffle_files_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, a write deletes its shuffle files when it ends, so those of finished steps take no disk beside those of the next."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_row(docs: DataFrame, added: tuple[str, ...]) -> Column:
    """The row as one struct column, so that its names clash with none in between.

    Columns named like those that an operator adds are left out: the added ones take their place.
    """
    taken = {name.lower() for name in added}
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def word_count(text: str = "text"):
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, UTF-8 bytes, row offsets)`` of consecutive rows with about ``limit`` bytes together."""
    column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some rows, A-Z in lower case, and each row's offsets into them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~word[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh & word)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    place = np.arange(len(data))
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(place.max()), _BASE)]))
    hashes = mix(np.add.reduceat(_BYTE_CODE[data] * powers[place], starts))
    return hashes, np.searchsorted(starts, bounds)


def iter_words(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row of a text column the hashes of its words."""
    for _, _, data, bounds in text_slices(column):
        hashes, at = word_hashes(data, bounds)
        for k in range(len(at) - 1):
            yield hashes[at[k] : at[k + 1]]
