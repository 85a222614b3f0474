"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 9).

Candidate rows are cut into blocks; a block keeps a posting list of (slot,
weight) for each term, here a vector component. A query is a sparse row: each of
its non-zero terms scatters its weight times the posting weights into a dense
array with one score a slot. The block's best k come from a partition selection,
and a last step merges the blocks' winners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, partitions

#: Candidates and queries that meet in one task at most, and candidates that are worth a task of their own.
CANDIDATE_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 1 << 15, 1 << 13, 1 << 10
#: Weights up to this, and so many of them, multiply within 64 bits. Rows with larger ones count in integers of any length.
NARROW, NARROW_TERMS = 1 << 24, 1 << 14
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _weights(vector: np.ndarray) -> np.ndarray | None:
    """floor(256 * x) of each component, exactly; of Python's integers where 64 bits may not do; None if one is not finite."""
    if not np.isfinite(vector).all():
        return None
    if len(vector) <= NARROW_TERMS and (not len(vector) or np.abs(vector).max() <= NARROW / 256):
        return np.floor(256.0 * vector).astype(np.int64)
    return np.array([math.floor(256.0 * x) if abs(x) < 1e300 else 256 * int(x) for x in vector.tolist()], dtype=object)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and integer weights of usable rows, zeros left out; wide weights as text."""
    for batch in batches:
        ids, terms, weights, wide = [], [], [], []
        for one, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
            values = vector.values
            if one is None or values is None or values.null_count:
                continue
            scaled = _weights(values.to_numpy(zero_copy_only=False).astype(np.float64))
            if scaled is None:
                continue
            at = np.flatnonzero(scaled != 0)
            ids.append(one), terms.append(at.astype(np.int32))
            narrow = scaled.dtype != object
            weights.append(scaled[at].astype(np.int32) if narrow else None)
            wide.append(None if narrow else [str(x) for x in scaled[at]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.int32())), pa.array(wide, pa.list_(pa.string()))], names=["vec_id", "terms", "weights", "wide"])


def _rows(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """The terms and weights of each row."""
    table = table.combine_chunks()
    out = []
    for terms, weights, wide in zip(*(table.column(c) for c in ("terms", "weights", "wide")), strict=True):
        values = weights.values.to_numpy(zero_copy_only=False).astype(np.int64) if weights.is_valid else np.array([int(x) for x in wide.as_py()], dtype=object)
        out.append((terms.values.to_numpy(zero_copy_only=False), values))
    return out


class Postings:
    """For each term the slots that hold it and their weights."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], slots: list[int]):
        self.slots = np.array(slots, np.int64)
        terms = np.concatenate([rows[k][0] for k in slots]) if slots else np.zeros(0, np.int32)
        weights = np.concatenate([rows[k][1] for k in slots]) if slots else np.zeros(0, np.int64)
        order = np.argsort(terms, kind="stable")
        owner = np.repeat(np.arange(len(slots)), [len(rows[k][0]) for k in slots])[order]
        distinct, first = np.unique(terms[order], return_index=True)
        ends = np.append(first[1:], len(order))
        self.lists = {int(t): (owner[a:b], weights[order[a:b]]) for t, a, b in zip(distinct, first, ends, strict=True)}
        self.weights = weights

    def scores(self, query: tuple[np.ndarray, np.ndarray], kind) -> np.ndarray:
        """Each slot's inner product with the query: its terms, one after the other, add to a dense array."""
        out = np.zeros(len(self.slots), kind)
        for term, weight in zip(query[0].tolist(), query[1].tolist(), strict=True):
            where, values = self.lists.get(term, (None, None))
            if where is not None:
                values = values.astype(object) if kind is object else values
                if len(where) == len(out):
                    out += values * weight
                else:
                    out[where] += values * weight
        return out


def _beyond(score: int) -> str:
    """What orders scores that 64 bits cannot hold: after "1", which stands for those that fit, comes "2...", before it "0..."."""
    if _LEAST <= score <= _MOST:
        return "1"
    digits = str(abs(score))
    return f"2{len(digits):06d}{digits}" if score > 0 else f"0{999_999 - len(digits):06d}" + "".join(str(9 - int(d)) for d in digits)


def _search(k: int):
    kinds = {"q": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "own": pa.bool_(), "score": pa.int64(), "beyond": pa.string()}

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        asked, rows = _rows(queries), _rows(candidates)
        ids = candidates.column("vec_id").to_numpy()
        narrow = [n for n, r in enumerate(rows) if r[1].dtype != object]
        wide = [n for n, r in enumerate(rows) if r[1].dtype == object]
        groups = [Postings(rows, slots) for slots in (narrow, wide) if slots]
        found = []
        for q, query_id, query in zip(queries.column("q").to_pylist(), queries.column("vec_id").to_pylist(), asked, strict=True):
            for postings in groups:
                exact = query[1].dtype == object or postings.weights.dtype == object
                scores = postings.scores(query, object if exact else np.int64)
                same = [at for at in np.flatnonzero(ids[postings.slots] == query_id).tolist() if all(np.array_equal(x, y) for x, y in zip(rows[postings.slots[at]], query, strict=True))]
                # One row in all is the query's own; every other one may be among its best.
                rest = np.arange(len(scores))
                if len(rest) > k + len(same):
                    least = np.sort(scores)[-k - len(same)] if exact else -np.partition(-scores, k + len(same) - 1)[k + len(same) - 1]
                    rest = rest[scores >= least]
                order = sorted(rest.tolist(), key=lambda at: (-scores[at], ids[postings.slots[at]]))[: k + len(same)]
                own = set(same)
                found += [(q, query_id, int(ids[postings.slots[at]]), at in own, max(_LEAST, min(_MOST, int(scores[at]))), _beyond(int(scores[at]))) for at in {*order, *same}]
        return pa.table({name: pa.array([x[n] for x in found], kind) for n, (name, kind) in enumerate(kinds.items())})

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query row.

    Both inputs hold ``vec_id, embedding, ...``. Components count as
    ``floor(256 * x)`` with x as double. Candidates are all usable rows but the query's
    own, which is one row with its vec_id and its vector; ties go to the smaller vec_id; a query with fewer
    candidates gets all of them. Vectors that are null, hold null or non-finite
    components, or lack a vec_id take no part. Rows may differ in length: absent components are zero. Rows that
    repeat a vec_id are candidates one by one and queries one by one. Very large components count exactly, in integers of any length; a
    score that 64 bits cannot hold is ranked as it is and shown as the nearest number that they can. Further columns are ignored; empty tables give no rows.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    sparse = "vec_id long, terms array<int>, weights array<int>, wide array<string>"

    def read(df: DataFrame, name: str) -> DataFrame:
        cast = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return scratch.save(cast.mapInArrow(_sparse, sparse).withColumn("q", F.monotonically_increasing_id()), name)

    rows, asked = read(vectors, "candidates"), read(queries, "queries")
    n_rows, n_asked = rows.count(), asked.count()
    blocks = max(1, math.ceil(n_rows / CANDIDATE_BLOCK), min(partitions(scratch.spark), math.ceil(n_rows / LEAST_BLOCK)))
    sets = max(1, math.ceil(n_asked / QUERY_BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("q"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = rows.withColumn("block", deal(blocks)).withColumn("part", every(sets))
    asked = asked.withColumn("part", deal(sets)).withColumn("block", every(blocks))
    columns = ["q", "vec_id", "terms", "weights", "wide"]
    search = _search(k)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return search(left.select(columns), right.select(columns))

    near = asked.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInArrow(meet, "q long, query_id long, vec_id long, own boolean, score long, beyond string")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    own = F.when(F.col("own"), F.row_number().over(Window.partitionBy("q", "own").orderBy("vec_id")))
    others = near.withColumn("_own", own).where("_own is null or _own > 1")
    return others.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: all vectors whose vec_id is divisible by 50; candidates: all vectors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"), 5)
