"""Vector similarity and search, exact, for one query vector or many."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import any_keyword
from docweave.operators.graph import paths

#: Questions and vectors that meet in one task.
QUESTION_BLOCK, VECTOR_BLOCK = 1024, 8192
#: Scores that a task holds at once.
SCORES = 1 << 20
#: Weights of the hybrid score; a keyword hit scores 0.3 before its weight.
SEMANTIC, KEYWORD, HIT = 0.6, 0.3, 0.3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; null for null, zero, empty or unequally long ones."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.nullif(norms, F.lit(0.0))))


def vector(*columns: str) -> Column:
    """The first of the vector columns that is neither null nor empty, in doubles."""
    return F.coalesce(*[F.when(F.size(c) > 0, F.col(c).cast("array<double>")) for c in columns])


def semantic_topk(nodes: DataFrame, query: list[float], k: int, least: float = 0.1, vector_column: str = "embedding", key: str = "id") -> DataFrame:
    """The ``k`` nearest nodes with a cosine of at least ``least``; ties by key."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = nodes.withColumn("similarity", cosine(vector(vector_column), literal))
    # The threshold comes last: before the sort it would have every similarity computed twice.
    return scored.orderBy(F.desc("similarity"), key).limit(k).where(F.col("similarity") >= least)


def hybrid_scores(nodes: DataFrame, query: list[float], keywords: list[str] | None = None) -> DataFrame:
    """Nodes ``label, text, name, summary, description, embedding`` with the parts of their hybrid score and their sum."""
    text = F.length(F.coalesce("text", F.lit("")))
    hit = any_keyword([F.col(c) for c in ("text", "name", "summary", "description")], F.array(*map(F.lit, keywords))) if keywords else F.lit(False)
    out = nodes.where("embedding is not null").withColumns(
        {
            "semantic_score": cosine(vector("embedding"), F.array(*[F.lit(float(x)) for x in query])),
            "keyword_score": F.when(hit, HIT).otherwise(0.0),
            "type_bonus": F.when(F.col("label") == "Document", 0.1).when(F.col("label") == "Chunk", 0.05).otherwise(0.0),
            "content_bonus": F.when(text < 50, -0.1).when(text > 500, 0.05).otherwise(0.0),
        }
    )
    total = F.col("semantic_score") * SEMANTIC + F.col("keyword_score") * KEYWORD + F.col("type_bonus") + F.col("content_bonus")
    return out.withColumn("combined_score", total)


def scoped(nodes: DataFrame, edges: DataFrame, document: str, most: int = 3) -> DataFrame:
    """The nodes one to ``most`` CONTAINS edges below a document; an unknown document is an error."""
    known = nodes.where((F.col("id") == document) & (F.col("label") == "Document"))
    if known.isEmpty():
        raise ValueError(f"no document {document}")
    seed = known.select(F.col("id").alias("seed")).distinct()
    below = paths(edges.where("type = 'CONTAINS'"), seed, 1, most).select(F.col("node").alias("id")).distinct()
    return nodes.join(below, "id", "left_semi")


def hybrid_topk(nodes: DataFrame, query: list[float], keywords: list[str] | None = None, k: int = 10, least: float = 0.1, key: str = "id") -> DataFrame:
    return hybrid_scores(nodes, query, keywords).orderBy(F.desc("combined_score"), key).limit(k).where(F.col("combined_score") >= least)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the lists of column ``v``, all their values, and where each begins."""
    lists = table.column("v").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])


def batch_topk(vectors: DataFrame, questions: DataFrame, k: int, least: float = -1.0, key: str = "id", weight: float = 1.0, bonus: str | None = None) -> DataFrame:
    """``question, <key>, similarity, rank``: each question's ``k`` nearest vectors; ties by key.

    With ``weight`` and ``bonus``, a column of the vectors, ``similarity`` is the cosine times the one plus the other.

    Both sides are dealt into blocks, ``QUESTION_BLOCK`` questions and
    ``VECTOR_BLOCK`` vectors on average. Each two blocks meet in one task, which
    multiplies them, some questions at a time (``SCORES``), and passes on each question's best k, ties of the last among
    them. The driver sees two counts.
    """
    asked = questions.select("question", vector("embedding").alias("v")).where("v is not null")
    rows = vectors.select(F.col(key).alias("k"), vector("embedding").alias("v"), (F.col(bonus).cast("double") if bonus else F.lit(0.0)).alias("b")).where("v is not null")
    sets, blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((asked, QUESTION_BLOCK), (rows, VECTOR_BLOCK)))
    deal = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("part", deal(sets, "question", "v")).withColumn("block", every(blocks))
    rows = rows.withColumn("block", deal(blocks, "k", "v")).withColumn("part", every(sets))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        (q_sizes, q_flat, q_starts), (sizes, flat, starts) = map(_flat, (left, right))
        extra = right.column("b").to_numpy()
        found = []
        for size in np.unique(q_sizes):
            members, at = np.flatnonzero(q_sizes == size), np.flatnonzero(sizes == size)
            if not len(at):
                continue
            m = flat[starts[at][:, None] + np.arange(size)]
            lengths, step = np.linalg.norm(m, axis=1), max(1, SCORES // len(at))
            for some in (members[first : first + step] for first in range(0, len(members), step)):
                q = q_flat[q_starts[some][:, None] + np.arange(size)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = (q @ m.T) / (np.linalg.norm(q, axis=1)[:, None] * lengths) * weight + extra[at]
                for n, row in zip(some, scores, strict=True):
                    good = np.flatnonzero(row >= least)
                    if len(good) > k:
                        cut = np.partition(row[good], len(good) - k)[len(good) - k]
                        good = good[row[good] >= cut]
                    found.append((np.full(len(good), n), at[good], row[good]))
        n, i, s = (np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in range(3))
        return pa.table({"question": left.column("question").take(pa.array(n.astype(np.int64))), key: right.column("k").take(pa.array(i.astype(np.int64))), "similarity": pa.array(s.astype(np.float64))})

    kinds = questions.schema["question"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    out = asked.groupBy("part", "block").cogroup(rows.groupBy("part", "block")).applyInArrow(nearest, f"question {kinds[0]}, `{key}` {kinds[1]}, similarity double")
    best = Window.partitionBy("question").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
