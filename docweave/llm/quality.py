"""Quality classifier by a Kneser-Ney language model of trusted text (operator 6).

An interpolated modified Kneser-Ney model over UTF-8 bytes is trained on a
bounded sample of trusted texts. Its counts are tables that are joined with each
other, sharded by n-gram: totals and discounts of each history, and the
probabilities of the next shorter n-grams. The finished model, whose size the
sample bounds, then gives every document's perplexity per byte, and a document
is kept unless that is above a quantile that trusted texts of its own language,
not used in training, have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import Scratch, documents, text_slices, whole_row

#: Bytes in an n-gram, at most 7.
ORDER = 6
#: The sample: so many trusted rows at most. Two of three may train the model, those whose bytes fit into what the bound leaves.
SAMPLE_ROWS, TRAIN_BYTES = 9000, 4 << 20
#: Quantile of the held rows' perplexity, and the rows of a language below which all languages' rows set its threshold.
QUANTILE, LEAST_ROWS = 0.99, 40
#: Accuracy of the quantiles: their rank is off by one part in so many of the held rows at most.
SKETCH = 10_000
#: What each n-gram gives to the shorter history at least, so that no byte has probability 0 after few training bytes.
LEAST_DISCOUNT = 0.1
_PAD = 10


def _padded(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, each after ``order - 1`` newlines, and the places of their bytes."""
    sizes = np.diff(bounds)
    shift = np.repeat(np.arange(1, len(sizes) + 1) * (order - 1), sizes)
    where = np.arange(len(data)) + shift
    row = np.full(len(data) + len(sizes) * (order - 1), _PAD, np.uint8)
    row[where] = data
    return row, where


def _grams(row: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each place, as a number."""
    out = np.zeros(len(where), np.int64)
    for k in range(n - 1, -1, -1):
        out = (out << 8) | row[where - k]
    return out


def train(scratch: Scratch, texts: DataFrame, order: int = ORDER) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: n-grams with their log10 probabilities, and histories with the log10 weight of the shorter history."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column("text")):
                grams, counts = np.unique(_grams(*_padded(data, bounds, order), order), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])

    counts = {order: scratch.save(texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), f"counts{order}")}
    for n in range(order - 1, 0, -1):  # below the full length an n-gram counts once for each byte that comes before it
        suffix = F.col("gram").bitwiseAND((1 << 8 * n) - 1)
        counts[n] = counts[n + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n"))
    tables, histories = {}, {}
    for n in range(1, order + 1):
        met = {r["n"]: r["met"] for r in counts[n].where("n <= 4").groupBy("n").agg(F.count("*").alias("met")).collect()}
        n1, n2, n3, n4 = (met.get(k, 0) for k in (1, 2, 3, 4))
        y = n1 / max(1, n1 + 2 * n2)
        cut = [max(LEAST_DISCOUNT, d) for d in (1 - 2 * y * n2 / max(1, n1), 2 - 3 * y * n3 / max(1, n2), 3 - 4 * y * n4 / max(1, n3))]
        off = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
        own = counts[n].withColumn("history", F.shiftright("gram", 8)).withColumn("off", off)
        per_history = own.groupBy("history").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("left"))
        joined = own.join(per_history, "history")
        direct = (F.col("n") - F.col("off")) / F.col("total")
        if n == 1:
            probability = joined.select("gram", (direct + F.col("left") / 256).alias("p"))
        else:
            shorter = tables[n - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("p_shorter"))
            suffix = F.col("gram").bitwiseAND((1 << 8 * (n - 1)) - 1)
            probability = joined.withColumn("suffix", suffix).join(shorter, "suffix").select("gram", (direct + F.col("left") * F.col("p_shorter")).alias("p"))
        tables[n] = scratch.save(probability, f"level{n}")
        histories[n] = per_history.select("history", "left")
    # The sample bounds what comes to the driver: at most one n-gram of each length for each of its bytes.
    model = {}
    for n in range(1, order + 1):
        grams, left = tables[n].orderBy("gram").toArrow(), histories[n].orderBy("history").toArrow()
        with np.errstate(divide="ignore"):
            model[n] = (grams["gram"].to_numpy(), np.log10(grams["p"].to_numpy()).astype(np.float32), left["history"].to_numpy(), np.log10(left["left"].to_numpy()).astype(np.float32))
    return model


def log_probabilities(model: dict[int, tuple[np.ndarray, ...]], data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The summed log10 probability of each text's bytes."""
    order = max(model)
    row, where = _padded(data, bounds, order)
    keys = _grams(row, where, order)
    out = np.zeros(len(where))
    todo = np.arange(len(where))
    for n in range(order, 0, -1):
        grams, weights, known, left = model[n]
        if not len(grams):
            continue
        key = keys[todo] & ((1 << 8 * n) - 1)
        at = np.minimum(np.searchsorted(grams, key), len(grams) - 1)
        hit = grams[at] == key
        out[todo[hit]] += weights[at[hit]]
        todo, history = todo[~hit], key[~hit] >> 8
        at = np.minimum(np.searchsorted(known, history), len(known) - 1)
        hit = known[at] == history
        out[todo[hit]] += left[at[hit]]
    out[todo] += np.log10(1 / 256)
    sums = np.zeros(len(bounds) - 1)
    some = np.diff(bounds) > 0
    if some.any():
        sums[some] = np.add.reduceat(out, bounds[:-1][some])
    return sums


def training_rows(sample: list[tuple], bound: int) -> list[tuple]:
    """Of sampled ``(..., bytes)`` rows in order those that train: two of three, passing over the ones that the bound has no room for.

    If none has room the shortest one trains, so some row always does.
    """
    left, out = bound, []
    for k, row in enumerate(sample):
        if k % 3 != 2 and row[-1] <= left:
            out.append(row)
            left -= row[-1]
    return out or sorted(sample, key=lambda row: row[-1])[:1]


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, columns: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` with ``perplexity`` (per byte), ``threshold`` and ``kept``.

    Trusted are documents with ``labels.quality = 1`` and not ``toxic = 1``. A
    hash of doc_id picks up to ``SAMPLE_ROWS`` of those with a text. Of these two of
    three train the model, as far as they fit into ``TRAIN_BYTES``; a longer text is passed
    over, not cut, and if none fits the shortest trains. All trusted documents
    that did not train, one row a doc_id, give the thresholds, one for each
    language. Languages with fewer than ``LEAST_ROWS`` of these, and null, have the
    threshold of all. A threshold's rank is off by one part in ``SKETCH`` at most.
    ``columns`` picks the columns of ``docs`` to keep (all by default).

    Null and empty texts have no perplexity and are not kept. Without any
    trusted text nothing can be judged: perplexity and threshold are null and
    all texts that are not empty are kept; if all trusted texts train, so does
    the lack of a threshold. Repeated rows are judged alike. Of rows that repeat a trusted doc_id the one with the
    shortest text (of these the least hash) may train, and the one with the first language and the least
    perplexity counts for the threshold. A null doc_id is judged but never trains. Very long texts are judged whole, in slices. Further columns are kept, but for those
    named like the added ones. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) <> 1 and doc_id is not null").select("doc_id").distinct()
    # Lengths first: texts are only read of the rows that train. What comes to the driver is bounded by SAMPLE_ROWS.
    sizes = docs.where("text <> ''").select("doc_id", F.struct(F.octet_length("text").cast("long").alias("n"), F.xxhash64("text").alias("key")).alias("one"))
    sizes = sizes.join(trusted.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("one").alias("one"))
    sample = [(r["doc_id"], r["key"], r["n"]) for r in sizes.orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(SAMPLE_ROWS).select("doc_id", "one.key", "one.n").collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame(training_rows(sample, TRAIN_BYTES), f"doc_id {kind}, _key long, _n long").drop("_n")
    chosen = docs.select("doc_id", "text", F.xxhash64("text").alias("_key")).join(F.broadcast(picked), ["doc_id", "_key"])
    chosen = scratch.save(chosen.dropDuplicates(["doc_id"]).select("doc_id", "text"), "chosen")
    model = train(scratch, chosen, order)
    ready = len(model[1][0]) > 0
    chosen_columns = docs if columns is None else docs.select(*columns)
    whole = "text" in chosen_columns.columns
    added = ("perplexity", "threshold", "kept")
    names = ["_id", "_key", "_of", "_some"]
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.col("lang").alias("_of"), F.coalesce(F.col("text") != "", F.lit(False)).alias("_some"), F.col("text").alias("_text"), *([] if whole else [whole_row(chosen_columns, added).alias("_in")]))
    names += [] if whole else ["_in"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, bounds in text_slices(batch.column("_text")):
                sizes = np.diff(bounds)
                with np.errstate(divide="ignore", invalid="ignore"):
                    values = 10 ** (-log_probabilities(model, data, bounds) / sizes)
                found.append(pa.array(values, pa.float64(), mask=(sizes == 0) | (not ready)))
            added = pa.concat_arrays(found) if found else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), added], names=[*names, "perplexity"])

    scored = rows.mapInArrow(measure, T.StructType([*(rows.schema[c] for c in names), T.StructField("perplexity", T.DoubleType())]))
    scored = scratch.save(scored, "scored")

    # The training rows are as few as the sample; the trusted rows are not, so they meet by a shuffle at every size.
    held = scored.where("perplexity is not null").select("_id", "_of", "perplexity").join(trusted.hint("merge"), F.col("_id") == F.col("doc_id"), "left_semi")
    held = held.join(F.broadcast(chosen.select(F.col("doc_id").alias("_t"))), F.col("_id") == F.col("_t"), "left_anti")
    held = scratch.save(held.groupBy("_id").agg(F.min(F.struct("_of", "perplexity")).alias("one")).select(F.col("one._of").alias("lang"), "one.perplexity"), "held")
    at = F.percentile_approx("perplexity", quantile, SKETCH)
    each = held.groupBy("lang").agg(at.alias("own"), F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).select(F.col("lang").alias("_lang"), "own")
    if whole:
        # Scores were written without their texts, which meet them again here; rows that repeat id and text have one score.
        found = scored.where("perplexity is not null").groupBy(F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_id"), "_key").agg(F.min("perplexity").alias("perplexity"))
        texts = docs.select(whole_row(chosen_columns, added).alias("_in"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.xxhash64("text").alias("_key"), F.col("lang").alias("_of"), F.coalesce(F.col("text") != "", F.lit(False)).alias("_some"))
        scored = texts.join(found.hint("merge"), ["_id", "_key"], "left")
    # One row a language of the held rows.
    out = scored.join(F.broadcast(each), F.col("_of") == F.col("_lang"), "left").join(F.broadcast(held.agg(at.alias("every"))))
    out = out.withColumn("threshold", F.coalesce("own", "every"))
    kept = F.col("_some") & (F.col("threshold").isNull() | F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(not ready)))
    return out.select("_in.*", "perplexity", "threshold", kept.alias("kept"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by a model of those that labels call good."""
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id", "lang"]).select("doc_id", "lang", "perplexity", "threshold", "kept")
