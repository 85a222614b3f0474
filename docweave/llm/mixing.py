"""Mixing sources to target weights by Pareto order sampling (operator 5).

Every source gets a target number of words. How often a document of it is wanted
depends on its length: documents of ``2 ** k`` words weigh ``2 ** (-k * DAMPING)``, so
long ones are repeated less, and the source's level, times that weight and at most
``max_copies``, is the number of copies that makes the expected words equal the
target. So many whole copies are certain; the fraction is the document's
inclusion probability. For the fractions the documents of a source are ranked by
their random odds divided by their inclusion odds (Rosen, 1997), and the sample,
whose size is fixed in words, takes each document in that order that still fits
what the certain copies leave. At last the first document left in the order with which the source
comes nearer to its target closes the gap.

The order is never sorted as a whole: ranks fall into about ``sqrt(rows)``
buckets, whose sizes are summed before any shuffle; only the one bucket of each
source in which a document does not fit is put in order. That is repeated behind
this document, for those that the gap has room for, until none is left. Each time
the gap is smaller than the document that did not fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, documents, whole_row, word_count

#: Weights of the sources in code point order, again from the first after the last.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
MAX_COPIES = 3
#: Exponent by which a document's weight falls with its number of words.
DAMPING = 0.125
_BITS = 53


def random_number(doc_id: str | Column, key: str | Column, seed: int) -> Column:
    """A document's number between 0 and 1, the same in every run."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, key, F.lit(seed)), 64 - _BITS) + F.lit(0.5)) / F.lit(float(1 << _BITS))


def octave(size: Column) -> Column:
    """The power of two that a number of words lies at or above; 0 for none."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, with ``target``.

    The sources share the sum of all sizes by weight. No target exceeds
    ``max_copies`` times its source's size; what is above is shared again by
    weight among the others. That ends at ``least(cap, level * weight)`` for the
    greatest level that some number of the soonest capped sources leave.
    The windows hold one row a source.
    """
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    capped = placed.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = capped.withColumn("level", left / share)
    return level.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight"))).drop("place", "weight", "cap", "level")


def copies_by_length(words: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``words(source, octave, words, target, source_size)``, one row a source and octave, with ``times``: the copies wanted of each document.

    ``times`` is ``least(max_copies, level * weight)``, where the level of a source is the
    one at which ``times * words`` sums to its target: the greatest that some number
    of the octaves first capped leave. A window holds a source's octaves, some dozens.
    """
    weighed = words.withColumn("weight", F.pow(F.lit(2.0), -F.col("octave") * DAMPING))
    whole = Window.partitionBy("source")
    before = whole.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("target") - F.coalesce(F.sum(F.col("words") * float(max_copies)).over(before), F.lit(0.0))
    share = F.sum(F.col("words") * F.col("weight")).over(whole) - F.coalesce(F.sum(F.col("words") * F.col("weight")).over(before), F.lit(0.0))
    level = weighed.withColumn("level", F.when(share > 0, left / share))
    times = F.least(F.lit(float(max_copies)), F.max("level").over(whole) * F.col("weight"))
    capped = F.col("target") >= F.col("source_size") * max_copies
    out = level.withColumn("times", F.when(F.col("source_size") == 0, 0.0).when(capped, float(max_copies)).otherwise(F.greatest(times, F.lit(0.0))))
    return out.drop("weight", "level")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 1, columns: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with ``size, source_size, target, copies, taken``.

    ``size`` is the number of words, ``copies`` how often the mix takes the
    document and ``taken`` their product. ``columns`` picks the columns of
    ``docs`` to keep (all by default). Of each source the sample passes over the
    documents that would exceed the target, until no other one fits; then the
    first one left in the order with less than twice the gap's words closes it.

    Null texts have size 0. A null source is a source of its own, after all
    others. Very long texts are whole, a source's only text too: it is taken as often as
    comes nearest, so the source may miss its target by half that text. Random numbers depend on doc_id, text and ``seed`` alone, so reruns
    agree and rows that repeat doc_id, source and text share one fate; ties of rank are in the order of
    doc_id and the text's hash. Further
    columns are kept, but for those named like the added ones. An empty table
    gives an empty result. Targets and their windows hold one row a source, which has to fit one task
    (millions do).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    chosen = docs if columns is None else docs.select(*columns)
    whole = docs.select(
        whole_row(chosen, ("size", "source_size", "target", "copies", "taken")).alias("_in"),
        F.struct(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.xxhash64("text", F.lit(seed)).alias("key")).alias("_row"),
        word_count().alias("size"),
    )
    if "text" not in chosen.columns:
        whole = scratch.save(whole, "rows")
        rows = whole
    else:
        rows = scratch.save(whole.select("_row", "size"), "rows")
    n = rows.count()
    steps = max(64, math.ceil(math.sqrt(n)))

    words = scratch.save(rows.groupBy(F.col("_row.of").alias("source"), octave(F.col("size")).alias("octave")).agg(F.sum("size").alias("words")), "words")
    targets = source_targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies).withColumnRenamed("source", "_s")
    plan = copies_by_length(words.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), max_copies)
    plan = plan.withColumn("certain", F.floor("times").cast("long")).withColumn("chance", F.col("times") - F.col("certain"))
    plan = scratch.save(plan, "plan")

    def ranked(df: DataFrame) -> DataFrame:
        """With the rank in the Pareto order and its bucket."""
        odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("chance") / (1 - F.col("chance")))
        out = df.withColumn("_u", random_number("_row.id", "_row.key", seed)).withColumn("_rank", F.when(F.col("chance") > 0, odds))
        out = out.withColumn("_bucket", F.least(F.floor(F.col("_rank") / (1 + F.col("_rank")) * steps), F.lit(steps - 1)).cast("long"))
        return out.withColumn("_order", F.struct("_rank", F.col("_row.id"), F.col("_row.key"))).drop("_u")

    def joined(df: DataFrame, more: DataFrame, how: str = "left", by_length: bool = False) -> DataFrame:
        same = F.col("_row.of").eqNullSafe(F.col("_of"))
        if by_length:
            more, same = more.withColumnRenamed("octave", "_octave"), same & (octave(F.col("size")) == F.col("_octave"))
        return df.join(more.withColumnRenamed("source", "_of"), same, how).drop("_of", "_octave")

    known = joined(rows, plan.select("source", "octave", "chance"), by_length=True)
    drawn = scratch.save(ranked(known).where("_rank is not null").select("_row", "size", "_bucket", "_order"), "drawn")
    kind = drawn.select("_order").schema[0].dataType.simpleString()
    wanted = plan.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("words"))).alias("wanted"), F.max("chance").alias("chance"))
    ends = wanted.where("chance > 0").select("source", F.col("wanted").alias("gap"), F.lit(None).cast(kind).alias("past"), F.array().cast(f"array<struct<past:{kind},stop:{kind},gap:double>>").alias("runs"), F.lit(True).alias("open"))
    ends, step = scratch.save(ends, "ends0"), 0
    while not ends.where("open").isEmpty():  # a run ends before a document that does not fit; the next goes on behind it
        left = joined(drawn, ends.where("open"), "inner").where("size <= gap and (past is null or _order > past)")
        sums = left.groupBy(F.col("_row.of").alias("source"), "_bucket", "gap").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("_bucket"))
        over = F.when(F.col("upto") > F.col("gap"), F.struct("_bucket", (F.col("gap") - F.col("upto") + F.col("words")).alias("rest")))
        cut = sums.withColumn("upto", upto).groupBy("source").agg(F.max("upto").alias("all"), F.min(over).alias("c"))
        cut = scratch.save(cut.select("source", "all", F.col("c._bucket").alias("cut"), F.col("c.rest").alias("rest")), f"cut{step}")

        last = joined(left, cut.where("cut is not null"), "inner").where("_bucket = cut")
        running = F.sum("size").over(Window.partitionBy("_row.of").orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        fits = F.col("_sum") <= F.col("rest")
        last = last.withColumn("_sum", running).groupBy(F.col("_row.of").alias("_s")).agg(F.min(F.when(~fits, F.col("_order"))).alias("stop"), F.max(F.when(fits, F.col("_sum"))).alias("filled"))
        found = cut.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "all", "rest", "stop", "filled")
        ends = ends.join(found, F.col("source").eqNullSafe(F.col("_s")), "left")
        run = F.struct("past", "stop", "gap")
        ends = ends.select(
            "source",
            F.when(F.col("stop").isNull(), F.col("gap") - F.coalesce("all", F.lit(0))).otherwise(F.col("rest") - F.coalesce("filled", F.lit(0))).alias("gap"),
            F.col("stop").alias("past"),
            F.when(F.col("open"), F.array_append("runs", run)).otherwise(F.col("runs")).alias("runs"),
            F.col("stop").isNotNull().alias("open"),
        )
        step += 1
        ends = scratch.save(ends, f"ends{step}")

    within = lambda r: (r["past"].isNull() | (F.col("_order") > r["past"])) & (r["stop"].isNull() | (F.col("_order") < r["stop"])) & (F.col("size") <= r["gap"])
    chosen = F.exists("runs", within)
    spare = joined(drawn, ends, "inner").where(~chosen & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    spare = spare.groupBy(F.col("_row.of").alias("_s"), "_order", "gap").agg(F.sum("size").alias("words"))  # rows with one fate
    near = spare.where(F.col("words") < 2 * F.col("gap")).groupBy("_s").agg(F.min("_order").alias("closing"))
    ends = scratch.save(ends.join(near, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("source").alias("_s"), "runs", "closing"), "closed")

    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    one_more = F.col("_rank").isNotNull() & (F.coalesce(chosen, F.lit(False)) | F.coalesce(F.col("_order") == F.col("closing"), F.lit(False)))
    out = ranked(joined(whole, plan, by_length=True)).withColumn("copies", F.col("certain") + one_more.cast("long"))
    return out.select("_in.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1, at most three copies."""
    mixed = mix_sources(documents(spark, sf_dir), columns=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
