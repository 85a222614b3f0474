"""The corpus pipeline: five stages, each one of the operators of ``docweave.llm``.

Each stage takes the session, the rows that the stage before it kept, and the
folder of the tables. ``run`` writes each stage's rows as Parquet into the
folder that the cluster shares, and the next stage reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.best_fit import pack_documents, with_texts
from docweave.llm.common import Scratch, documents
from docweave.llm.line_dedup import dedup_lines
from docweave.llm.minhash import without_near_duplicates
from docweave.llm.mixing import mix_sources
from docweave.llm.quality import classify
from docweave.operators.store import temporary_tables

#: Word shingles and similarity of near duplicates.
SHINGLE_WORDS, PERCENT = 5, 80


def _held(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the whole row, which they hand on."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "lang", "source")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, as they are.

    Rows are judged one by one, by text and language, so null and repeated doc_ids do not matter and repeated rows
    stay or go together; null and empty texts go. Very long texts are scored whole.
    """
    judged = classify(_held(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of repeated three-line windows; those with nothing left go.

    Null texts and those of fewer than three lines stay as they are. Rows that repeat doc_id and text lose the
    same lines; a null doc_id is an id that comes last.
    """
    cleaned = dedup_lines(_held(docs)).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))}
    return cleaned.select(*[fresh.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest doc_id.

    Rows that repeat a doc_id are told apart by their text; of equal rows one
    stays; a null doc_id comes after all others. Null and wordless texts are in
    no group and all stay.
    """
    return without_near_duplicates(docs, SHINGLE_WORDS, PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes copies, three at most.

    Null and empty texts have no words and are taken or left by chance; a null source is a source of its own. Repeated
    rows, and rows of one doc_id, are drawn one by one.
    """
    mixed = mix_sources(_held(docs)).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins that hold the documents, with the text of each piece, so the corpus is in the result.

    The pieces of a document joined in order are its text. Null texts stay null and, as empty ones, take no room;
    very long ones are split. Repeated rows are placed one by one, each in another bin.
    """
    return with_texts(pack_documents(docs), docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("mixing", mixing), ("best_fit_packing", packing)]
#: SQL cannot train the classifier or reproduce the hashes; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's own tables and its input go when its rows are written, all of them if one fails."""
    scratch = Scratch(spark, "pipeline")
    docs, before = documents(spark, sf_dir), None
    try:
        for name, stage in STAGES:
            with temporary_tables():
                docs = scratch.save(stage(spark, docs, sf_dir), name)
            if before:
                scratch.drop(before)
            before = name
    except BaseException:
        scratch.clean()
        raise
    return docs
