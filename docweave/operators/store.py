"""Tables that are written so that later steps read them instead of computing them again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes after which a batch of rows on its way to Python ends.
BATCH_BYTES = 8 << 20
_local_dir: str | None = None
_scopes: list[list[Store]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a session on a local master may lack that setting; a temporary folder
    then stands in for it.
    """
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="docweave-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end after ``BATCH_BYTES``, however long the rows in them are; one bound for the whole library."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Deletes at its end the tables of all stores that were made in it.

    Results are lazy, so whatever is computed from these tables has to be written
    within::

        with temporary_tables():
            operator(docs).write.parquet(path)
    """
    _scopes.append([])
    try:
        yield
    finally:
        for store in _scopes.pop():
            store.clean()


class Store:
    """The intermediate tables of one call, in a folder of their own under ``shared_dir``.

    They stay until ``clean``, or until the end of ``temporary_tables`` if the call was made in it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a reader of it; this cuts the lineage."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        self._delete(f"{self.root}/{name}")

    def clean(self) -> None:
        """Delete all tables of the call."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
