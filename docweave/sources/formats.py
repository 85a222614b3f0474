"""The readers as Spark formats: ``spark.read.format("docx")``, ``"xlsx"`` and ``"pdf"`` after ``register(spark)``.

Files are listed and read through pyarrow's file systems, so paths are URIs that these know. Where only Spark
can open a path, the functions of ``files`` and ``pdf`` give the same rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from docweave.sources.files import DOCX, XLSX, parse_docx, parse_xlsx
from docweave.sources.pdf import _KINDS, _NAMES, MARKS, marks_of

#: Bytes of files that one partition reads.
PART_BYTES = 64 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str, endings: tuple[str, ...], parse, names: list[str], kinds: list[pa.DataType]):
        self.path, self.endings, self.parse, self.names, self.kinds, self.wanted = path, endings, parse, names, kinds, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on ``path`` choose among the files, so no other file is opened; all others go back to Spark."""
        for one in filters:
            if isinstance(one, EqualTo | In | StringStartsWith) and one.attribute == ("path",):
                self.wanted.append(one)
            else:
                yield one

    def _fits(self, path: str) -> bool:
        tests = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value)}
        return path.lower().endswith(self.endings) and all(tests[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        about = store.get_file_info(root)
        listed = [about] if about.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        parts, size = [[]], 0
        for file in sorted((f for f in listed if f.is_file and self._fits(f.path)), key=lambda f: f.path):
            if size and size + file.size > PART_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(file.path)
            size += file.size
        return [_Files(p) for p in parts]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as source:
                content = source.read()
            try:
                rows = [(path, *row, None) for row in self.parse(content)]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, TypeError, IndexError, AttributeError) as error:
                rows = [(path, *[None] * (len(self.names) - 2), repr(error))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(self.kinds)], names=self.names)


def _marks(content: bytes) -> Iterator[tuple]:
    return (tuple(mark.get(n) for n in _NAMES[1:-1]) for mark in marks_of(content))


def _format(name: str, endings: tuple[str, ...], schema: str, parse, kinds: list[pa.DataType]) -> type[DataSource]:
    names = [x.split(" ")[0] for x in schema.split(", ")]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options["path"], endings, parse, names, kinds)

    return Source


FORMATS = (
    _format("docx", (".docx",), DOCX, lambda raw: parse_docx(zipfile.ZipFile(io.BytesIO(raw))), [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]),
    _format("xlsx", (".xlsx",), XLSX, lambda raw: parse_xlsx(zipfile.ZipFile(io.BytesIO(raw))), [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]),
    _format("pdf", (".pdf",), MARKS, _marks, _KINDS),
)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters on ``path`` pushed into them."""
    for source in FORMATS:
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
