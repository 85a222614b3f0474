"""Office files with the descriptions of their pictures in place, and a sink for whole files."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from docweave.operators.store import bound_batches
from docweave.sources.files import _A, _R, _S, _W, IMAGES, _relations

for _prefix, _uri in (("w", _W), ("s", _S), ("r", _R), ("a", _A)):
    ElementTree.register_namespace(_prefix, _uri.strip("{}"))


def _rewritten(content: bytes, parts: dict[str, bytes]) -> bytes:
    """The package with some parts replaced; all others are copied as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            new.writestr(item, parts.get(item.filename, old.read(item.filename)))
    return out.getvalue()


def caption_docx(content: bytes, captions: dict[str, str]) -> bytes:
    """A Word file whose shown pictures, by their position, give way to ``[IMAGE_DESCRIPTION]:`` and their caption."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        targets = _relations(archive, "word/_rels/document.xml.rels")
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    position = 0
    for run in list(root.iter(f"{_W}r")):
        for drawing in run.findall(f"{_W}drawing"):
            shown = [b for b in drawing.iter(f"{_A}blip") if targets.get(b.get(f"{_R}embed"), "").lower().endswith(IMAGES)]
            told = [captions[str(k)] for k in range(position, position + len(shown)) if str(k) in captions]
            position += len(shown)
            if told:
                at = list(run).index(drawing)
                run.remove(drawing)
                text = ElementTree.Element(f"{_W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
                text.text = "\n".join(f"[IMAGE_DESCRIPTION]:{x}" for x in told)
                run.insert(at, text)
    return _rewritten(content, {"word/document.xml": ElementTree.tostring(root, "utf-8", xml_declaration=True)})


def caption_xlsx(content: bytes, captions: dict[str, str]) -> bytes:
    """A spreadsheet file in which the cells of ``sheet!cell`` have ``[IMAGE]`` and a caption on a line of their own."""
    parts = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
        targets = _relations(archive, "xl/_rels/workbook.xml.rels")
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            own = {k.rpartition("!")[2]: v for k, v in captions.items() if k.rpartition("!")[0] == sheet.get("name")}
            if own:
                name = "xl/" + targets[sheet.get(f"{_R}id")].removeprefix("/xl/")
                root = ElementTree.fromstring(archive.read(name))
                for address, caption in own.items():
                    _append(root.find(f"{_S}sheetData"), address, f"\n[IMAGE] {caption}", shared)
                parts[name] = ElementTree.tostring(root, "utf-8", xml_declaration=True)
    return _rewritten(content, parts)


def _place(address: str) -> tuple[int, int]:
    letters = address.rstrip("0123456789")
    column = 0
    for letter in letters:
        column = 26 * column + ord(letter.upper()) - 64
    return int(address[len(letters) :]), column


def _append(data: ElementTree.Element, address: str, text: str, shared: list[str]) -> None:
    """Add to a cell's text; rows and cells that are not there are made, in order."""
    number, column = _place(address)
    rows = [(int(r.get("r") or k), r) for k, r in enumerate(data.findall(f"{_S}row"), 1)]
    row = next((r for n, r in rows if n == number), None)
    if row is None:
        row = ElementTree.Element(f"{_S}row", {"r": str(number)})
        data.insert(sum(n < number for n, _ in rows), row)
    cells = [(_place(c.get("r"))[1] if c.get("r") else k, c) for k, c in enumerate(row.findall(f"{_S}c"), 1)]
    cell = next((c for n, c in cells if n == column), None)
    if cell is None:
        cell = ElementTree.Element(f"{_S}c", {"r": address})
        row.insert(sum(n < column for n, _ in cells), cell)
    value = cell.find(f"{_S}v")
    old = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if cell.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
    old = shared[int(old)] if cell.get("t") == "s" and old else old
    for child in list(cell):
        cell.remove(child)
    cell.set("t", "inlineStr")
    inline = ElementTree.SubElement(ElementTree.SubElement(cell, f"{_S}is"), f"{_S}t")
    inline.text = old + text


def captioned_files(spark: SparkSession, path: str, captions: DataFrame) -> DataFrame:
    """``path, content, error``: Word and spreadsheet files with ``captions(path, place, description)`` in them.

    ``place`` is a picture's position in a Word file, or ``sheet!cell``. Files without captions stay as they
    are, as do those that cannot be rewritten, with their error; captions are gathered by file, of which each has a few.
    """
    schema = "path string, content binary, error string"
    listed = captions.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("place", "description")))).alias("captions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content, told in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "captions")), strict=True):
                error = None
                if told:
                    try:
                        content = (caption_xlsx if file.lower().endswith((".xlsx", ".xls")) else caption_docx)(content, dict(told))
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as problem:
                        error = repr(problem)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    bound_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").join(listed, "path", "left").mapInArrow(run, schema)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _FilesWriter(DataSourceWriter):
    """Each row a file; a task writes under names of its own, which get their real ones when all tasks are through."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        own, names = f"{root}/_temporary-{uuid.uuid4().hex}", []
        store.create_dir(own)
        for row in iterator:
            with store.open_output_stream(f"{own}/{len(names)}") as out:
                out.write(bytes(row["content"]))
            names.append((f"{own}/{len(names)}", posixpath.basename(row["path"])))
        return _Written([own, *names])

    def commit(self, messages) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for message in (m for m in messages if m):
            own, *names = message.names
            for made, name in names:
                store.move(made, f"{root}/{name}")
            store.delete_dir(own)

    def abort(self, messages) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for message in (m for m in messages if m):
            store.delete_dir(message.names[0])


class FilesSink(DataSource):
    """Format ``files``: rows ``path, content`` as files of a folder that tasks and driver share, by the last part of their path."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Write ``files(path, content)`` into the folder at a URI that pyarrow's file systems know, such as ``file:/`` or ``s3://``."""
    files.sparkSession.dataSource.register(FilesSink)
    files.select("path", "content").write.format("files").mode("append").save(path)
