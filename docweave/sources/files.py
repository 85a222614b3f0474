"""Sources and sinks: text, Markdown, JSON, Office files, and the graph's tables.

Every reader goes through Spark's own file sources, so paths may be in any store.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.store import bound_batches
from docweave.sources.charsets import decoded

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
#: Extensions of images that are taken from Office files.
IMAGES = (".png", ".jpg", ".jpeg", ".emf", ".x-emf")

GRAPH_DOCUMENT = (
    "chunk_id STRING, text STRING, chunk_summary STRING, chunk_embedding ARRAY<DOUBLE>, metadata MAP<STRING,STRING>, "
    "nodes ARRAY<STRUCT<id:STRING,name:STRING,type:STRING,entity_type:STRING,text:STRING,embedding:ARRAY<DOUBLE>,properties:MAP<STRING,STRING>>>, "
    "edges ARRAY<STRUCT<source:STRING,target:STRING,type:STRING,properties:MAP<STRING,STRING>>>"
)
EXTRACTION = (
    "chunk_id STRING, chunk_text STRING, summary STRING, metadata MAP<STRING,STRING>, embedding ARRAY<DOUBLE>, "
    "entities ARRAY<STRUCT<id:STRING,name:STRING,type:STRING,description_node:STRUCT<type:STRING,text:STRING,embedding:ARRAY<DOUBLE>>>>, "
    "relationships ARRAY<STRUCT<id:STRING,source:STRING,target:STRING,type:STRING,description_node:STRUCT<type:STRING,text:STRING,embedding:ARRAY<DOUBLE>>>>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole text files, in the encoding that their bytes speak for; what it cannot read is left out."""
    bound_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def folder_counts(spark: SparkSession, path: str) -> DataFrame:
    """``folder, files, bytes`` of all folders below a path that hold files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def read_graph_documents(spark: SparkSession, path: str, schema: str = GRAPH_DOCUMENT) -> DataFrame:
    """JSON arrays of graph documents or extractions, one row each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``question_index, question, embeddings`` of question files; the vectors are a map by column name."""
    raw = spark.read.schema("questions ARRAY<MAP<STRING,STRING>>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("questions").alias("question_index", "_q"))
    vectors = F.map_filter("_q", lambda k, _: k.endswith("_embedding"))
    return rows.select("question_index", F.element_at("_q", "question").alias("question"), F.transform_values(vectors, lambda _, v: F.from_json(v, "array<double>")).alias("embeddings"))


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """``image, page, description, source, y_position`` of caption files, whose keys are image numbers."""
    schema = "MAP<STRING,STRUCT<page:INT,context_before:STRING,context_after:STRING,description:STRING,y_position:DOUBLE,image_size:ARRAY<INT>,source:STRING>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("image", "_c"))
    return raw.select(F.col("image").cast("int").alias("image"), "_c.*")


def _scan(spark: SparkSession, path: str, parse, schema: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """Parsed rows of binary files; a file that cannot be parsed gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(file, *row, None) for row in parse(zipfile.ZipFile(io.BytesIO(content)))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                    rows = [(file, *[None] * (len(names) - 2), repr(error))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    bound_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


DOCX = "path string, position int, kind string, text string, error string"
XLSX = "path string, sheet string, row_no int, cells array<string>, error string"


def parse_docx(archive: zipfile.ZipFile) -> Iterator[tuple[int, str, str]]:
    """``position, kind, text`` of the blocks of a Word file."""
    body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    plain = lambda e: "".join(x.text or "" for x in e.iter(f"{_W}t")).strip()
    position = 0
    for block in body:
        if block.tag == f"{_W}p":
            text, kind = plain(block), "paragraph"
        elif block.tag == f"{_W}tbl":
            text, kind = "\n".join(" | ".join(plain(c) for c in row.iter(f"{_W}tc")) for row in block.iter(f"{_W}tr")), "table"
        else:
            continue
        if text:
            yield position, kind, text
            position += 1


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``path, position, kind, text, error`` of the blocks of Word files, in order: paragraphs and tables with text."""
    return _scan(spark, path, parse_docx, DOCX, ["path", "position", "kind", "text", "error"], [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()])


def docx_texts(blocks: DataFrame) -> DataFrame:
    """``path, text``: the blocks of each file with blank lines between."""
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return blocks.where("error is null").groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def parse_xlsx(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, list[str]]]:
    """``sheet, row_no, cells`` of the rows of a spreadsheet file."""
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))]
    targets = _relations(archive, "xl/_rels/workbook.xml.rels")
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        root = ElementTree.fromstring(archive.read("xl/" + targets[sheet.get(f"{_R}id")].removeprefix("/xl/")))
        for n, row in enumerate(root.iter(f"{_S}row")):
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells))
                value = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
            yield sheet.get("name"), n, cells


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, row_no, cells, error`` of every row of every sheet; cells are text."""
    return _scan(spark, path, parse_xlsx, XLSX, ["path", "sheet", "row_no", "cells", "error"], [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()])


def sheet_markdown(rows: DataFrame) -> DataFrame:
    """``path, sheet, text``: each sheet as a Markdown table, its first row the heading."""
    from docweave.functions.text import cell

    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", cell), " | "), F.lit(" |"))
    ruled = F.when(F.col("row_no") == 0, F.concat(line, F.lit("\n| "), F.array_join(F.transform("cells", lambda _: F.lit("---")), " | "), F.lit(" |"))).otherwise(line)
    parts = F.array_sort(F.collect_list(F.struct("row_no", ruled.alias("line"))))
    return rows.where("error is null").groupBy("path", "sheet").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def read_docx_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, position, name, image, error`` of the pictures that Word files show, in order."""

    def parse(archive: zipfile.ZipFile):
        targets = _relations(archive, "word/_rels/document.xml.rels")
        blips = ElementTree.fromstring(archive.read("word/document.xml")).iter(f"{_A}blip")
        shown = [targets.get(b.get(f"{_R}embed"), "") for b in blips]
        for n, name in enumerate(x for x in shown if x.lower().endswith(IMAGES)):
            yield n, name, archive.read("word/" + name.removeprefix("/word/"))

    return _scan(spark, path, parse, "path string, position int, name string, image binary, error string", ["path", "position", "name", "image", "error"], [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()])


def read_xlsx_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, cell, name, image, error``: pictures with the cell that their upper left corner is in."""

    def parse(archive: zipfile.ZipFile):
        books = _relations(archive, "xl/_rels/workbook.xml.rels")
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            part = books[sheet.get(f"{_R}id")].rsplit("/", 1)[-1]
            for drawing in _relations(archive, f"xl/worksheets/_rels/{part}.rels").values():
                name = drawing.rsplit("/", 1)[-1]
                if not name.startswith("drawing"):
                    continue
                pictures = _relations(archive, f"xl/drawings/_rels/{name}.rels")
                for anchor in ElementTree.fromstring(archive.read(f"xl/drawings/{name}")).iter(f"{_X}twoCellAnchor"):
                    start, blip = anchor.find(f"{_X}from"), next(anchor.iter(f"{_A}blip"), None)
                    if blip is not None:
                        target = pictures[blip.get(f"{_R}embed")].rsplit("/", 1)[-1]
                        yield sheet.get("name"), _letters(int(start.find(f"{_X}col").text)) + str(int(start.find(f"{_X}row").text) + 1), target, archive.read(f"xl/media/{target}")

    return _scan(spark, path, parse, "path string, sheet string, cell string, name string, image binary, error string", ["path", "sheet", "cell", "name", "image", "error"], [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()])


def _relations(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    if name not in archive.namelist():
        return {}
    return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read(name))}


def _column(address: str) -> int:
    n = 0
    for letter in address.rstrip("0123456789"):
        n = 26 * n + ord(letter.upper()) - 64
    return n - 1


def _letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "append") -> None:
    """Nodes partitioned by label and edges by type, so that scans of one of them read only its files."""
    nodes.write.mode(mode).partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("type").parquet(f"{path}/edges")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def write_graph_batch(nodes: DataFrame, edges: DataFrame, path: str, batch: int) -> None:
    """One numbered batch of a graph, whole or not at all.

    Nodes, edges and then a marker go into folders of the batch's number. Readers look at
    batches with a marker only, and a batch that is written again takes the place of what a failure
    left of it; one that has its marker stays as it is.
    """
    spark = nodes.sparkSession
    if _exists(spark, f"{path}/commits/batch={batch}/_SUCCESS"):
        return
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes/batch={batch}")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges/batch={batch}")
    spark.range(1).select(F.current_timestamp().alias("committed")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; of a graph that was written in batches those of whole batches."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if not _exists(spark, f"{path}/commits"):
        return nodes, edges
    whole = spark.read.parquet(f"{path}/commits").select("batch")
    return nodes.join(whole, "batch", "left_semi").drop("batch"), edges.join(whole, "batch", "left_semi").drop("batch")


def write_json(df: DataFrame, path: str) -> None:
    """Chunks, graph documents or answers, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_answers(answers: DataFrame, metadata: DataFrame, path: str) -> None:
    """Answers, one JSON object a line in ``answers``, and their one row of metadata in ``metadata``."""
    answers.write.mode("overwrite").json(f"{path}/answers")
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_questions(questions: DataFrame, path: str) -> None:
    """``question_index, question, embeddings, language``: rewrites the partitions of the languages in it, and no others."""
    questions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("language").parquet(path)


def write_markdown(texts: DataFrame, path: str) -> None:
    """``path, text`` rows, a folder for each document."""
    texts.write.mode("overwrite").partitionBy("path").text(path)
