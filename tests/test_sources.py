"""Readers, sinks and streams on files written here."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave.sources import captioned, charsets, files, formats
from docweave.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = "http://schemas.openxmlformats.org/package/2006/relationships"


def archive(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)


def test_docx(spark, tmp_path):
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr></w:tbl>"
    picture = '<w:p><w:r><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r></w:p>'
    archive(tmp_path / "x.docx", {"word/document.xml": f"<w:document {W}><w:body>{para(' one ')}{para(' ')}{table}{picture}{para('two')}</w:body></w:document>", "word/_rels/document.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="r1" Target="media/i.png"/></Relationships>', "word/media/i.png": b"png"})
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    blocks = files.read_docx(spark, str(tmp_path / "*.docx"))
    assert [(r["kind"], r["text"]) for r in blocks.where("error is null").orderBy("position").collect()] == [("paragraph", "one"), ("table", "a | b"), ("paragraph", "two")]
    assert blocks.where("error is not null").count() == 1
    assert files.docx_texts(blocks).first()["text"] == "one\n\na | b\n\ntwo"
    image = files.read_docx_images(spark, str(tmp_path / "x.docx")).first()
    assert (image["name"], bytes(image["image"])) == ("media/i.png", b"png")


def test_xlsx(spark, tmp_path):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    d = 'xmlns:x="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    archive(
        tmp_path / "x.xlsx",
        {
            "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si><si><t>a|b</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
            "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="r1" Target="../drawings/drawing1.xml"/></Relationships>',
            "xl/drawings/drawing1.xml": f'<x:wsDr {d}><x:twoCellAnchor><x:from><x:col>27</x:col><x:row>2</x:row></x:from><x:pic><a:blip r:embed="r9"/></x:pic></x:twoCellAnchor></x:wsDr>',
            "xl/drawings/_rels/drawing1.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="r9" Target="../media/p.jpg"/></Relationships>',
            "xl/media/p.jpg": b"jpg",
        },
    )
    rows = files.read_xlsx(spark, str(tmp_path / "x.xlsx"))
    assert [r["cells"] for r in rows.orderBy("row_no").collect()] == [["name", "", "7"], ["a|b", "", "in"]]
    assert files.sheet_markdown(rows).first()["text"] == "| name |  | 7 |\n| --- | --- | --- |\n| a&#124;b |  | in |"
    image = files.read_xlsx_images(spark, str(tmp_path / "x.xlsx")).first()
    assert (image["sheet"], image["cell"], bytes(image["image"])) == ("S", "AB3", b"jpg")


def test_json_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"question": "a?", "en_embedding": [1.0, 2.0]}, {"question": "b?"}]}))
    rows = files.read_questions(spark, str(tmp_path / "q.json")).orderBy("question_index").collect()
    assert [(r["question"], r["embeddings"]) for r in rows] == [("a?", {"en_embedding": [1.0, 2.0]}), ("b?", {})]
    (tmp_path / "c.json").write_text(json.dumps({"3": {"page": 1, "description": "a cat", "y_position": 2.5}}))
    caption = files.read_captions(spark, str(tmp_path / "c.json")).first()
    assert (caption["image"], caption["description"], caption["page"]) == (3, "a cat", 1)
    (tmp_path / "t.txt").write_bytes(b"caf\xc3\xa9 \xff end")
    assert files.read_texts(spark, str(tmp_path / "t.txt")).first()["text"] == "café  end"


def test_graph_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Chunk")], "id string, label string")
    edges = spark.createDataFrame([("a", "a", "X")], "src string, dst string, type string")
    for _ in range(2):
        files.write_graph(nodes, edges, str(tmp_path / "g"))
    got = files.read_graph(spark, str(tmp_path / "g"))
    assert (got[0].count(), got[1].where("type = 'X'").count()) == (2, 2)


def test_streams_equal_tables(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = events.windowed(stream, "1 day").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("days").collect()}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in events.windowed(table, "1 day").collect()}


def test_ingest_takes_files_once(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(20).write.parquet(str(tmp_path / "in"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for _ in range(2):
        events.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "g")).awaitTermination(120)
    nodes, edges = files.read_graph(spark, str(tmp_path / "g"))
    assert nodes.where("label = 'Document'").count() == 20
    assert edges.count() == nodes.where(F.col("label") == "Chunk").count() >= 20


@pytest.mark.parametrize(("name", "text"), [
    ("utf-8", "Пример, приклад 例文 naïve"), ("utf-16", "Any text: Ünïcode 中文"), ("utf-16-le", "plain words"), ("utf-16-be", "plain words"),
    ("windows-1252", "Übergrößen für Mädchen – déjà vu, garçon, Ärger, €5"), ("iso-8859-1", "Un café très cher à Málaga, señor"), ("windows-1251", "Съешь же ещё этих мягких французских булок, да выпей чаю."),
    ("shift_jis", "これは日本語の文章です。文字コードを調べます。"), ("gb18030", "这是一个中文句子，用来检测字符编码。我们在北京工作。"),
])
def test_charsets_are_found(name, text):
    found = charsets.detect(text.encode(name))
    assert text.encode(name).decode(found) == text
    assert found == name or {found, name} == {"windows-1252", "iso-8859-1"}


def test_charset_columns(spark):
    raw = ["Съешь ещё булок".encode("windows-1251"), b"caf\xc3\xa9 \xff end", b"caf\xe9 noir", b"", None, b"\xef\xbb\xbfmarked", bytes(range(128, 256)) * 50]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "k int, content binary")
    got = {r["k"]: (r["charset"], r["text"]) for r in rows.select("k", charsets.charset("content").alias("charset"), charsets.decoded(F.col("content")).alias("text")).collect()}
    assert [got[k][1] for k in range(6)] == ["Съешь ещё булок", "café  end", "café noir", "", None, "marked"]
    assert got[0][0] == "windows-1251" and got[4][0] is None and got[6][1] is not None


def test_a_failed_batch_is_not_seen_and_not_doubled(spark, sf_dir, tmp_path, monkeypatch):
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "g")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs.limit(6).write.parquet(str(tmp_path / "in"))
    writer, fail = events.write_graph_batch, [True]

    def broken(nodes, edges, path, batch):
        if fail.pop() if fail else False:  # nodes are there, edges are not
            nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes/batch={batch}")
            raise OSError("lost")
        writer(nodes, edges, path, batch)

    monkeypatch.setattr(events, "write_graph_batch", broken)
    with pytest.raises(Exception, match="lost"):
        events.ingest(spark, str(tmp_path / "in"), schema, target).awaitTermination(120)
    assert (tmp_path / "g/nodes/batch=0").exists() and not (tmp_path / "g/commits").exists()
    events.ingest(spark, str(tmp_path / "in"), schema, target).awaitTermination(120)
    docs.where("doc_id >= 100").limit(4).write.mode("append").parquet(str(tmp_path / "in"))
    events.ingest(spark, str(tmp_path / "in"), schema, target).awaitTermination(120)
    nodes, edges = files.read_graph(spark, target)
    assert nodes.where("label = 'Document'").count() == 10 == nodes.where("label = 'Document'").distinct().count()
    assert edges.count() == nodes.where("label = 'Chunk'").count()
    (tmp_path / "g/nodes/batch=9/label=Chunk").mkdir(parents=True)
    nodes.where("label = 'Chunk'").drop("label").write.mode("overwrite").parquet(f"{target}/nodes/batch=9/label=Chunk")  # without a marker
    assert files.read_graph(spark, target)[0].count() == nodes.count()
    writer(nodes.limit(1), edges.limit(1), target, 0)  # has its marker, so it stays
    assert files.read_graph(spark, target)[0].count() == nodes.count()


def test_ingest_goes_on_to_entities(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "Alice Smith met Bob in Paris.", "en", "s", 1), (2, None, "en", "s", 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    events.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "g"), entities=True).awaitTermination(240)
    nodes, edges = files.read_graph(spark, str(tmp_path / "g"))
    assert {r["name"] for r in nodes.where("label = 'Entity'").collect()} == {"Alice Smith", "Bob", "Paris"}
    assert {"CONTAINS", "MENTIONS", "DESCRIBES", "RELATED"} == {r["type"] for r in edges.select("type").distinct().collect()}


@pytest.fixture
def office(tmp_path):
    """A Word file with two pictures and a spreadsheet with one."""
    (tmp_path / "in").mkdir()
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    picture = lambda k: f'<w:p><w:r><w:drawing><a:blip r:embed="r{k}"/></w:drawing></w:r></w:p>'
    relations = "".join(f'<Relationship Id="r{k}" Target="media/i{k}.png"/>' for k in (1, 2))
    archive(tmp_path / "in/x.docx", {"word/document.xml": f"<w:document {W}><w:body>{para('one')}{picture(1)}{para('two')}{picture(2)}</w:body></w:document>", "word/_rels/document.xml.rels": f'<Relationships xmlns="{P}">{relations}</Relationships>', "word/media/i1.png": b"png1", "word/media/i2.png": b"png2"})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    archive(tmp_path / "in/y.xlsx", {
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{P}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>', "xl/media/p.jpg": b"jpg",
    })
    (tmp_path / "in/z.docx").write_bytes(b"no archive")
    return tmp_path


def test_captioned_files_are_read_back(spark, office):
    uri = f"file:{office}/in"
    captions = spark.createDataFrame([(f"{uri}/x.docx", "1", "a dog & cat"), (f"{uri}/y.xlsx", "S!B1", "empty cell"), (f"{uri}/y.xlsx", "S!A1", "chart"), (f"{uri}/y.xlsx", "S!B3", "below"), (f"{uri}/z.docx", "0", "lost")], "path string, place string, description string")
    made = captioned.captioned_files(spark, uri, captions)
    assert {r["path"][-6:]: r["error"] is None for r in made.collect()} == {"x.docx": True, "y.xlsx": True, "z.docx": False}
    (office / "out").mkdir()
    captioned.write_files(made.where("error is null"), f"file://{office}/out")
    assert sorted(p.name for p in (office / "out").iterdir()) == ["x.docx", "y.xlsx"]
    blocks = files.read_docx(spark, str(office / "out/x.docx")).orderBy("position").collect()
    assert [r["text"] for r in blocks] == ["one", "two", "[IMAGE_DESCRIPTION]:a dog & cat"]
    assert [r["position"] for r in files.read_docx_images(spark, str(office / "out/x.docx")).collect()] == [0]
    with zipfile.ZipFile(office / "out/x.docx") as x:
        assert x.read("word/media/i2.png") == b"png2"
    rows = files.read_xlsx(spark, str(office / "out/y.xlsx")).orderBy("row_no").collect()
    assert [r["cells"] for r in rows] == [["name\n[IMAGE] chart", "\n[IMAGE] empty cell", "7"], ["", "\n[IMAGE] below"]]


def test_formats_give_the_rows_of_the_readers(spark, office):
    formats.register(spark)
    uri = f"file://{office}/in"
    docx = spark.read.format("docx").load(uri)
    plain = lambda df: sorted(repr(tuple(r)[1:]) for r in df.collect())
    assert docx.columns == files.read_docx(spark, f"{uri}/*.docx").columns
    assert plain(docx) == plain(files.read_docx(spark, f"{uri}/*.docx"))
    assert plain(spark.read.format("xlsx").load(uri)) == plain(files.read_xlsx(spark, f"{uri}/*.xlsx"))
    one = docx.where(F.col("path") == f"{office}/in/x.docx")
    assert one.count() == 2 and one.where("error is not null").count() == 0
    assert spark.read.format("pdf").load(uri).count() == 0
    spark.sql(f"CREATE TEMPORARY VIEW office_blocks USING docx OPTIONS (path '{uri}')")
    assert spark.sql("SELECT text FROM office_blocks WHERE kind = 'paragraph' ORDER BY position").first()["text"] == "one"
