"""Chunking of mixed documents, merging of sections, extraction, creation and sinks on small hand-checked inputs."""

import hashlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.operators import chunking as c
from docweave.operators import create, layout, models, retrieval, vectors
from docweave.operators import extraction as x
from docweave.operators.build import table_graph, text_graph
from docweave.sources import files


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column, *values, kind="string"):
    return spark.createDataFrame([values], ", ".join(f"c{k} {kind}" for k in range(len(values)))).select(column.alias("x")).first()["x"]


def test_tables_between_prose(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {k} | row number {k} |" for k in range(12))
    text = f"Some words before.\n{table}\nWords after the table.\n{table}\n" + "end " * 80
    rows = c.mixed_chunks(docs(spark, text), 40).orderBy("chunk_id").collect()
    parts = [r["content"] for r in rows]
    assert all(r["token_count"] <= 40 for r in rows)
    assert parts[0] == "Some words before." and parts[1].startswith("| a | b |\n| --- | --- |\n| 0 |")
    assert sum("| 7 | row number 7 |" in p for p in parts) == 2 and all("| a | b |" in p for p in parts if "row number" in p)
    assert any(p.startswith("Words after the table.") for p in parts)
    runs = c.table_runs(docs(spark, text)).orderBy("run").collect()
    assert [r["is_table"] for r in runs] == [False, True, False, True, False] and (runs[1]["first_line"], runs[1]["last_line"]) == (1, 14)
    small = "| a |\n| - |\n| 1 |"
    joined = c.mixed_chunks(docs(spark, f"{'long words ' * 20}\n\nbefore\n{small}\nafter\n\n{'long words ' * 12}", f"{small}\nafter\n\n{'long words ' * 15}"), 40).orderBy("doc_id", "chunk_id").collect()
    assert [r["content"] for r in joined if "| 1 |" in r["content"]] == [f"before\n{small}", f"{small}\nafter"]
    whole = c.chunks(docs(spark, text), 5000).collect()
    assert len(whole) == 1 and whole[0]["content"] == text


def test_rows_and_cells_that_do_not_fit(spark):
    head = "| one | two | three |\n| --- | --- | --- |\n"
    wide = "| " + " | ".join(["x" * 70, "y" * 70, "Long sentence here. " * 20]) + " |"
    parts = one(spark, c.table_chunks(F.col("c0"), 40), head + "| 1 | 2 | 3 |\n" + wide + "\n| 4 | 5 | 6 |")
    assert parts[0] == head + "| 1 | 2 | 3 |" and parts[-1] == head + "| 4 | 5 | 6 |"
    assert parts[1] == "| one |\n| --- |\n| " + "x" * 70 + " |" and parts[2].startswith("| two |")
    assert parts[3].startswith("Column: three\n\nLong sentence here.") and all(len(p) // 4 <= 40 for p in parts)
    assert "".join(p for p in parts[3:-1]).count("Long sentence") == 20


MARKDOWN = "intro\n# A\n## B\nb text\n## C\nc text\n### D\nd text\n# E\ne text\n## F\n" + "f words here. " * 40


def test_sections_keep_headings_and_merge_bottom_up(spark):
    parts = c.headed_sections(docs(spark, MARKDOWN))
    rows = parts.orderBy("position").collect()
    assert [(r["level"], r["path"], r["content"].split("\n")[0]) for r in rows] == [(0, [], "intro"), (2, ["A", "B"], "# A"), (2, ["A", "C"], "## C"), (3, ["A", "C", "D"], "### D"), (1, ["E"], "# E"), (2, ["E", "F"], "## F")]
    levels = [r["l"] for r in parts.select("position", c.effective_level(F.col("content"), F.col("level")).alias("l")).orderBy("position").collect()]
    assert levels == [0, 1, 2, 3, 1, 2]
    merged = c.merge_sections(parts, 60).orderBy("position").collect()
    assert [(r["merged_from"], r["merge_count"]) for r in merged] == [([0], 1), ([1, 2, 3], 3), ([4], 1), ([5], 1)]
    assert merged[1]["content"] == "# A\n## B\nb text\n\n## C\nc text\n\n### D\nd text"
    out = c.split_oversized(c.merge_sections(parts, 60), 60).orderBy("position").collect()
    assert out[-1]["part"] == f"{len(out) - 3}/{len(out) - 3}" and out[-1]["split_from"] == 3 and all(r["length"] <= 60 for r in out)
    table = spark.createDataFrame([(1, 0, 0, [], "x" * 900, 225, True)], c.headed_sections(docs(spark)).schema)
    assert c.split_oversized(table, 60).collect()[0]["part"] is None
    final = c.document_chunks(docs(spark, MARKDOWN), 60).orderBy("metadata.position").collect()
    assert (final[1]["metadata"]["H1"], final[1]["metadata"]["file_name"], final[1]["metadata"]["position"], final[1]["embedding"]) == ("A", "0.md", 2, "None")
    assert "".join(MARKDOWN.split()) == "".join("".join(r["chunk_text"] for r in final).split())


def test_merging_takes_documents_of_one_batch_apart(spark):
    texts = [MARKDOWN, "only text", "# A\n" + "".join(f"## {k}\nwords of {k}\n" for k in range(500)), "# A\ntext\n# B\ntext"]
    alone = [[tuple(r)[1:] for r in c.merge_sections(c.headed_sections(docs(spark, x)), 60).orderBy("position").collect()] for x in texts]
    rows = c.merge_sections(c.headed_sections(docs(spark, *texts).coalesce(1)), 60).orderBy("doc_id", "position").collect()
    assert [[tuple(r)[1:] for r in rows if r["doc_id"] == k] for k in range(4)] == alone
    large = [r for r in rows if r["doc_id"] == 2]
    assert [r["position"] for r in large] == list(range(len(large))) and [n for r in large for n in r["merged_from"]] == list(range(500))
    assert all(r["length"] <= 60 and r["merge_count"] == len(r["merged_from"]) == r["content"].count("## ") and not r["is_table"] for r in large)


def test_splits_in_and_after_a_table_of_contents(spark):
    text = "Contents\n[One][1](a)\n[Two\nlines](b)\n\n\n\nText begins.\n# Head\nlast"
    got = {r["line_no"]: (r["kind"], r["priority"]) for r in c.split_points(docs(spark, text)).collect()}
    assert got[1] == ("toc_safe_break", 15) and 2 not in got and got[3] == ("toc_safe_break", 15)
    assert got[4] == ("toc_end", 95) and got[5] == ("paragraph_break", 100) and got[7] == ("sentence_end", 70) and got[8] == ("header", 90)


def test_split_long_without_a_place_to_split(spark):
    rows = c.split_long(docs(spark, "x" * 1000, "line of text\n" * 60), 50).orderBy("doc_id", "part").collect()
    assert "".join(r["content"] for r in rows if r["doc_id"] == 0) == "x" * 1000
    assert all(len(r["content"]) // 4 <= 50 for r in rows)


def test_split_long_goes_on_until_all_parts_fit(spark):
    text = "A sentence of some words.\n" * 400
    found = c.split_long(docs(spark, text, "x" * 20000, text[:9000]), 50).collect()
    parts = {k: [r["content"] for r in sorted(found, key=lambda r: r["part"]) if r["doc_id"] == k] for k in range(3)}
    assert ["".join(parts[k]) for k in range(3)] == [text, "x" * 20000, text[:9000]]
    assert all(len(parts[k]) > 40 and max(map(len, parts[k])) // 4 <= 50 for k in range(3))
    # Each cut is the best one for what was left.
    rests = ["".join(parts[0][k:]) for k in range(len(parts[0]))]
    best = {r["doc_id"]: r["position"] for r in c.best_splits(docs(spark, *rests), 50).collect()}
    assert best == {k: len(part) for k, part in enumerate(parts[0][:-1])}
    final = c.document_chunks(docs(spark, "# A\n" + text), 50).collect()
    assert len(final) > 60 and all(int(r["lenght"]) <= 50 for r in final)
    whole = "".join(r["chunk_text"] for r in sorted(final, key=lambda r: r["metadata"]["position"]))
    assert "".join(whole.split()) == "".join(("# A\n" + text).split())


def test_split_long_in_odd_texts_cuts_where_it_is_best(spark):
    """Tables of contents, entries over several lines, line ends of other kinds: what is left is judged anew after each cut."""
    entry = "[One][1](a)\n[Two\nlines](b)\n\n[Three][3](c)\n"
    texts = ["Contents\n" + entry * 12 + "\n\n\nText begins. \u2028\n# Head\n- item one\n" + "12. item: \n\u00e9\x85\n" * 30, "CONTENTS [\n" * 60, "\r\n \t\nword!\u2029\n" * 60, "# contents\n- x\n(\n" * 40]
    rests = [(text, cut, following) for text in texts for cuts in [[0, *c._cuts(text, 20)]] for cut, following in zip(cuts, cuts[1:])]
    best = {r["doc_id"]: r["position"] for r in c.best_splits(docs(spark, *[text[cut:] for text, cut, _ in rests]), 20).collect()}
    fits = [k for k, (text, cut, _) in enumerate(rests) if k in best and len(text[cut : cut + best[k]].strip()) // 4 <= 20]
    assert len(fits) > 40 and all(best[k] == rests[k][2] - rests[k][1] for k in fits)


def test_split_long_takes_rows_one_by_one(spark):
    rows = spark.createDataFrame([(1, "a b. " * 100), (1, "a b. " * 100), (None, "c d. " * 100), (2, None), (3, "")], "doc_id long, text string")
    found = [tuple(r) for r in c.split_long(rows, 50).collect()]
    assert sum(len(x) for k, _, x in found if k == 1) == 1000 and sum(len(x) for k, _, x in found if k is None) == 500
    assert [x for x in found if x[0] in (2, 3)] == [(2, 0, None), (3, 0, "")]


def test_text_rules(spark):
    found = one(spark, x.text_extraction(F.col("c0")), "Microsoft develops Windows 11. Windows 11 released in 2021")
    assert [(e["name"], e["type"]) for e in found["entities"]] == [("Microsoft", "Name"), ("Windows 11", "Product"), ("2021", "Date")]
    assert [(r["source"], r["type"], r["target"]) for r in found["relationships"]] == [("Microsoft", "DEVELOPS", "Windows 11"), ("Windows 11", "RELEASED_IN", "2021")]
    reply = '```json\n{"entities": [{"id": "1", "name": "A", "type": "T", "description_node": {"type": "D", "text": "about a"}}], "relationships": []}\n```'
    rows = spark.createDataFrame([("d", 0, "text", reply), ("d", 1, "text", "sorry")], "document string, chunk_id int, content string, reply string")
    got = x.extract_texts(rows, "reply").orderBy("chunk_id").collect()
    assert got[0]["entities"][0]["name"] == "A" and len(got[0]["entities"][0]["description_node"]["embedding"]) == 64 and got[0]["error"] is None
    assert got[1]["entities"] is None and got[1]["error"] == "nothing extracted"
    nodes, edges = text_graph(x.extract_texts(rows, "reply"))
    assert {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()} == {"Document": 1, "Chunk": 2, "Entity": 1, "Description": 1}
    assert nodes.where("label in ('Chunk', 'Description')").where("size(embedding) = 64").count() == 3


def test_table_rules(spark):
    table = "Staff\n\n| Id | Department | Place |\n| --- | --- | --- |\n| EMP001 | Engineering | New York |\n| EMP002 | Engineering | |"
    found = one(spark, x.table_extraction(F.col("c0"), F.lit("staff")), table)
    assert [(n["name"], n["type"]) for n in found["nodes"]] == [("staff", "Table"), ("EMP001", "Item"), ("EMP002", "Item"), ("Engineering", "Department"), ("New York", "Place"), ("Engineering", "Department")]
    assert found["nodes"][1]["properties"] == {"Id": "EMP001", "Department": "Engineering", "Place": "New York"} and len(found["edges"]) == 5
    rows = spark.createDataFrame([("d", 0, table), ("d", 1, "Plain words of Somebody")], "document string, chunk_id int, content string")
    nodes, edges = x.graph_of(rows)
    counts = {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()}
    assert counts == {"Document": 1, "Chunk": 2, "Table": 1, "Item": 2, "Entity": 4, "Relationship": 1, "Description": 8}
    item = nodes.where("name = 'EMP001'").first()
    assert item["properties"]["Place"] == "New York"
    assert edges.where("type = 'MENTIONS'").count() == 5 and edges.where("type = 'DESCRIBE'").count() == 5
    assert nodes.where("label = 'Chunk' and size(embedding) = 64 and summary is not null").count() == 2
    assert table_graph(x.extract_tables(rows.limit(0)))[0].count() == 0


def test_created_ids_are_stable_and_merge_orders_hold(spark):
    rows = spark.createDataFrame([("a", "T"), ("a", "U")], "name string, type string")
    first, again = (sorted(r["id"] for r in create.entities(rows).collect()) for _ in range(2))
    assert first == again and len(set(first)) == 2
    chunk = spark.createDataFrame([("t", "s", 1, {"summary": "other", "id": "given"})], "text string, summary string, chunk_number int, metadata map<string,string>")
    got = create.chunks(chunk).first()
    assert got["id"] == "given" and got["properties"]["summary"] == "other" and got["labels"] == ["Chunk"]
    assert create.clear.__doc__ and create.sample(rows, "type", 1).collect() == create.sample(rows, "type", 1).collect()


def test_clear_wants_a_confirmation(spark, tmp_path):
    path = str(tmp_path / "graph")
    nodes, edges = text_graph(x.extract_texts(spark.createDataFrame([("d", 0, "A text of Ann")], "document string, chunk_id int, content string")))
    files.write_graph(nodes, edges, path)
    with pytest.raises(ValueError):
        create.clear(spark, path)
    assert files.read_graph(spark, path)[0].where("label = 'Entity'").count() == 2
    create.clear(spark, path, confirm=True)
    assert not (tmp_path / "graph").exists()


def test_text_decoding_and_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, content in {"a/utf8": "naïve 中".encode(), "a/bom": b"\xef\xbb\xbfx", "a/utf16": "héllo".encode("utf-16"), "a/le": "hello".encode("utf-16-le"), "latin": "café".encode("latin-1")}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_texts(spark, f"{tmp_path}/*").unionByName(files.read_texts(spark, f"{tmp_path}/a")).collect()}
    assert got["utf8"] == "naïve 中" and got["bom"] == "x" and got["utf16"] == "héllo" and got["le"] == "hello" and got["latin"] == "café"
    counts = {r["folder"].rsplit("/", 1)[1]: r["files"] for r in files.folder_counts(spark, str(tmp_path)).collect()}
    assert counts == {"a": 4, tmp_path.name: 1}


def test_sinks(spark, tmp_path):
    answers = spark.createDataFrame([(1, "q", "a", True), (2, "r", "", False)], "question_index int, question string, answer string, answerable boolean")
    files.write_answers(answers, retrieval.answer_metadata(answers, "rules", "en", "en_embedding", stamp=F.lit("now")), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/answers").count() == 2
    block = spark.read.json(f"{tmp_path}/out/metadata").first()
    assert (block["total_questions"], block["answerable_questions"], block["document_scope"], block["timestamp"]) == (2, 1, "global_graph", "now")
    questions = spark.createDataFrame([(1, "q", "en"), (1, "f", "de")], "question_index int, question string, language string")
    files.write_questions(questions, f"{tmp_path}/q")
    files.write_questions(questions.where("language = 'de'").withColumn("question", F.lit("neu")), f"{tmp_path}/q")
    assert {(r["language"], r["question"]) for r in spark.read.parquet(f"{tmp_path}/q").collect()} == {("en", "q"), ("de", "neu")}
    files.write_json(answers, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    files.write_markdown(spark.createDataFrame([("d1", "# x"), ("d2", "# y")], "path string, text string"), f"{tmp_path}/md")
    assert spark.read.text(f"{tmp_path}/md/path=d1").first()[0] == "# x"
    (tmp_path / "g.json").write_text('[{"chunk_id": "1", "text": "t", "nodes": [{"id": "a", "properties": {"k": "v"}}], "edges": []}]')
    row = files.read_graph_documents(spark, f"{tmp_path}/g.json").first()
    assert row["nodes"][0]["properties"] == {"k": "v"} and row["edges"] == []


def test_small_text_functions(spark):
    assert one(spark, t.content("c0", "c1"), None, "b") == "b"
    assert one(spark, t.marked_chunks(F.col("c0")), "x ===CHUNK START===\n a \n===CHUNK END===y===CHUNK START===b===CHUNK END===") == ["a", "b"]
    assert one(spark, t.words_for_tokens(F.col("c0")), 100, kind="int") == 75
    assert one(spark, t.column_list(F.col("c0")), "a, b ,c") == ["a", "b", "c"]
    assert tuple(one(spark, t.row_and_column(F.col("c0")), "AA3")) == (3, 27) and one(spark, t.row_and_column(F.col("c0")), "x") is None
    assert one(spark, t.parse_iso(F.col("c0")), "no time") is None
    assert one(spark, models.embed_one(F.col("c0")), " ") == [] and len(one(spark, models.embed_one(F.col("c0")), "a word")) == 64
    assert one(spark, t.fill("{a}-{b}-{a}", a=F.col("c0"), b=F.lit(None)), "x") == "x--x"


def test_embedding_costs_a_word_no_walk_over_all_components(spark):
    text = " ".join(f"word{k % 700}" for k in range(30_000))
    docs = spark.createDataFrame([(text,), ("",), (None,), ("One one two",)], "text string").coalesce(1).cache()
    docs.count()

    def timed(dimension):
        began = time.perf_counter()
        got = [r["v"] for r in docs.select(models.embed(F.col("text"), dimension).alias("v")).collect()]
        return time.perf_counter() - began, got

    timed(64)
    (few, _), (many, got) = timed(64), timed(4096)
    assert many < 10 * few + 5
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 4096
    for found, words in zip(got, (text.split(), [], [], ["one", "one", "two"]), strict=True):
        counts = np.bincount([place(w) for w in words], minlength=4096).astype(float) if words else np.zeros(4096)
        assert found == (counts / (math.sqrt((counts**2).sum()) or 1.0)).tolist()


def test_captions_return(spark):
    rows = docs(spark, "# Head\nfirst part\nsecond words follow here", "no place", "has [IMAGE_DESCRIPTION]: known")
    lost = spark.createDataFrame([(0, 1, "one", "", "Second words follow there"), (0, 2, "two", "first part", "absent phrase"), (1, 1, "three", "?", "?"), (2, 1, "known", "", "")], "doc_id long, image int, description string, context_before string, context_after string")
    got = {r["doc_id"]: r["text"] for r in layout.restore_captions(rows, lost).collect()}
    assert got[0] == "# Head\nfirst part\n[IMAGE_DESCRIPTION]: two\n\n\n[IMAGE_DESCRIPTION]: one\nsecond words follow here"
    assert "[IMAGE_DESCRIPTION]: three" in got[1] and got[2].endswith("known")


def test_scope_of_an_unknown_document(spark):
    nodes = spark.createDataFrame([("d", "Document")], "id string, label string")
    edges = spark.createDataFrame([], "src string, dst string, type string")
    with pytest.raises(ValueError):
        vectors.scoped(nodes, edges, "x")
    assert vectors.scoped(nodes, edges, "d").count() == 0


def test_ask_all_stops_without_vectors(spark):
    questions = spark.createDataFrame([(1, "what is it", {})], "question_index int, question string, embeddings map<string, array<double>>")
    nodes = spark.createDataFrame([("a", "Chunk", "It is that.", [1.0, 0.0])], "id string, label string, text string, embedding array<double>")
    assert retrieval.ask_all(questions, nodes, "en", lambda q: F.lit(None).cast("array<double>")).count() == 0
    got = retrieval.ask_all(questions, nodes, "en", lambda q: F.array(F.lit(1.0), F.lit(0.0)), least=-1.0).first()
    assert got["context"] == "=== CONTEXT INFORMATION ===\nContent: It is that." and got["embedding_field_used"] == "en"


def test_one_question_and_its_scope(spark):
    nodes = spark.createDataFrame(
        [("d1", "Document", "one", None, [1.0, 0.0]), ("d2", "Document", "two", None, [0.0, 1.0]), ("c1", "Chunk", None, "Rivers carry water. Mountains stand still.", [1.0, 0.1]), ("c2", "Chunk", None, "Mountains are tall here.", [1.0, 0.0])],
        "id string, label string, name string, text string, embedding array<double>",
    )
    edges = spark.createDataFrame([("d1", "c1", "CONTAINS"), ("d2", "c2", "CONTAINS")], "src string, dst string, type string")
    full = nodes.withColumns({"summary": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
    one = retrieval.ask_question("Where do mountains stand", [1.0, 0.0], full, edges, "d1").first()
    assert (one["answer"], one["answerable"], one["document_scope"], one["method"]) == ("Mountains stand still.", True, "d1", "hybrid")
    every = retrieval.ask_question("Where do mountains stand", [1.0, 0.0], full, k=2, hybrid=False).first()
    assert every["document_scope"] == "global_graph" and every["method"] == "semantic" and "tall here" in every["context"]
    # without the columns that the hybrid score reads, the plain search answers
    plain = retrieval.ask_question("Where do mountains stand", [1.0, 0.0], nodes, edges, "d2", keywords=["x"]).first()
    assert plain["method"] == "semantic" and plain["answer"].endswith("Mountains are tall here.")
    none = retrieval.ask_question("Where?", [0.0, 0.0], full).first()
    assert (none["context"], none["answerable"]) == ("", False)
    with pytest.raises(ValueError, match="vector"):
        retrieval.ask_question("Where?", [], full)
    with pytest.raises(ValueError, match="no document"):
        retrieval.ask_question("Where?", [1.0], full, edges, "d9")


def test_chunks_are_found_from_either_side(spark):
    edges = spark.createDataFrame([("e1", "c1", "X"), ("d1", "e1", "X"), ("d2", "c1", "X"), ("d3", "c2", "X"), ("d3", "x", "X")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(n, {"c": "Chunk", "d": "Description", "e": "Entity", "x": "Entity"}[n[0]]) for n in ("c1", "c2", "c3", "d1", "d2", "d3", "e1", "x")], "id string, label string")
    expected = {"d1": {("c1", 2)}, "d2": {("c1", 1)}, "d3": {("c2", 1)}}
    for some in (["d1", "d2", "d3"], ["d1"], ["d1", "d2", "d3", "e1", "x"]):
        got = retrieval.chunks_of(edges, nodes, spark.createDataFrame([(x,) for x in some], "id string"), 2).where("target like 'd%'").collect()
        assert {t: {(r["chunk"], r["hops"]) for r in got if r["target"] == t} for t in some if t in expected} == {t: expected[t] for t in some if t in expected}


def test_consumed_rows_do_not_depend_on_partitions(spark, sf_dir):
    from docweave.plans.knowledge_queries import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = [tuple(r) for r in QUERIES["profile_retrieval"](spark, sf_dir).collect()]
            assert len(rows) == len(set(rows)) == 25
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_oversized_sections_are_computed_once(spark):
    """The merged sections are read by several branches; what makes them runs once for each row."""
    from docweave.operators import chunking

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    schema = "doc_id long, position int, level int, path array<string>, content string, length int, is_table boolean, merged_from array<int>, merge_count int"
    rows = [(k, 0, 1, ["h"], "word. " * n, n * 6 // 4, False, [0], 1) for k, n in enumerate((2, 100, 300))]
    parts = chunking.split_oversized(spark.createDataFrame(rows, schema).mapInPandas(count, schema), 60).collect()
    assert made.value == len(rows) and {p["doc_id"] for p in parts} == {0, 1, 2} and all(p["length"] <= 60 for p in parts)
