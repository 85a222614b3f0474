"""Text functions on small cases."""

import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.operators import chunking as c


def one(spark, expression, **columns):
    return spark.createDataFrame([Row(**columns)]).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "expected"), [("a|b", "a&#124;b"), ("x\ny\r", "x<br>y"), (" *b_ ", "\\*b\\_"), ("", "")])
def test_cell(spark, value, expected):
    assert one(spark, t.cell(F.col("v")), v=value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("| a | b |\n|---|---|\n| 1 | 2 |", True),
        ("+---+\n| a |\n+===+\n| b |\n+---+", True),
        ("a | b\nc | d\ne | f", True),
        ("one | line", False),
        ("no table\nat all", False),
    ],
)
def test_is_table(spark, value, expected):
    assert one(spark, t.is_table(F.col("v")), v=value) is expected


@pytest.mark.parametrize(("value", "expected"), [("## {.css}", True), ("###", True), ("# ab", True), ("# Long heading", False), ("text", False)])
def test_empty_heading(spark, value, expected):
    assert one(spark, t.is_empty_heading(F.col("v")), v=value) is expected


@pytest.mark.parametrize(
    ("value", "answer", "answerable", "context"),
    [
        ("Answer: A\n========\nAnswerable: True\n========\nRelated Context: C", "A", True, "C"),
        ("Answer: A\n========\nAnswerable: có\n========\nRelated Context: ", "A", True, ""),
        ("Answer: A\n========\nno", "Answer: A\n========\nno", True, ""),
        ("", "", False, ""),
    ],
)
def test_parse_answer(spark, value, answer, answerable, context):
    assert tuple(one(spark, t.parse_answer(F.col("v")), v=value)) == (answer, answerable, context)


@pytest.mark.parametrize(("value", "expected"), [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so: {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ("none", None)])
def test_json_block(spark, value, expected):
    assert one(spark, t.json_block(F.col("v")), v=value) == expected


def test_file_type_rejects_others(spark):
    assert one(spark, t.file_type(F.col("v")), v="/a/b.docx") == "docx"
    with pytest.raises(Exception, match="unsupported file type"):
        one(spark, t.file_type(F.col("v")), v="/a/b.txt")


@pytest.mark.parametrize(("response", "fixed", "compat"), [("it is Web", "Web", "Web"), ("unknown", "Unknown", "Mobile"), ("", "Unknown", "Mobile"), ("none of them", "Unknown", "Unknown")])
def test_first_label(spark, response, fixed, compat):
    labels = F.array(F.lit("Mobile"), F.lit("Web"))
    assert one(spark, t.first_label(F.col("v"), labels), v=response) == fixed
    assert one(spark, t.first_label(F.col("v"), labels, compat=True), v=response) == compat


def test_keywords(spark):
    assert one(spark, t.keywords(F.col("v")), v="What is the Budget? 42 x 中 budget plan_b") == ["budget", "plan_b", "中"]


def test_chunks_keep_all_words_and_the_limit(spark):
    text = "One short. " * 30 + "\n\n" + "word " * 400 + "\n\n" + "x" * 900
    rows = c.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), limit=50).orderBy("chunk_id").collect()
    assert [w for r in rows for w in r["content"].split()] == text.split()
    assert all(r["token_count"] <= 50 or " " not in r["content"] for r in rows)


def test_table_rows_repeat_the_heading(spark):
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {k} | {'v' * 30} |" for k in range(20))
    rows = c.chunks(spark.createDataFrame([(1, table)], "doc_id long, text string"), limit=40).orderBy("chunk_id").collect()
    assert len(rows) > 1
    assert all(r["content"].startswith("| a | b |\n| --- | --- |\n| ") and r["token_count"] <= 40 for r in rows)
    assert [line for r in rows for line in r["content"].split("\n")[2:]] == table.split("\n")[2:]


def test_sections_carry_their_path(spark):
    text = "before\n# A\nunder a\n### C\nunder c\n```\n# no heading\n```\n## B\nunder b\n# D\n"
    rows = c.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()
    got = [(r["h1"], r["h2"], r["h3"], r["content"]) for r in rows]
    assert got == [(None, None, None, "before"), ("A", None, None, "under a"), ("A", None, "C", "under c\n```\n# no heading\n```"), ("A", "B", None, "under b"), ("D", None, None, "")]


def test_empty_headings_move_forward(spark):
    rows = spark.createDataFrame([(1, 0, "# x"), (1, 1, "body one is long enough to stay"), (1, 2, "##"), (1, 3, "###"), (1, 4, "body two is long enough to stay"), (1, 5, "#")], "doc_id long, position int, content string")
    got = c.merge_empty_headings(rows).orderBy("position").collect()
    assert [r["content"] for r in got] == ["# x\n\nbody one is long enough to stay", "##\n\n###\n\nbody two is long enough to stay"]


def test_tables_of_contents_are_split_last(spark):
    text = "Contents\n[a][b](c)\n[d][e](f)\n# Start\nOne.\n\nTwo:\nthree\n- four"
    kinds = [r["kind"] for r in c.split_points(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("line_no").collect()]
    assert kinds == [*["toc_safe_break"] * 3, "header", "sentence_end", "paragraph_break", "colon_end", "line_break", "list_item"]


def test_split_long_loses_nothing(spark):
    texts = ["# A\n" + "A sentence of some words.\n" * 40 + "\nlast line\n" * 5, "short", "x" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = c.split_long(df, limit=60).orderBy("doc_id", "part").collect()
    for k, text in enumerate(texts):
        parts = [r["content"] for r in rows if r["doc_id"] == k]
        assert "".join(parts) == text
        assert k == 2 or all(len(p) // 4 <= 60 for p in parts)


def test_tables_with_long_rows_are_found_in_time(spark):
    """Places of marks come from what stands between them, not from a look at each character of a row."""
    row = "| " + "w" * 200_000 + " | \u00e9\U0001f600 |"
    texts = {f"{row}\n{row}\n{row}": True, f"{row}\n{'|' * 3}\nx | y": False, "a | b\nc | d\ne | f": True, "a | b\nccc | d\n\n|e": False, "| a |\n|-|": True, "||\n||\n||": True, "+--+\n+==+": True, "|": False, "": False}
    started = time.time()
    rows = spark.createDataFrame([*texts.items(), (None, False)], "x string, found boolean").select("found", t.is_table(F.col("x")).alias("got")).collect()
    assert all(r["got"] == r["found"] for r in rows) and time.time() - started < 20


def test_kilobytes_are_rounded_as_python_does(spark):
    sizes = [153.6, 256.0, 768.0, 51.2, 358.4, 0.0, -153.6, 1234567.89, 1.0e9, 1023.99, *[k * 25.6 for k in range(200)]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(sizes)], "k int, x double").select("k", t.kilobytes(F.col("x")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in rows} == {k: f"{x / 1024:.1f} KB" for k, x in enumerate(sizes)}
