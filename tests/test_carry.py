"""The carried-context fold over tables and streams."""

from docweave.operators import carry

CHUNKS = [
    ("a", 0, "Title\n\n| h1 | h2 |\n| --- | --- |\n| 1 | 2 |"), ("a", 1, "| 3 | 4 |\n| 5 | 6 |"), ("a", 2, "text between"), ("a", 3, "| x |\n| y |"),
    ("b", 0, "| only | row |"), ("b", 1, None), ("b", 2, "|  |  |\n| 7 | 8 |"), (None, 0, "no sheet"),
]
CONTEXTS = {
    ("a", 0): "Currently processing: NON-TABLE content",
    ("a", 1): "Currently processing: TABLE\nTable headers: h1 | h2\nLast 3 rows:\n  Row 1: h1 | h2\n  Row 2: 1 | 2",
    ("a", 2): "Currently processing: TABLE\nTable headers: h1 | h2\nLast 3 rows:\n  Row 1: 1 | 2\n  Row 2: 3 | 4\n  Row 3: 5 | 6",
    ("a", 3): "Currently processing: NON-TABLE content\nLast 3 rows:\n  Row 1: 1 | 2\n  Row 2: 3 | 4\n  Row 3: 5 | 6",
    ("b", 0): "Currently processing: NON-TABLE content",
    ("b", 1): "Currently processing: TABLE\nTable headers: only | row\nLast 3 rows:\n  Row 1: only | row",
    ("b", 2): "Currently processing: NON-TABLE content\nLast 3 rows:\n  Row 1: only | row",
    (None, 0): "Currently processing: NON-TABLE content",
}


def frame(spark, rows=CHUNKS):
    return spark.createDataFrame(rows, "sheet string, n int, chunk string").repartition(3)


def test_contexts_of_a_table(spark):
    got = carry.folded(frame(spark)).collect()
    assert {(r["sheet"], r["n"]): r["context"] for r in got} == CONTEXTS and len(got) == len(CHUNKS)
    assert {(r["sheet"], r["n"]): r["content"] for r in got} == {(s, n): c or "" for s, n, c in CHUNKS}
    assert carry.folded(frame(spark).where("false")).count() == 0


def test_another_reader(spark):
    def reader(context, chunk):
        return "plain" if chunk == "text between" else {"content": str(len(context)), "current_table_header": ["q"], "last_three_rows": [[1]] * 5}

    got = {(r["sheet"], r["n"]): r for r in carry.folded(frame(spark), reader).collect()}
    assert got["a", 2]["content"] == "plain" and got["a", 3]["context"] == got["a", 2]["context"]
    assert got["a", 3]["context"] == "Currently processing: NON-TABLE content\nTable headers: q\nLast 3 rows:\n  Row 1: 1\n  Row 2: 1\n  Row 3: 1"


def test_stream_gives_the_rows_of_the_table(spark, tmp_path):
    for part in range(4):
        some = [c for c in CHUNKS if c[1] == part]
        frame(spark, some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        arriving = spark.readStream.schema("sheet string, n int, chunk string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = carry.folded_stream(arriving).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(240)
        got = {(r["sheet"], r["n"]): r["context"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == CONTEXTS
