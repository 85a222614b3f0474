"""Queries over the builders, the layout operators and the event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import build, layout
from docweave.plans.tables import read
from docweave.streaming import events as s

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _entity(name: str, kind: str, text: str):
    about = F.struct(F.lit("Description").alias("type"), F.expr(text).cast("string").alias("text"), F.array().cast("array<double>").alias("embedding"))
    return F.struct(F.lit("x").alias("id"), F.expr(name).alias("name"), F.lit(kind).alias("type"), about.alias("description_node"))


@query("""SELECT 'node' AS kind, 'Document' AS name, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'node', 'Chunk', count(*) FROM documents UNION ALL SELECT 'node', 'Entity', 2 * count(*) FROM documents
UNION ALL SELECT 'node', 'Relationship', count(*) FROM documents WHERE lang <> 'es' UNION ALL SELECT 'node', 'Description', count(*) FROM documents
UNION ALL SELECT 'edge', 'CONTAINS', count(*) FROM documents UNION ALL SELECT 'edge', 'MENTIONS', 2 * count(*) FROM documents UNION ALL SELECT 'edge', 'DESCRIBES', count(*) FROM documents UNION ALL SELECT 'edge', 'RELATED', 2 * count(*) FROM documents WHERE lang <> 'es'""")
def text_graph_build(spark, sf_dir):
    """A graph of all documents with two entities each, and relationships, some of which name an entity that is not there."""
    return build.build_counts(*build.text_graph(written_in(spark, sf_dir)))


def written_in(spark, sf_dir):
    """All documents as extractions: two entities each, and a relationship, which for some names an entity that is not there."""
    relation = F.struct(F.lit("r").alias("id"), F.col("lang").alias("source"), F.expr("if(lang = 'es', 'nobody', source)").alias("target"), F.lit("WRITTEN_IN").alias("type"), F.lit(None).cast("struct<type:string,text:string,embedding:array<double>>").alias("description_node"))
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("document"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"),
        F.array(_entity("lang", "Language", "concat('written in ', lang)"), _entity("source", "Source", "''")).alias("entities"), F.array(relation).alias("relationships"),
    )


@query("""WITH o AS (SELECT * FROM orders), c AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)
SELECT 'node' AS kind, 'Document' AS name, count(DISTINCT o_orderpriority) AS n FROM o UNION ALL SELECT 'node', 'Chunk', count(*) FROM o UNION ALL SELECT 'node', 'Table', count(*) FROM o UNION ALL SELECT 'node', 'Item', count(*) FROM o
UNION ALL SELECT 'node', 'Entity', (SELECT count(*) FROM c) + count(DISTINCT o_orderpriority || o_orderstatus) FROM o UNION ALL SELECT 'node', 'Relationship', count(*) FROM o
UNION ALL SELECT 'node', 'Description', 3 * count(*) + (SELECT count(*) FROM c) + count(DISTINCT o_orderpriority || o_orderstatus) FROM o
UNION ALL SELECT 'edge', 'CONTAINS', 3 * count(*) FROM o UNION ALL SELECT 'edge', 'MENTIONS', 2 * count(*) FROM o
UNION ALL SELECT 'edge', 'DESCRIBE', 3 * count(*) + (SELECT count(*) FROM c) + count(DISTINCT o_orderpriority || o_orderstatus) FROM o UNION ALL SELECT 'edge', 'SOURCE', count(*) FROM o UNION ALL SELECT 'edge', 'TARGET', count(*) FROM o""")
def table_graph_build(spark, sf_dir):
    """A graph of all orders as table records: a table, its item, its customer and a state in each chunk."""
    return build.build_counts(*build.table_graph(orders_as_tables(spark, sf_dir)))


def orders_as_tables(spark, sf_dir):
    """All orders as table records, one a chunk."""
    orders = read(spark, sf_dir, "orders")
    empty = F.create_map().cast("map<string,string>")

    def node(key: str, name: str, kind: str):
        return F.struct(F.lit(key).alias("id"), F.expr(name).cast("string").alias("name"), F.lit(kind).alias("type"), empty.alias("properties"))

    def edge(source: str, target: str, kind: str):
        return F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(kind).alias("type"))

    return orders.select(
        F.col("o_orderpriority").alias("document"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.lit("").alias("text"),
        F.array(node("t", "'orders'", "Table"), node("i", "o_orderkey", "Item"), node("c", "o_custkey", "Customer"), node("s", "o_orderstatus", "State")).alias("nodes"),
        F.array(edge("t", "i", "CONTAINS"), edge("c", "i", "MENTIONS"), edge("c", "i", "MENTIONS"), edge("c", "s", "HAS_STATE")).alias("edges"),
    )


_BOX = "SELECT user_id AS page, event_id AS seq, event_type, value AS y FROM events"


@query(f"WITH b AS ({_BOX}) SELECT page, seq FROM b WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.event_type = 'purchase' AND t.page = b.page AND b.y >= t.y - 10 AND b.y + 5 <= t.y + 30)")
def outside_tables(spark, sf_dir):
    """Text blocks that lie in no table."""
    box = lambda kind, high: read(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.lit(0.0).alias("x0"), F.lit(10.0).alias("x1"), F.col("value").alias("y0"), (F.col("value") + high).alias("y1"), F.lit(high).cast("double").alias("height"))
    return layout.outside_tables(box("view", 5), box("purchase", 20)).select("page", "seq")


@query(f"WITH b AS (SELECT *, seq % 7 * 4 AS w FROM ({_BOX})) SELECT page, seq FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.page = b.page AND o.seq < b.seq AND abs(o.w - b.w) < 10 AND abs(o.y - b.y) < 20)")
def distinct_images(spark, sf_dir):
    images = read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), (F.col("event_id") % 7 * 4).alias("width"), F.lit(1).alias("height"), F.col("value").alias("y"))
    return layout.distinct_images(images).select("page", "seq")


@query(f"WITH b AS ({_BOX}), t AS (SELECT * FROM b WHERE event_type = 'view'), d AS (SELECT * FROM b WHERE event_type = 'click') SELECT t.page, t.seq, (SELECT min_by(d.seq % 20, d.seq) FROM d WHERE d.page = t.page AND abs(d.y - t.y) < 5) AS font_size FROM t")
def fonts_of_blocks(spark, sf_dir):
    of = lambda kind: read(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), F.col("value").alias("y"))
    return layout.fonts_of(of("view"), of("click").withColumn("font_size", F.col("seq") % 20)).select("page", "seq", "font_size")


_KIND = "CASE event_type WHEN 'click' THEN 'image' WHEN 'purchase' THEN 'table' ELSE 'text' END"


@query(f"""WITH e AS (SELECT *, {_KIND} AS kind FROM ({_BOX})), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY page, y, seq) - 1 AS i FROM e)
SELECT page, string_agg(CASE kind WHEN 'image' THEN '[image placeholder ' || i || ']' WHEN 'table' THEN '[TABLE_DATA]' || chr(10) || event_type ELSE event_type END, chr(10) || chr(10) ORDER BY y, seq) AS text FROM n GROUP BY page""")
def page_texts(spark, sf_dir):
    """The elements of each page from top to bottom."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("value").alias("y"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"), F.col("event_type").alias("content"))
    return layout.page_texts(e)


@query("""SELECT user_id AS doc_id, event_id AS line_no, CASE WHEN event_type = 'view' AND b.text IS NOT NULL THEN '[IMAGE_DESCRIPTION]: ' || b.text WHEN event_type = 'view' THEN '[image placeholder ' || (event_id % 60) || ']' ELSE event_type END AS line
FROM events LEFT JOIN benchmark b ON b.item_id = event_id % 60""")
def insert_captions(spark, sf_dir):
    """Image places get their captions; those without one stay."""
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("[image placeholder "), (F.col("event_id") % 60).cast("string"), F.lit("]"))).otherwise(F.col("event_type"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), line.alias("line"))
    return layout.insert_captions(rows, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image"), F.col("text").alias("description")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Counts by hour; the same function runs over a stream."""
    return s.windowed(read(spark, sf_dir, "events"), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    """Sessions of users that end after six quiet hours."""
    return s.sessions(read(spark, sf_dir, "events"), "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
