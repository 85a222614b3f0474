"""From chunks to extractions: entities and relationships of prose, tables with items and entities, and the loop around both.

The default extractors are rules in column expressions. A provider's replies take
their place as a column of JSON text; replies that are no JSON extract nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import has_pipe_table, json_block_with, let, parsed, sentences, strip, words
from docweave.operators.build import table_graph, text_graph
from docweave.operators.models import embed_one, summarise

#: A name: capitalised words and numbers in a row, or a year.
NAME = r"(?<![\p{L}\p{N}_])\p{Lu}[\p{L}\p{N}_]*(?:\s+(?:\p{Lu}[\p{L}\p{N}_]*|[0-9]+))*|(?<![\p{L}\p{N}_])[0-9]{4}(?![\p{L}\p{N}_])"
_ABOUT = "struct<type:string,text:string,embedding:array<double>>"
TEXT_SCHEMA = f"entities ARRAY<STRUCT<id:STRING,name:STRING,type:STRING,description_node:{_ABOUT}>>, relationships ARRAY<STRUCT<id:STRING,source:STRING,target:STRING,type:STRING,description_node:{_ABOUT}>>"
TABLE_SCHEMA = "nodes ARRAY<STRUCT<id:STRING,name:STRING,type:STRING,text:STRING,embedding:ARRAY<DOUBLE>,properties:MAP<STRING,STRING>>>, edges ARRAY<STRUCT<source:STRING,target:STRING,type:STRING>>"


def _about(text: Column) -> Column:
    return F.struct(F.lit("Description").alias("type"), text.alias("text"), F.lit(None).cast("array<double>").alias("embedding"))


def name_type(name: Column) -> Column:
    return F.when(name.rlike("^[0-9]{4}$"), "Date").when(name.rlike("[0-9]"), "Product").otherwise("Name")


def text_extraction(text: Column) -> Column:
    """``struct(entities, relationships)`` by rules.

    Entities are the names of a text, each once, described by its first sentence.
    Neighbouring names of a sentence are related by the one to three words between
    them, else as RELATED_TO.
    """
    found = F.transform(sentences(F.coalesce(text, F.lit(""))), lambda s: F.struct(s.alias("s"), F.regexp_extract_all(s, F.lit(NAME), F.lit(0)).alias("names"), F.split(s, NAME, -1).alias("gaps")))

    def entities(fs: Column) -> Column:
        """The names in the order of their first sentences, which sorting by name and place finds."""
        pairs = F.flatten(F.transform(fs, lambda f, i: F.transform(f["names"], lambda n, j: F.struct(n.alias("name"), i.alias("i"), j.alias("j"), f["s"].alias("s")))))
        first = let(F.array_sort(pairs), lambda ps: F.filter(ps, lambda p, k: (k == 0) | (F.get(ps, k - 1)["name"] != p["name"])))
        told = F.array_sort(F.transform(first, lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), p["name"].alias("name"), p["s"].alias("s"))))
        return F.transform(told, lambda p, i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("id"), p["name"].alias("name"), name_type(p["name"]).alias("type"), _about(p["s"]).alias("description_node")))

    def relations(f: Column) -> Column:
        between = lambda i: words(F.regexp_replace(F.get(f["gaps"], i + 1), r"[^\p{L}\s]", " "))
        kind = lambda i: let(between(i), lambda w: F.when(F.size(w).between(1, 3), F.upper(F.array_join(w, "_"))).otherwise("RELATED_TO"))
        ends = F.slice(f["names"], 1, F.greatest(F.size(f["names"]) - 1, F.lit(0)))
        return F.transform(ends, lambda n, i: F.struct(n.alias("source"), F.get(f["names"], i + 1).alias("target"), kind(i).alias("type"), f["s"].alias("s")))

    def relationships(fs: Column) -> Column:
        linked = F.flatten(F.transform(fs, relations))
        return F.transform(linked, lambda r, i: F.struct(F.concat(F.lit("r"), i.cast("string")).alias("id"), r["source"].alias("source"), r["target"].alias("target"), r["type"].alias("type"), _about(r["s"]).alias("description_node")))

    return let(found, lambda fs: F.struct(entities(fs).alias("entities"), relationships(fs).alias("relationships")))


def table_extraction(text: Column, name: Column) -> Column:
    """``struct(nodes, edges)`` of the pipe rows of a text, by rules.

    The table is a node with its columns; each row is an item, named by its first
    cell, with the cells as properties. Every other filled cell is an entity of its column's type.
    """
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), strip), lambda x: x.rlike(r"^\|.*\|$"))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|", -1), strip))
    return let(cells, lambda cs: let(F.coalesce(F.get(cs, 0), F.array().cast("array<string>")), lambda heads: _table(heads, F.filter(F.slice(cs, 2, F.greatest(F.size(cs) - 1, F.lit(1))), lambda c: ~F.forall(c, lambda x: x.rlike("^[-: ]*$"))), name)))


def _table(heads: Column, lines: Column, name: Column) -> Column:
    """The nodes and edges of a table's heads and the cells of its lines."""
    none = F.lit(None).cast("array<double>")

    def node(key: Column, label: Column, kind: Column, properties: Column) -> Column:
        return F.struct(key.alias("id"), label.alias("name"), kind.alias("type"), F.lit(None).cast("string").alias("text"), none.alias("embedding"), properties.cast("map<string,string>").alias("properties"))

    item = lambda i: F.concat(F.lit("r"), i.cast("string"))
    field = lambda i, j: F.concat(item(i), F.lit("c"), j.cast("string"))
    filled = lambda c: F.filter(F.transform(heads, lambda h, j: F.struct(h.alias("h"), j.alias("j"), F.coalesce(F.get(c, j), F.lit("")).alias("v"))), lambda x: x["v"] != "")
    edge = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("type"))
    table = F.array(node(F.lit("t"), name, F.lit("Table"), F.create_map(F.lit("table_name"), name, F.lit("columns"), F.array_join(heads, ", "))))

    def parts(body: Column) -> Column:
        items = F.transform(body, lambda b, i: node(item(i), F.get(b["cells"], 0), F.lit("Item"), F.map_from_entries(F.transform(F.filter(b["filled"], lambda x: F.array_position(heads, x["h"]) == x["j"] + 1), lambda x: F.struct(x["h"], x["v"])))))
        others = F.flatten(F.transform(body, lambda b, i: F.transform(F.filter(b["filled"], lambda x: x["j"] > 0), lambda x: node(field(i, x["j"]), x["v"], x["h"], F.create_map()))))
        holds = F.transform(body, lambda b, i: edge(F.lit("t"), item(i), "CONTAINS"))
        mentions = F.flatten(F.transform(body, lambda b, i: F.transform(F.filter(b["filled"], lambda x: x["j"] > 0), lambda x: edge(item(i), field(i, x["j"]), "MENTIONS"))))
        some = F.size(body) > 0
        empty = lambda x: F.slice(x, 1, 0)
        return F.struct(F.when(some, F.concat(table, items, others)).otherwise(empty(table)).alias("nodes"), F.when(some, F.concat(holds, mentions)).otherwise(empty(holds)).alias("edges"))

    return let(F.transform(lines, lambda c: F.struct(c.alias("cells"), filled(c).alias("filled"))), parts)


def text_reply(reply: Column) -> Column:
    """A provider's reply as ``struct(entities, relationships)``; what is no JSON extracts nothing."""
    return parsed(json_block_with(reply, "entities", "relationships"), TEXT_SCHEMA)


def table_reply(reply: Column) -> Column:
    return parsed(json_block_with(reply, "nodes", "edges"), TABLE_SCHEMA)


def extract_texts(chunks: DataFrame, reply: str | None = None) -> DataFrame:
    """``chunks(document, chunk_id, content)`` of prose as extractions for ``text_graph``: with summary, vectors and ``error``.

    The chunk's vector is that of its text, a description's that of its own. With
    ``reply``, a column of a provider's answers, these take the place of the rules.
    """
    found = text_reply(F.col(reply)) if reply else text_extraction(F.col("content"))
    vectored = lambda xs: F.transform(xs, lambda x: x.withField("description_node", x["description_node"].withField("embedding", embed_one(x["description_node"]["text"]))))
    error = lambda x: F.when(x["entities"].isNull(), "nothing extracted").alias("error")
    out = chunks.withColumn("_x", let(found, lambda x: F.struct(vectored(x["entities"]).alias("entities"), vectored(x["relationships"]).alias("relationships"), error(x))))
    return out.select(
        "document", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("content").alias("chunk_text"), summarise(F.col("content")).alias("summary"), embed_one(F.col("content")).alias("embedding"),
        F.col("_x.entities").alias("entities"), F.col("_x.relationships").alias("relationships"), F.col("_x.error").alias("error"),
    )


def extract_tables(chunks: DataFrame, reply: str | None = None) -> DataFrame:
    """``chunks(document, chunk_id, content)`` of tables as extractions for ``table_graph``; the chunk's vector is that of its summary."""
    found = table_reply(F.col(reply)) if reply else table_extraction(F.col("content"), F.concat_ws("_", F.col("document"), F.col("chunk_id").cast("string")))
    out = chunks.withColumn("_x", found).withColumn("chunk_summary", summarise(F.col("content")))
    return out.select(
        "document", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("content").alias("text"), "chunk_summary", embed_one(F.col("chunk_summary")).alias("chunk_embedding"),
        F.coalesce("_x.nodes", F.expr("filter(_x.nodes, x -> false)")).alias("nodes"), F.coalesce("_x.edges", F.expr("filter(_x.edges, x -> false)")).alias("edges"), F.when(F.col("_x.nodes").isNull(), "nothing extracted").alias("error"),
    )


def graph_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of chunks ``document, chunk_id, content``: those with a table by the table rules, all others by those of prose."""
    table = F.coalesce(has_pipe_table(F.col("content")), F.lit(False))
    (a, x), (b, y) = text_graph(extract_texts(chunks.where(~table))), table_graph(extract_tables(chunks.where(table)))
    return a.unionByName(b).dropDuplicates(["id"]), x.unionByName(y).distinct()
