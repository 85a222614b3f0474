"""Extractions into a graph: the builders for text and table documents.

Both work on one row a chunk: ids are resolved and edges made inside the row, by
array functions; the rows are written once, and nodes and edges are read from
them. Only nodes and edges that several chunks may name meet in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import describe, let, make_id
from docweave.operators.store import Store

_NODE = "id string, label string, name string, type string, text string, summary string, embedding array<double>, properties map<string,string>"
_FIELDS = [field.split(" ", 1) for field in _NODE.split(", ")]
_EDGE = "src string, dst string, type string"


def _node(key: Column, label: str | Column, pos: Column, shared: Column | None = None, **values: Column) -> Column:
    """One node as a struct of all fields, ``pos``, its place in the chunk, and ``shared``: whether other chunks may name it too."""
    given = {"id": key, "label": F.lit(label) if isinstance(label, str) else label, **values}
    return F.struct(*[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FIELDS], pos.cast("int").alias("pos"), (F.lit(False) if shared is None else shared).alias("shared"))


def _edge(src: Column, dst: Column, kind: str, shared: Column | None = None) -> Column:
    """One edge; ``shared`` as in ``_node``, which it is only if both its ends are."""
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), (F.lit(False) if shared is None else shared).alias("shared"))


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _member(item: Column, fields: set[str], name: str, kind: str) -> Column:
    """A field of a struct whose schema may lack it."""
    return item[name].cast(kind) if name in fields else F.lit(None).cast(kind)


def _fields(df: DataFrame, array: str, inner: str | None = None) -> set[str]:
    kind = df.schema[array].dataType.elementType
    return set((kind[inner].dataType if inner else kind).fieldNames()) if inner is None or inner in kind.fieldNames() else set()


def _ids(df: DataFrame) -> DataFrame:
    """With the ids of document and chunk."""
    return df.withColumn("doc", make_id(F.lit("document"), F.col("document"))).withColumn("chunk", make_id(F.lit("chunk"), F.concat_ws("/", "document", "chunk_id")))


def _head(df: DataFrame, text: str, summary: str, embedding: str) -> Column:
    """The nodes of document and chunk."""
    return F.array(
        _node(F.col("doc"), "Document", F.lit(-2), F.lit(True), name=F.col("document")),
        _node(F.col("chunk"), "Chunk", F.lit(-1), text=F.col(text), summary=_optional(df, summary, "string"), embedding=_optional(df, embedding, "array<double>"), properties=_optional(df, "metadata", "map<string,string>")),
    )


def _collected(rows: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of written ``rows(chunk, all_nodes, all_edges)``; of nodes with one id the first, by chunk and place, counts.

    What is not shared belongs to its chunk alone and stays where it is. Only if a chunk comes in several rows,
    or names two of its own nodes alike, all that it has meets the rest by id.
    """
    own = F.transform(F.filter("all_nodes", lambda n: ~n["shared"]), lambda n: n["id"])
    counted = rows.select("chunk", (F.size(own) != F.size(F.array_distinct(own))).alias("alike")).groupBy("chunk").agg(F.count("*").alias("n"), F.bool_or("alike").alias("alike"))
    again = store.save(counted.where("n > 1 or alike").select("chunk", F.lit(True).alias("_again")), "again")
    marked = rows.join(again, "chunk", "left").withColumn("_again", F.coalesce("_again", F.lit(False)))
    met = lambda name: F.filter(name, lambda x: x["shared"] | F.col("_again"))
    alone = lambda name: F.filter(name, lambda x: ~(x["shared"] | F.col("_again")))
    first = marked.select("chunk", F.explode(met("all_nodes")).alias("n")).groupBy("n.id").agg(F.min_by("n", F.struct("chunk", "n.pos")).alias("n")).select("n")
    nodes = first.unionByName(marked.select(F.explode(alone("all_nodes")).alias("n"))).select(*[f"n.{field}" for field, _ in _FIELDS])
    some = marked.select(F.inline(met("all_edges"))).drop("shared").distinct()
    return nodes, some.unionByName(marked.select(F.inline(F.array_distinct(alone("all_edges")))).drop("shared"))


def text_graph(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``extractions(document, chunk_id, chunk_text, entities, relationships[, summary, embedding, metadata])``.

    A document contains its chunks, a chunk mentions its entities, a description
    describes an entity or relationship, and both ends are related to the
    relationship's node. Entities are not merged across chunks. Relationships
    name their ends; of entities of one name the last counts, and those with an
    end that the chunk lacks are left out. Chunks keep summary, vector and
    metadata, descriptions their vectors, so that the graph can be searched.
    """
    df = _ids(extractions)
    df = df.withColumn("head", _head(df, "chunk_text", "summary", "embedding"))
    about = "struct<type:string,text:string,embedding:array<double>>"
    entity = lambda e, i: F.struct(make_id(F.lit("entity"), F.concat_ws("/", "chunk", i.cast("string"))).alias("node"), e["name"].alias("name"), e["type"].alias("type"), e["description_node"].cast(about).alias("d"))
    df = df.withColumn("es", F.transform(F.coalesce("entities", F.expr("cast(array() as " + extractions.schema["entities"].dataType.simpleString() + ")")), entity))
    told_relations = F.coalesce("relationships", F.expr("cast(array() as " + extractions.schema["relationships"].dataType.simpleString() + ")"))

    def relations(nodes: Column, names: Column) -> Column:
        end = lambda name: F.when(F.array_contains(names, name), F.get(nodes, F.array_position(names, name).cast("int") - 1))
        return F.transform(told_relations, lambda r, i: F.struct(make_id(F.lit("relationship"), F.concat_ws("/", "chunk", i.cast("string"))).alias("node"), r["type"].alias("type"), end(r["source"]).alias("a"), end(r["target"]).alias("b"), r["description_node"].cast(about).alias("d")))

    ends = let(F.reverse("es"), lambda es: let(F.transform(es, lambda e: e["node"]), lambda nodes: let(F.transform(es, lambda e: e["name"]), lambda names: relations(nodes, names))))
    named = F.filter(ends, lambda r: r["a"].isNotNull() & r["b"].isNotNull())
    df = df.withColumn("rs", named)
    told = lambda xs: F.filter(xs, lambda x: F.coalesce(x["d"]["text"] != "", F.lit(False)))
    text_of = lambda x: make_id(F.lit("description"), x["node"])
    description = lambda x, i: _node(text_of(x), "Description", i, type=x["d"]["type"], text=x["d"]["text"], embedding=x["d"]["embedding"])
    nodes = F.concat(
        "head", F.transform("es", lambda e, i: _node(e["node"], "Entity", i, name=e["name"], type=e["type"])), F.transform("rs", lambda r, i: _node(r["node"], "Relationship", i, type=r["type"])),
        F.transform(told("es"), description), F.transform(told("rs"), description),
    )
    edges = F.concat(
        F.array(_edge(F.col("doc"), F.col("chunk"), "CONTAINS")), F.transform("es", lambda e: _edge(F.col("chunk"), e["node"], "MENTIONS")),
        F.transform(told("es"), lambda x: _edge(x["node"], text_of(x), "DESCRIBES")), F.transform(told("rs"), lambda x: _edge(x["node"], text_of(x), "DESCRIBES")),
        F.transform("rs", lambda r: _edge(r["a"], r["node"], "RELATED")), F.transform("rs", lambda r: _edge(r["b"], r["node"], "RELATED")),
    )
    store = Store(df.sparkSession, "text_graph")
    return _collected(store.save(df.select("chunk", nodes.alias("all_nodes"), edges.alias("all_edges")), "chunks"), store)


def table_graph(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``graphs(document, chunk_id, text, nodes, edges[, chunk_summary, chunk_embedding, metadata])``, extracted from tables.

    Table and Item nodes keep their label; all others are entities, merged in the
    document by name and type. Each keeps its properties and gets a description, its own with its vector or one made from its
    properties. CONTAINS leads from tables to items and MENTIONS from items to
    entities, whichever way they were extracted; any other edge becomes a
    relationship node between SOURCE and TARGET. A chunk contains its tables, and
    mentions the entities that no item does. Edges of one source, target and type
    count once; of nodes that share an original id the last counts.
    """
    have = _fields(graphs, "nodes")
    none = F.create_map().cast("map<string,string>")
    df = _ids(graphs)

    def thing(n: Column, i: Column) -> Column:
        label = F.when(n["type"].isin("Table", "Item"), n["type"]).otherwise("Entity")
        name = F.coalesce(_member(n, have, "name", "string"), n["id"])
        key = F.when(label == "Entity", F.concat_ws("/", "document", name, n["type"])).otherwise(F.concat_ws("/", "chunk", i.cast("string")))
        properties = F.coalesce(_member(n, have, "properties", "map<string,string>"), none)
        made = describe(F.when(label == "Entity", n["type"]).otherwise(label), name, properties)
        text = F.coalesce(F.nullif(_member(n, have, "text", "string"), F.lit("")), made)
        return F.struct(n["id"].alias("original"), name.alias("name"), n["type"].alias("type"), label.alias("label"), make_id(label, key).alias("node"), properties.alias("properties"), text.alias("text"), _member(n, have, "embedding", "array<double>").alias("embedding"))

    df = df.withColumn("ns", F.transform("nodes", thing))
    ids = F.transform(F.reverse("ns"), lambda n: F.struct(n["original"].alias("original"), n["node"].alias("node"), n["label"].alias("label")))
    once = F.array_distinct(F.transform("edges", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["type"].alias("type"))))

    def met(nodes: Column, originals: Column) -> Column:
        """Each edge with id and label of its ends, null where the chunk lacks one; of nodes that share an original id the first here counts."""
        at = lambda original: F.get(nodes, F.coalesce(F.array_position(originals, original), F.lit(0)).cast("int") - 1)
        end = lambda x, c, name: F.when(F.array_contains(originals, x[c]), F.struct(at(x[c])["node"].alias("node"), at(x[c])["label"].alias("label"))).alias(name)
        return F.transform(once, lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), x["type"].alias("type"), end(x, "source", "a"), end(x, "target", "b")))

    ends = let(ids, lambda nodes: let(F.transform(nodes, lambda n: n["original"]), lambda originals: met(nodes, originals)))
    df = df.withColumn("xs", F.filter(ends, lambda x: x["a"].isNotNull() & x["b"].isNotNull()))
    labels = lambda x, kind, a, b: (x["type"] == kind) & (x["a"]["label"] == a) & (x["b"]["label"] == b)
    holds = F.filter("xs", lambda x: labels(x, "CONTAINS", "Table", "Item"))
    forth, back = F.filter("xs", lambda x: labels(x, "MENTIONS", "Item", "Entity")), F.filter("xs", lambda x: labels(x, "MENTIONS", "Entity", "Item"))
    df = df.withColumn("ms", F.array_distinct(F.concat(F.transform(forth, lambda x: _edge(x["a"]["node"], x["b"]["node"], "MENTIONS")), F.transform(back, lambda x: _edge(x["b"]["node"], x["a"]["node"], "MENTIONS")))))
    others = F.filter("xs", lambda x: ~(labels(x, "CONTAINS", "Table", "Item") | labels(x, "MENTIONS", "Item", "Entity") | labels(x, "MENTIONS", "Entity", "Item")))

    def relation(x: Column) -> Column:
        about = F.create_map(F.lit("relationship_type"), x["type"], F.lit("source"), x["source"], F.lit("target"), x["target"])
        key = F.concat_ws("/", "chunk", x["source"], x["target"], x["type"])
        return F.struct(make_id(F.lit("relationship"), key).alias("node"), x["type"].alias("type"), x["a"]["node"].alias("a"), x["b"]["node"].alias("b"), describe(F.lit("Relationship"), x["type"], about).alias("text"), F.lit(None).cast("array<double>").alias("embedding"))

    holds = F.transform(holds, lambda x: F.struct(x["a"]["node"].alias("a"), x["b"]["node"].alias("b")))
    store, head = Store(df.sparkSession, "table_graph"), [c for c in ("document", "text", "chunk_summary", "chunk_embedding", "metadata") if c in df.columns]
    # Written before nodes and edges repeat the ids.
    df = store.save(df.select("doc", "chunk", *head, "ns", "ms", holds.alias("hs"), F.transform(others, relation).alias("rs")), "chunks")
    df = df.withColumn("head", _head(df, "text", "chunk_summary", "chunk_embedding"))
    text_of = lambda x: make_id(F.lit("description"), x["node"])
    merged = lambda n: n["label"] == "Entity"
    description = lambda x, i, shared=None: _node(text_of(x), "Description", i, shared, text=x["text"], embedding=x["embedding"])
    nodes = F.concat(
        "head", F.transform("ns", lambda n, i: _node(n["node"], n["label"], i, merged(n), name=n["name"], type=n["type"], properties=n["properties"])),
        F.transform("rs", lambda r, i: _node(r["node"], "Relationship", i, type=r["type"])), F.transform("ns", lambda n, i: description(n, i, merged(n))), F.transform("rs", lambda r, i: description(r, i)),
    )
    free = F.array_except(F.transform(F.filter("ns", lambda n: n["label"] == "Entity"), lambda n: n["node"]), F.transform("ms", lambda m: m["dst"]))
    edges = F.concat(
        F.array(_edge(F.col("doc"), F.col("chunk"), "CONTAINS")), F.transform(F.filter("ns", lambda n: n["label"] == "Table"), lambda n: _edge(F.col("chunk"), n["node"], "CONTAINS")),
        F.transform("hs", lambda x: _edge(x["a"], x["b"], "CONTAINS")), "ms", F.transform(free, lambda n: _edge(F.col("chunk"), n, "MENTIONS")),
        F.transform("ns", lambda n: _edge(n["node"], text_of(n), "DESCRIBE", merged(n))), F.transform("rs", lambda r: _edge(r["node"], text_of(r), "DESCRIBE")),
        F.transform("rs", lambda r: _edge(r["a"], r["node"], "SOURCE")), F.transform("rs", lambda r: _edge(r["node"], r["b"], "TARGET")),
    )
    return _collected(df.select("chunk", nodes.alias("all_nodes"), edges.alias("all_edges")), store)


def build_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, name, n`` of the nodes of each label and the edges of each type."""
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")))


def chunk_results(extractions: DataFrame) -> DataFrame:
    """One row over ``extractions(chunk_id, error)``: chunks, those without an error, and whether all are."""
    good = F.col("error").isNull()
    return extractions.agg(F.count("*").alias("chunks"), F.count_if(good).alias("successful"), F.coalesce(F.bool_and(good), F.lit(True)).alias("all_succeeded"))
