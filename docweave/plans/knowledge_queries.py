"""Queries over node creation, built graphs row by row, scoped search, question answering and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.operators import build, carry, create
from docweave.operators import chunking as c
from docweave.operators import extraction as x
from docweave.operators import graph as g
from docweave.operators import layout as y
from docweave.operators import models as m
from docweave.operators import retrieval as r
from docweave.operators import vectors as v
from docweave.plans.source_queries import orders_as_tables, written_in
from docweave.plans.tables import SUPPLY_SQL, TREE_SQL, read, supply, tree
from docweave.plans.text_queries import _markdown

QUERIES: dict = {}
SQL: dict[str, str] = {}
ASKED = 0
_STAMP = "2024-01-01T00:00:00.000000"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _listed(nodes):
    """Nodes with labels and properties as text."""
    pairs = F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return nodes.select("id", F.array_join("labels", ":").alias("labels"), F.array_join(pairs, "; ").alias("properties"), F.coalesce(F.size("embedding"), F.lit(-1)).alias("dimension"))


def _props(*pairs: str) -> str:
    """SQL for sorted ``key=value`` pairs without those that are null."""
    return "array_to_string(list_sort(list_filter([" + ", ".join(pairs) + "], lambda x: x IS NOT NULL)), '; ')"


_AT = f"'created_at={_STAMP}'"


@query(f"""SELECT 'p' || p_partkey AS id, 'Entity' || CASE WHEN p_size % 2 = 0 THEN ':Even' ELSE '' END AS labels, {_props(_AT, "'id=p' || p_partkey", "'name=' || p_name", "'type=' || p_brand", "'size=' || p_size")} AS properties, -1 AS dimension FROM part
UNION ALL SELECT 'n' || n_nationkey, 'Document', {_props(_AT, "'id=n' || n_nationkey", "'file_name=' || n_name", "'type=' || CASE WHEN n_regionkey > 2 THEN 'docx' ELSE 'unknown' END")}, -1 FROM nation
UNION ALL SELECT 'o' || s_suppkey, 'Item', {_props(_AT, "'id=o' || s_suppkey", "'name=other'", "'size=' || s_nationkey", "'balance=' || s_suppkey")}, -1 FROM supplier
UNION ALL SELECT 't' || r_regionkey, 'Table', {_props(_AT, "'id=t' || r_regionkey", "'name=' || r_name", "'columns=a, b'", "'column_count=2'")}, -1 FROM region
UNION ALL SELECT 'x' || r_regionkey, 'Relationship', {_props(_AT, "'id=x' || r_regionkey", "'type=' || r_name")}, -1 FROM region
UNION ALL SELECT 'd' || r_regionkey, 'Description', {_props(_AT, "'id=d' || r_regionkey", "'text=' || r_name", "'kind=k'")}, 3 FROM region
UNION ALL SELECT 'c' || conv_id || '/' || turn, 'Chunk', {_props(_AT, "'id=c' || conv_id || '/' || turn", "'text=' || CASE WHEN turn % 2 = 0 THEN role ELSE text END", "'summary=' || role", "'chunk_number=' || turn")}, 3 FROM conversations""")
def create_nodes(spark, sf_dir):
    """Nodes of all seven kinds; which of several values of one key stays depends on the kind."""
    at, unit = F.lit(_STAMP), F.array(*[F.lit(1.0)] * 3)
    part, nation, supplier, region = (read(spark, sf_dir, x) for x in ("part", "nation", "supplier", "region"))
    entity = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Even"))).alias("labels"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.lit("loses")).alias("properties"))
    document = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("file_name"), F.when(F.col("n_regionkey") > 2, "docx").alias("type"))
    item = supplier.select(F.concat(F.lit("o"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.create_map(F.lit("size"), F.col("s_nationkey").cast("string"), F.lit("balance"), F.lit("loses")).alias("item_properties"), F.create_map(F.lit("balance"), F.col("s_suppkey").cast("string"), F.lit("name"), F.lit("other")).alias("additional_properties"))
    table = region.select(F.concat(F.lit("t"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("columns"), F.create_map(F.lit("column_count"), F.lit("9")).alias("properties"))
    relation = region.select(F.concat(F.lit("x"), "r_regionkey").alias("id"), F.col("r_name").alias("type"))
    description = region.select(F.concat(F.lit("d"), "r_regionkey").alias("id"), F.col("r_name").alias("text"), unit.alias("embeddings"), F.create_map(F.lit("kind"), F.lit("k")).alias("properties"))
    chunk = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text", F.col("role").alias("summary"), F.col("turn").alias("chunk_number"), unit.alias("embedding"), F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("text"), F.col("role"))).alias("metadata"))
    made = [create.entity_batch(entity.groupBy("type").agg(F.collect_list(F.struct("id", "name", "type", "labels", "properties")).alias("entities")), at), create.documents(document, at), create.items(item, at), create.tables(table, at), create.relationships(relation, at), create.descriptions(description, at), create.chunks(chunk, at)]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return _listed(out)


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand = (SELECT max(p_brand) FROM part) AND p_name = (SELECT max(p_name) FROM part WHERE p_brand = (SELECT max(p_brand) FROM part))")
def find_by_name_and_type(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    kind, name = part.agg(F.max(F.struct("p_brand", "p_name")).alias("x")).first()["x"]
    return g.find_by_name_and_type(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type")), name, kind).select("id", "name")


@query(f"WITH {TREE_SQL} SELECT name FROM nodes WHERE id = 'r2' AND label = 'Document'")
def doc_name_by_id(spark, sf_dir):
    """A document's name from its id."""
    return tree(spark, sf_dir)[0].where("id = 'r2' and label = 'Document'").select("name").limit(1)


@query("SELECT p_partkey AS id FROM part ORDER BY md5(p_partkey || ':7'), p_partkey LIMIT 20")
def sample_by_hash(spark, sf_dir):
    """A sample that is the same in every run."""
    return create.sample(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "id", 20, 7)


@query(f"WITH {TREE_SQL} SELECT type, count(*) AS n FROM nodes WHERE label IN ('Entity', 'Item') AND type <> 'F' GROUP BY type")
def type_exclusion(spark, sf_dir):
    """Counts by type without one type."""
    return tree(spark, sf_dir)[0].where("label in ('Entity', 'Item')").where(F.col("type") != "F").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, quality FROM labels WHERE NOT coalesce(quality = 1, false)")
def unanswerable_filter(spark, sf_dir):
    return read(spark, sf_dir, "labels").where(~F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id", "quality")


def _reach(seeds: str, hops: int) -> str:
    return f"""links AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
walk AS (SELECT id AS seed, id AS node, 0 AS hops FROM nodes WHERE {seeds} UNION SELECT w.seed, l.b, w.hops + 1 FROM walk w JOIN links l ON l.a = w.node WHERE w.hops < {hops})"""


@query(f"WITH RECURSIVE {TREE_SQL}, {_reach('id = ' + chr(39) + 'r1' + chr(39), 10)} SELECT DISTINCT n.id AS chunk FROM walk w JOIN nodes n ON n.id = w.node WHERE n.label = 'Chunk'")
def document_chunks_10(spark, sf_dir):
    """All chunks within ten undirected hops of a document."""
    nodes, edges = tree(spark, sf_dir)
    seed = nodes.where("id = 'r1'").select(F.col("id").alias("seed"))
    chunks = nodes.where("label = 'Chunk'").select(F.col("id").alias("node"))
    return g.reachable(edges, seed, 10).join(chunks, "node", "left_semi").select(F.col("node").alias("chunk")).distinct()


def _document_nodes(spark, sf_dir):
    """The tree with texts of different lengths: chunks are nations, their summaries the names."""
    nodes, edges = tree(spark, sf_dir)
    number = F.substring("id", F.lit(2), F.lit(9)).cast("int")
    rich = nodes.withColumns({"chunk_number": number, "text": F.repeat(F.concat("name", F.lit(" ")), (number % 7 + 3).cast("int")), "summary": F.when(number % 4 != 0, F.col("name"))})
    return rich, edges


@query(f"""WITH RECURSIVE {TREE_SQL}, {_reach('id = ' + chr(39) + 'r1' + chr(39), 10)},
c AS (SELECT id, CAST(substr(id, 2) AS INT) AS k, repeat(name || ' ', CAST(substr(id, 2) AS INT) % 7 + 3) AS text, CASE WHEN CAST(substr(id, 2) AS INT) % 4 <> 0 THEN name ELSE '' END AS summary FROM nodes WHERE label = 'Chunk' AND id IN (SELECT node FROM walk WHERE hops > 0)),
o AS (SELECT *, length(text) // 4 AS tt, length(summary) // 4 AS st, summary <> '' AND length(text) // 4 > 0 AS can, sum(length(text) // 4) OVER () AS total FROM c),
l AS (SELECT *, total - coalesce(sum(tt - st) OVER (PARTITION BY can ORDER BY tt DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM o),
u AS (SELECT *, can AND min(l) OVER (PARTITION BY can ORDER BY tt DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 40 AS use FROM l)
SELECT string_agg('--- Chunk ' || k || ' (' || CASE WHEN use THEN 'summary' ELSE 'full_text' END || ') ---' || chr(10) || CASE WHEN use THEN summary ELSE text END, chr(10) || chr(10) ORDER BY k) AS context,
count(*) AS total_chunks, count(*) AS selected_chunks, bool_or(use) AS used_summaries, CAST(sum(CASE WHEN use THEN st ELSE tt END) AS BIGINT) AS total_tokens FROM u""")
def document_context_10(spark, sf_dir):
    """The context of a whole document within a budget of tokens."""
    return r.context_of_document(*_document_nodes(spark, sf_dir), "r1", 40)


@query(f"""WITH RECURSIVE {TREE_SQL}, {_reach("label = 'Chunk'", 6)} SELECT DISTINCT w.node AS target, w.seed AS chunk, min(w.hops) AS hops FROM walk w WHERE w.node IN ('c1', 'c2', 'c3', 'c4', 'c5', 'o1') GROUP BY ALL""")
def chunks_within_6(spark, sf_dir):
    """The chunks within six undirected hops of some descriptions, all in one search."""
    nodes, edges = tree(spark, sf_dir)
    return r.chunks_of(edges, nodes, nodes.where(F.col("id").isin("c1", "c2", "c3", "c4", "c5", "o1")), 6)


_TEXT_ROWS = "t AS (SELECT source || '' AS document, 'document_' || left(sha256(source), 32) AS doc, 'chunk_' || left(sha256(source || '/' || doc_id), 32) AS chunk, doc_id, text, lang, source FROM documents)"


def _id_sql(kind: str, key: str) -> str:
    return f"'{kind}_' || left(sha256({key}), 32)"


_E0, _E1, _R0 = _id_sql("entity", "chunk || '/0'"), _id_sql("entity", "chunk || '/1'"), _id_sql("relationship", "chunk || '/0'")


@query(f"""WITH {_TEXT_ROWS} SELECT DISTINCT doc AS src, chunk AS dst, 'CONTAINS' AS type FROM t UNION ALL SELECT chunk, {_E0}, 'MENTIONS' FROM t UNION ALL SELECT chunk, {_E1}, 'MENTIONS' FROM t
UNION ALL SELECT {_E0}, {_id_sql("description", _E0)}, 'DESCRIBES' FROM t UNION ALL SELECT {_E0}, {_R0}, 'RELATED' FROM t WHERE lang <> 'es' UNION ALL SELECT {_E1}, {_R0}, 'RELATED' FROM t WHERE lang <> 'es'""")
def text_graph_edges(spark, sf_dir):
    """Every edge of the graph of all documents."""
    return build.text_graph(written_in(spark, sf_dir))[1]


@query(f"""WITH {_TEXT_ROWS} SELECT DISTINCT doc AS id, 'Document' AS label, source AS name, NULL AS type, NULL AS text FROM t UNION ALL SELECT chunk, 'Chunk', NULL, NULL, text FROM t
UNION ALL SELECT {_E0}, 'Entity', lang, 'Language', NULL FROM t UNION ALL SELECT {_E1}, 'Entity', source, 'Source', NULL FROM t
UNION ALL SELECT {_R0}, 'Relationship', NULL, 'WRITTEN_IN', NULL FROM t WHERE lang <> 'es' UNION ALL SELECT {_id_sql("description", _E0)}, 'Description', NULL, 'Description', 'written in ' || lang FROM t""")
def text_graph_nodes(spark, sf_dir):
    return build.text_graph(written_in(spark, sf_dir))[0].select("id", "label", "name", "type", "text")


_TABLE_ROWS = f"""o AS (SELECT o_orderpriority AS document, CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderstatus AS s FROM orders),
i AS (SELECT *, {_id_sql("document", "document")} AS doc, {_id_sql("chunk", "document || '/' || k")} AS chunk FROM o),
n AS (SELECT *, {_id_sql("table", "chunk || '/0'")} AS t, {_id_sql("item", "chunk || '/1'")} AS i, {_id_sql("entity", "document || '/' || c || '/Customer'")} AS cust, {_id_sql("entity", "document || '/' || s || '/State'")} AS state, {_id_sql("relationship", "chunk || '/c/s/HAS_STATE'")} AS rel FROM i)"""


@query(f"""WITH {_TABLE_ROWS}, d AS (SELECT unnest([t, i, cust, state, rel]) AS x FROM n), e AS (SELECT doc AS src, chunk AS dst, 'CONTAINS' AS type FROM n UNION ALL SELECT chunk, t, 'CONTAINS' FROM n UNION ALL SELECT t, i, 'CONTAINS' FROM n
UNION ALL SELECT i, cust, 'MENTIONS' FROM n UNION ALL SELECT chunk, state, 'MENTIONS' FROM n UNION ALL SELECT x, {_id_sql("description", "x")}, 'DESCRIBE' FROM d UNION ALL SELECT cust, rel, 'SOURCE' FROM n UNION ALL SELECT rel, state, 'TARGET' FROM n) SELECT DISTINCT * FROM e""")
def table_graph_edges(spark, sf_dir):
    """Every edge of the graph of all orders as table records."""
    return build.table_graph(orders_as_tables(spark, sf_dir))[1]


@query(f"""WITH {_TABLE_ROWS}, x AS (SELECT doc AS id, 'Document' AS label, document AS name, NULL AS type, NULL AS text FROM n UNION ALL SELECT chunk, 'Chunk', NULL, NULL, '' FROM n UNION ALL SELECT t, 'Table', 'orders', 'Table', NULL FROM n
UNION ALL SELECT i, 'Item', k, 'Item', NULL FROM n UNION ALL SELECT cust, 'Entity', c, 'Customer', NULL FROM n UNION ALL SELECT state, 'Entity', s, 'State', NULL FROM n UNION ALL SELECT rel, 'Relationship', NULL, 'HAS_STATE', NULL FROM n
UNION ALL SELECT {_id_sql("description", "t")}, 'Description', NULL, NULL, 'Table entity named ''orders''' FROM n UNION ALL SELECT {_id_sql("description", "i")}, 'Description', NULL, NULL, 'An item record named ''' || k || '''' FROM n
UNION ALL SELECT {_id_sql("description", "cust")}, 'Description', NULL, NULL, 'A Customer entity named ''' || c || '''' FROM n UNION ALL SELECT {_id_sql("description", "state")}, 'Description', NULL, NULL, 'A State entity named ''' || s || '''' FROM n
UNION ALL SELECT {_id_sql("description", "rel")}, 'Description', NULL, NULL, 'A HAS_STATE relationship connecting c to s' FROM n) SELECT DISTINCT * FROM x""")
def table_graph_nodes(spark, sf_dir):
    return build.table_graph(orders_as_tables(spark, sf_dir))[0].select("id", "label", "name", "type", "text")


_COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {ASKED}))"
_EMBEDDED = "embedded AS (SELECT 'n' || vec_id AS id, embedding FROM embeddings UNION ALL SELECT 'c' || vec_id, embedding FROM embeddings)"


def _embedded(spark, sf_dir, nodes):
    e = read(spark, sf_dir, "embeddings")
    both = e.select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("id"), "embedding").unionByName(e.select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("id"), "embedding"))
    return nodes.join(both, "id", "left")


@query(f"""WITH RECURSIVE {TREE_SQL}, {_EMBEDDED}, below AS (SELECT dst AS id, 1 AS hops FROM edges WHERE src = 'r1' UNION SELECT e.dst, b.hops + 1 FROM below b JOIN edges e ON e.src = b.id WHERE b.hops < 3),
p AS (SELECT n.id, {_COSINE} AS s, CASE label WHEN 'Chunk' THEN 0.05 ELSE 0.0 END AS t, CASE WHEN contains(lower(n.name), 'na') THEN 0.3 ELSE 0.0 END AS k FROM nodes n JOIN embedded USING (id) WHERE n.id IN (SELECT id FROM below)),
c AS (SELECT id, s, s * 0.6 + k * 0.3 + t - 0.1 AS combined FROM p) SELECT id, round(s, 9) AS semantic_score, round(combined, 9) AS combined_score FROM c WHERE combined >= -1 ORDER BY combined DESC, id LIMIT 10""")
def hybrid_scoped(spark, sf_dir):
    """Hybrid search below one document: the scope comes first, only what is in it is compared."""
    nodes, edges = tree(spark, sf_dir)
    query_vector = read(spark, sf_dir, "embeddings").where(F.col("vec_id") == ASKED).first()["embedding"]
    inside = v.scoped(_embedded(spark, sf_dir, nodes), edges, "r1").withColumns({"text": F.lit(None).cast("string"), "summary": F.lit(None).cast("string"), "description": F.lit(None).cast("string")})
    found = v.hybrid_topk(inside, query_vector, ["na"], 10, -1.0)
    return found.select("id", F.round("semantic_score", 9).alias("semantic_score"), F.round("combined_score", 9).alias("combined_score"))


@query("""WITH h AS (SELECT vec_id AS node, CASE WHEN label < 4 THEN 'Chunk' WHEN label < 8 THEN 'Entity' ELSE 'Feature' END AS label, vec_id % 100 / 100 AS s, vec_id % 90 AS combined FROM embeddings),
rel AS (SELECT DISTINCT node, parent FROM (SELECT vec_id AS node, (vec_id + k) % 200 AS parent, k FROM embeddings, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE k <> 3 UNION ALL SELECT (vec_id + k) % 200, vec_id, k FROM embeddings, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE k <> 3) WHERE parent < 120),
near AS (SELECT node, parent FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY parent) AS n FROM rel) WHERE n <= 3),
l AS (SELECT node, CAST(combined AS DOUBLE) AS score, NULL::BIGINT AS inherited_from FROM h WHERE label = 'Chunk' UNION ALL SELECT node // 10, combined * 0.9, node FROM h WHERE label = 'Entity' UNION ALL SELECT n.parent, combined * 0.8, h.node FROM h JOIN near n USING (node) WHERE label = 'Feature'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, inherited_from NULLS FIRST) AS n FROM l) WHERE n = 1 ORDER BY score DESC, node LIMIT 25)
SELECT b.node, inherited_from, round(s * CASE WHEN inherited_from IS NULL THEN 1 WHEN label = 'Entity' THEN 0.9 ELSE 0.8 END, 9) AS semantic_score, CAST(0.05 AS DOUBLE) AS type_bonus, round(score, 9) AS combined_score FROM b JOIN h ON h.node = coalesce(inherited_from, b.node)""")
def lift_scored(spark, sf_dir):
    """Hits moved to chunks with their parts rescored; related chunks come by edges of four types only."""
    e = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("label") < 4, "Chunk").when(F.col("label") < 8, "Entity").otherwise("Feature")
    hits = e.select(F.col("vec_id").alias("node"), label.alias("label"), (F.col("vec_id") % 100 / 100).alias("semantic_score"), F.lit(0.0).alias("keyword_score"), F.lit(0.0).alias("content_bonus"), (F.col("vec_id") % 90).cast("double").alias("combined_score"))
    kinds = F.array(*map(F.lit, ("NEXT", "PREVIOUS", "MENTIONS", "SIMILAR_TO", "RELATED_TO")))
    edges = e.select(F.col("vec_id").alias("src"), F.posexplode(kinds).alias("k", "type")).select("src", ((F.col("src") + F.col("k") + 1) % 200).alias("dst"), "type")
    chunks = e.select(F.col("vec_id").alias("id")).where("id < 120")
    found = r.lift_scored(hits, e.select(F.col("vec_id").alias("node"), F.floor(F.col("vec_id") / 10).alias("parent")), r.related_chunks(edges, chunks), 25)
    return found.select("node", "inherited_from", F.round("semantic_score", 9).alias("semantic_score"), "type_bonus", F.round("combined_score", 9).alias("combined_score"))


_WORDS = r"list_filter(regexp_extract_all(lower({}), '[^\t\n\x0B\f\r ]+'), lambda w: length(w) > 3)"
_FOUND = rf"list_filter(string_split(regexp_replace(context, '([.!?])[\t\n\x0B\f\r ]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: len(list_intersect(regexp_extract_all(lower(s), '[^\t\n\x0B\f\r ]+'), {_WORDS.format('question')})) > 0)[1]"
_STRIPPED = r"regexp_replace({}, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')"


@query(f"""WITH c AS (SELECT item_id, b.text AS question, d.text AS context FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id), f AS (SELECT *, {_FOUND} AS found FROM c)
SELECT item_id, coalesce({_STRIPPED.format('found')}, '') AS answer, found IS NOT NULL AS answerable, coalesce({_STRIPPED.format('found')}, '') AS related_context FROM f""")
def extractive_replies(spark, sf_dir):
    """The first sentence of a document that shares a longer word with the benchmark text of the same number."""
    asked = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    rows = asked.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context")), "item_id", "left")
    return rows.select("item_id", F.inline(F.array(m.extractive_answer(F.col("question"), F.col("context"))))).drop("confidence")


@query("SELECT vec_id AS question_index FROM embeddings WHERE label = 3 AND vec_id % 3 <> 0")
def questions_lacking_vectors(spark, sf_dir):
    """Questions whose vector of one language is absent or empty."""
    return r.without_vector(_questions(spark, sf_dir), "en_embedding").select("question_index")


def _questions(spark, sf_dir):
    """The vectors of one label as questions; two of three come without a vector, of which one is empty."""
    vectors = read(spark, sf_dir, "embeddings").where("label = 3").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    known = F.when(F.col("vec_id") % 3 == 0, F.create_map(F.lit("en_embedding"), F.col("embedding"))).when(F.col("vec_id") % 3 == 1, F.create_map(F.lit("en_embedding"), F.array().cast("array<double>"))).otherwise(F.create_map(F.lit("de_embedding"), F.col("embedding")))
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 60).alias("question"))
    return vectors.join(texts, "vec_id", "left").select(F.col("vec_id").alias("question_index"), F.coalesce("question", F.lit("")).alias("question"), known.alias("embeddings"))


_FIXED = "[CAST(i AS DOUBLE) FOR i IN range(64)]"


@query(f"""WITH q AS (SELECT e.vec_id, left(coalesce(d.text, ''), 60) AS question, CASE WHEN e.vec_id % 3 = 0 THEN CAST(embedding AS DOUBLE[]) ELSE {_FIXED} END AS x FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE label = 3),
n AS (SELECT e.vec_id AS id, d.text, CAST(embedding AS DOUBLE[]) AS y, 0.05 + CASE WHEN length(coalesce(d.text, '')) < 50 THEN -0.1 WHEN length(coalesce(d.text, '')) > 500 THEN 0.05 ELSE 0.0 END AS b FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
s AS (SELECT vec_id AS question_index, question, id, coalesce(text, '') AS text, list_cosine_similarity(x, y) * 0.6 + b AS s FROM q, n), k AS (SELECT *, row_number() OVER (PARTITION BY question_index ORDER BY s DESC, id) AS rank FROM s WHERE s >= 0.1),
c AS (SELECT question_index, '=== CONTEXT INFORMATION ===' || chr(10) || string_agg('Content: ' || text, chr(10) ORDER BY rank) AS context FROM k WHERE rank <= 5 GROUP BY 1),
a AS (SELECT q.vec_id AS question_index, question, coalesce(context, '') AS context FROM q LEFT JOIN c ON c.question_index = q.vec_id), f AS (SELECT *, {_FOUND} AS found FROM a)
SELECT question_index, md5(context) AS context, coalesce({_STRIPPED.format('found')}, '') AS answer, found IS NOT NULL AS answerable FROM f""")
def ask_all(spark, sf_dir):
    """All questions answered in one pass; those without a vector get one first."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    nodes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(docs, "id", "left").withColumn("label", F.lit("Chunk"))
    fixed = lambda question: F.array(*[F.lit(float(k)) for k in range(64)])
    return r.ask_all(_questions(spark, sf_dir), nodes, "en_embedding", fixed, 5).select("question_index", F.md5("context").alias("context"), "answer", "answerable")


_PROFILE = f"""WITH RECURSIVE {TREE_SQL}, {_EMBEDDED}, links AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
far AS (SELECT 'r1' AS node, 0 AS hops UNION SELECT l.b, f.hops + 1 FROM far f JOIN links l ON l.a = f.node WHERE f.hops < 9),
near AS (SELECT n.id AS seed, n.id AS node, 0 AS hops FROM nodes n WHERE label = 'Chunk' UNION SELECT w.seed, l.b, w.hops + 1 FROM near w JOIN links l ON l.a = w.node WHERE w.hops < 6),
v AS (SELECT n.id AS hit, n.label, CAST(embedding AS DOUBLE[]) AS x FROM nodes n JOIN embedded USING (id) WHERE n.id IN (SELECT node FROM far) AND label IN ('Chunk', 'Entity')),
q AS (SELECT vec_id AS question, CAST(embedding AS DOUBLE[]) AS y FROM embeddings WHERE vec_id < 5), s AS (SELECT question, hit, label, list_cosine_similarity(x, y) AS score FROM v, q),
t AS (SELECT DISTINCT node AS hit, seed AS chunk FROM near), r AS (SELECT question, hit, score, hit AS chunk FROM s WHERE label = 'Chunk' UNION ALL SELECT question, s.hit, score, chunk FROM s JOIN t USING (hit) WHERE label = 'Entity'),
d AS (SELECT *, dense_rank() OVER (PARTITION BY question ORDER BY score DESC, hit) AS h FROM r), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, chunk ORDER BY h) AS n FROM d) WHERE n = 1),
b AS (SELECT question, h, coalesce(sum(count(*)) OVER (PARTITION BY question ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f GROUP BY 1, 2), z AS (SELECT f.* FROM f JOIN b USING (question, h) WHERE before < 5)"""


def _profile_nodes(spark, sf_dir):
    nodes, edges = tree(spark, sf_dir)
    rich = nodes.withColumn("label", F.when(F.col("label") == "Entity", "Description").otherwise(F.col("label")))
    return _embedded(spark, sf_dir, rich).withColumns({"embeddings": F.lit(None).cast("array<float>"), "summary": F.col("name")}), edges


@query(f"{_PROFILE} SELECT question, hit, chunk, round(score, 9) AS score FROM z")
def profile_retrieval(spark, sf_dir):
    """The chunks that five profile questions find below a region: nine hops to vectors, six from descriptions to chunks."""
    nodes, edges = _profile_nodes(spark, sf_dir)
    asked = read(spark, sf_dir, "embeddings").where("vec_id < 5").select(F.col("vec_id").alias("question"), "embedding")
    return r.profile_hits(nodes, edges, "r1", asked, 5).select("question", "hit", "chunk", F.round("score", 9).alias("score"))


_LABELS = [(c, p, f"{name}-{c}", text) for c in range(5) for p, (name, text) in enumerate((("Alpha", "nation_1 nation_2"), ("Beta", "nation_6 nation_11"), ("Gamma", "nation_16 nation_21")))]


@query(f"""{_PROFILE}, l AS (SELECT * FROM (VALUES {", ".join(f"({c}, {p}, '{n}', '{x}')" for c, p, n, x in _LABELS)}) x(category, place, label, definition)),
c AS (SELECT question AS category, lower(string_agg(n.name, chr(10))) AS context, count(DISTINCT chunk) AS n_chunks FROM z JOIN nodes n ON n.id = z.chunk GROUP BY 1),
w AS (SELECT l.*, n_chunks, len(list_intersect(list_distinct({_WORDS.format("coalesce(context, '')")}), list_distinct({_WORDS.format("label || ' ' || definition")}))) AS score FROM l LEFT JOIN c USING (category))
SELECT category, CASE WHEN max(score) > 0 THEN arg_max(label, (score, -place)) ELSE 'Unknown' END AS label, coalesce(max(n_chunks), 0) AS n_chunks FROM w GROUP BY category""")
def profile_run(spark, sf_dir):
    """Label and chunks of five categories of a document, all in one pass."""
    nodes, edges = _profile_nodes(spark, sf_dir)
    views = read(spark, sf_dir, "embeddings").where("vec_id < 5").select(F.col("vec_id").alias("category"), "embedding")
    labels = spark.createDataFrame(_LABELS, "category long, place int, label string, definition string")
    return r.profile_run(nodes.withColumn("summary", F.lower("name")), edges, "r1", views, labels)


@query("""WITH old AS (SELECT p_brand AS category, p_type AS label, min(p_name) AS definition FROM part WHERE p_size < 25 GROUP BY 1, 2), new AS (SELECT p_brand AS category, p_type AS label, max(p_name) AS definition FROM part WHERE p_size > 20 AND trim(p_name) <> '' GROUP BY 1, 2),
both_ AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE (category, label) NOT IN (SELECT (category, label) FROM new)) SELECT category, label, definition FROM both_ WHERE EXISTS (SELECT 1 FROM part WHERE p_brand = category AND p_type = label AND p_size % 2 = 0)""")
def label_definitions(spark, sf_dir):
    """Definitions after an import, those of a category's own labels."""
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_type").alias("label"), F.col("p_name").alias("definition"), "p_size")
    old = part.where("p_size < 25").groupBy("category", "label").agg(F.min("definition").alias("definition"))
    whole = r.merge_definitions(old, part.where("p_size > 20").drop("p_size"))
    return r.definitions_for(whole, part.where("p_size % 2 = 0"))


@query("SELECT count(*) FILTER (WHERE coalesce(quality, 0) = 1) AS answerable, count(*) FILTER (WHERE toxic IS NOT NULL) AS successful, bool_and(toxic IS NOT NULL) AS all_succeeded, count(*) FILTER (WHERE lang <> 'es') AS labelled FROM documents LEFT JOIN labels USING (doc_id)")
def run_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return r.run_summary(rows.select((F.col("quality") == 1).alias("answerable"), F.when(F.col("toxic").isNull(), "none").alias("error"), F.when(F.col("lang") == "es", "Unknown").otherwise(F.col("lang")).alias("label")))


@query("SELECT source, count(*) AS chunks, count(*) FILTER (WHERE lang <> 'es') AS successful FROM documents WHERE source = 'src7' GROUP BY 1")
def chunk_results(spark, sf_dir):
    """How many chunks of a document were extracted."""
    rows = read(spark, sf_dir, "documents").where("source = 'src7'").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("lang") == "es", "failed").alias("error"))
    return build.chunk_results(rows).where("chunks > 0").select(F.lit("src7").alias("source"), "chunks", "successful")


@query("SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS total_tokens FROM documents GROUP BY 1")
def token_totals(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(t.token_count(F.col("text"))).alias("total_tokens"))


@query("""SELECT conv_id, turn, coalesce(right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 200), '') AS context_before,
coalesce(left(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 200), '') AS context_after FROM conversations WHERE length(text) > 0""")
def char_budget_both_sides(spark, sf_dir):
    """The 200 characters before and after each turn."""
    return r.budget_context(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 200)


@query("SELECT user_id, string_agg(event_id, ',' ORDER BY ts DESC, event_id DESC) AS newest_first FROM events GROUP BY 1")
def history_newest_first(spark, sf_dir):
    """Each user's whole history, the newest first."""
    items = F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False)
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(items, lambda x: x["event_id"].cast("string")), ",").alias("newest_first"))


@query("""WITH i AS (SELECT item_id, text, CAST(item_id % 9 + 1 AS INT) AS r, CAST(item_id * 37 % 16000 + 1 AS INT) AS c FROM benchmark) SELECT item_id, r AS row_, c AS col, 'Q: ' || left(text, 20) || ' in B' || (item_id % 9 + 1) AS prompt FROM i""")
def addresses_and_templates(spark, sf_dir):
    """A cell's address read back, and a filled template."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text", (F.col("item_id") % 9 + 1).cast("int").alias("r"), (F.col("item_id") * 37 % 16000 + 1).cast("int").alias("c"))
    back = rows.withColumn("at", t.row_and_column(t.cell_address(F.col("r"), F.col("c"))))
    prompt = t.fill("Q: {text} in B{row}", text=F.left("text", F.lit(20)), row=F.col("r"))
    return back.select("item_id", F.col("at.row").alias("row_"), F.col("at.column").alias("col"), prompt.alias("prompt"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, epoch_us(ts) AS micros, CASE WHEN event_id % 3 = 0 THEN 'k' WHEN event_id % 3 = 1 THEN '' END AS entity FROM events""")
def stamps_and_json(spark, sf_dir):
    """Times as ISO text and back; replies with and without JSON in them."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    reply = F.when(F.col("event_id") % 3 == 0, F.lit('so {"x": 1} and\n```json\n{"entities": [{"name": "k"}], "relationships": []}\n```')).when(F.col("event_id") % 3 == 1, '{"entities": [{"name": ""}], "relationships": []}').otherwise("no JSON {at all")
    found = t.parsed(t.json_block_with(reply, "entities", "relationships"), "entities ARRAY<STRUCT<name: STRING>>, relationships ARRAY<STRING>")
    iso = t.iso_stamp(F.col("ts"))
    return e.select("event_id", iso.alias("iso"), F.unix_micros(t.parse_iso(iso)).alias("micros"), F.get(found["entities"], 0)["name"].alias("entity"))


@query("""WITH c AS (SELECT d.doc_id, 'picture ' || d.doc_id AS description, lower(string_split(text, ' ')[4]) AS after FROM documents d WHERE doc_id % 2 = 0 AND len(string_split(text, ' ')) >= 4 AND trim(string_split(text, ' ')[4]) <> '' AND NOT regexp_matches(string_split(text, ' ')[4], '[\t\n\x0B\f\r]'))
SELECT d.doc_id, CASE WHEN after IS NULL THEN text ELSE left(text, instr(lower(text), after) - 1) || chr(10) || '[IMAGE_DESCRIPTION]: ' || description || chr(10) || substr(text, instr(lower(text), after)) END AS text FROM documents d LEFT JOIN c USING (doc_id)""")
def restored_captions(spark, sf_dir):
    """Captions that texts lost return to the words that came after their images."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    word = F.get(F.split("text", " ", -1), 3)
    lost = docs.where("doc_id % 2 = 0").where((F.trim(word) != "") & ~word.rlike(r"[\t\n\x0B\f\r]"))
    captions = lost.select("doc_id", F.lit(0).alias("image"), F.concat(F.lit("picture "), "doc_id").alias("description"), F.lit("").alias("context_before"), word.alias("context_after"))
    return y.restore_captions(docs, captions)


@query("""SELECT user_id AS path, event_id AS position, CASE event_type WHEN 'click' THEN 'cell' ELSE 'image' END AS kind, CASE WHEN b.text IS NULL THEN event_type WHEN event_type = 'click' THEN event_type || chr(10) || '[IMAGE] ' || b.text ELSE '[IMAGE_DESCRIPTION]:' || b.text END AS text
FROM events e LEFT JOIN benchmark b ON b.item_id = e.event_id % 90 WHERE event_type IN ('click', 'view')""")
def captioned_blocks(spark, sf_dir):
    """Images in documents replaced by their captions, and cells with those of their images."""
    e = read(spark, sf_dir, "events").where("event_type in ('click', 'view')").select(F.col("user_id").alias("path"), F.col("event_id").alias("position"), F.when(F.col("event_type") == "click", "cell").otherwise("image").alias("kind"), F.col("event_type").alias("text"), (F.col("event_id") % 90).alias("image"))
    known = e.select("path", "image").distinct().join(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image"), F.col("text").alias("description")), "image")
    return y.captioned_blocks(e, known)


@query("""WITH b AS (SELECT user_id AS page, event_id AS seq, event_type, value AS y FROM events), k AS (SELECT page, y, seq, 'text' AS kind, event_type AS content FROM b WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.event_type = 'purchase' AND t.page = b.page AND b.y >= t.y - 10 AND b.y + 5 <= t.y + 30)
UNION ALL SELECT page, y, seq, 'image', 'click' FROM b WHERE event_type = 'click' UNION ALL SELECT page, y + 10, -1, 'table', '| a | ' || seq || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| x&#124;y |  |' FROM b WHERE event_type = 'purchase')
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y, seq, content) - 1 AS INT) AS place, kind, content FROM k""")
def layout_order(spark, sf_dir):
    """Texts outside tables, images and tables of scanned pages in reading order."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq"), "event_type", F.lit(0.0).alias("x0"), F.lit(10.0).alias("x1"), F.col("value").alias("y0"))
    elements = e.where("event_type in ('view', 'click')").select("page", "seq", "x0", "x1", "y0", (F.col("y0") + 5).alias("y1"), F.when(F.col("event_type") == "view", "text").otherwise("image").alias("kind"), F.col("event_type").alias("content"))
    rows = F.array(F.array(F.lit("a"), F.col("seq").cast("string")), F.array(F.lit(" "), F.lit(None)), F.array(F.lit("x|y"), F.lit(None)))
    tables = e.where("event_type = 'purchase'").select("page", "x0", "x1", "y0", F.lit(20.0).alias("height"), rows.alias("rows"))
    return y.layout_order(elements, tables)


@query(f"WITH {SUPPLY_SQL} SELECT b.dst AS seed, b.src AS node, n.name, b.type, count(*) AS n_edges FROM edges b JOIN nodes n ON n.id = b.src WHERE b.dst = 'p5' GROUP BY ALL")
def entity_rel_incoming(spark, sf_dir):
    """The suppliers of a part."""
    nodes, edges = supply(spark, sf_dir)
    found = g.neighbours(edges, spark.createDataFrame([("p5",)], "seed string"), "in")
    return found.join(nodes.select(F.col("id").alias("node"), "name"), "node").groupBy("seed", "node", "name", "type").agg(F.count("*").alias("n_edges"))


@query()
def extracted_entities(spark, sf_dir):
    """The entities that the rules find in every document."""
    found = read(spark, sf_dir, "documents").select("doc_id", F.inline(x.text_extraction(F.col("text"))["entities"]))
    return found.select("doc_id", "name", "type")


@query()
def extracted_graph(spark, sf_dir):
    """The graph of all conversations, from chunks to nodes."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document"), F.col("turn").alias("chunk_id"), F.col("text").alias("content"))
    return build.build_counts(*x.graph_of(rows))


@query()
def document_chunks(spark, sf_dir):
    """All pages as Markdown, cut at headings, merged under the limit and split beyond it."""
    return c.document_chunks(_markdown(spark, sf_dir), 120).select("chunk_id", "lenght", "metadata.H1", "metadata.H2", "metadata.position", "chunk_text")


@query("""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), m AS (SELECT doc_id, n, CASE WHEN n % 5 < 2 THEN '| ' || n || ' |' ELSE line END AS line FROM l),
f AS (SELECT *, regexp_matches(line, '^\\|.*\\|$') AS t FROM m), r AS (SELECT *, sum(CASE WHEN t <> p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM f))
SELECT doc_id, CAST(coalesce(run, 0) AS BIGINT) AS run, bool_or(t) AS is_table, CAST(min(n) AS INT) AS first_line, CAST(max(n) AS INT) AS last_line FROM r GROUP BY 1, 2""".replace("\\\\", "\\"))
def table_runs(spark, sf_dir):
    """Where tables begin and end: of each five lines the first two are made table rows."""
    text = F.array_join(F.transform(F.split("text", "\n", -1), lambda line, n: F.when(n % 5 < 2, F.concat(F.lit("| "), n.cast("string"), F.lit(" |"))).otherwise(line)), "\n")
    return c.table_runs(read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))).drop("content")


@query("""WITH c AS (SELECT conv_id, turn, turn % 3 < 2 AS t, role || ' | ' || turn AS r, CASE WHEN turn % 3 < 2 THEN '| ' || role || ' | ' || turn || ' |' ELSE text END AS content FROM conversations),
f AS (SELECT *, lag(t) OVER w AS after_table, CASE WHEN t AND NOT coalesce(lag(t) OVER w, false) THEN 1 ELSE 0 END AS opens FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f),
h AS (SELECT *, first_value(r) OVER (PARTITION BY conv_id, run ORDER BY turn) AS heads, list(r) FILTER (WHERE t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g),
l AS (SELECT *, lag(heads) OVER (PARTITION BY conv_id ORDER BY turn) AS told, coalesce(seen[-3:], []) AS last FROM h)
SELECT CAST(conv_id AS VARCHAR) AS sheet, turn AS n, content, 'Currently processing: ' || CASE WHEN after_table THEN 'TABLE' || chr(10) || 'Table headers: ' || told ELSE 'NON-TABLE content' END
|| CASE WHEN len(last) > 0 THEN chr(10) || 'Last 3 rows:' || chr(10) || array_to_string(['  Row ' || i || ': ' || last[i] FOR i IN range(1, len(last) + 1)], chr(10)) ELSE '' END AS context FROM l""")
def carried_contexts(spark, sf_dir):
    """What each turn of a conversation is told of the turns before it, two of three turns being rows of tables."""
    line = F.concat(F.lit("| "), "role", F.lit(" | "), F.col("turn").cast("string"), F.lit(" |"))
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sheet"), F.col("turn").alias("n"), F.when(F.col("turn") % 3 < 2, line).otherwise(F.col("text")).alias("chunk"))
    return carry.folded(rows)
