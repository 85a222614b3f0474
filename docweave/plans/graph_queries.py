"""Queries over the graph operators: patterns, expansion, mutations, lookups, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import graph as g
from docweave.plans.tables import SUPPLY_SQL, TREE_SQL, read, supply, tree

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "seed string")


@query(f"""WITH RECURSIVE {TREE_SQL}, walk AS (
  SELECT 'r1' AS seed, dst AS node, 1 AS hops FROM edges WHERE src = 'r1'
  UNION ALL SELECT w.seed, e.dst, w.hops + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.hops < 3)
SELECT w.seed, w.node, w.hops, n.label FROM walk w JOIN nodes n ON n.id = w.node""")
def contains_1_3(spark, sf_dir):
    """Everything one to three CONTAINS edges below a document."""
    nodes, edges = tree(spark, sf_dir)
    found = g.paths(edges.where("type = 'CONTAINS'"), _seeds(spark, "r1"), 1, 3)
    return found.join(nodes.select(F.col("id").alias("node"), "label"), "node").select("seed", "node", "hops", "label")


def _reach_sql(hops: int) -> str:
    return f"""WITH RECURSIVE {SUPPLY_SQL}, links AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges),
walk AS (SELECT 's1' AS node, 0 AS hops UNION SELECT l.b, w.hops + 1 FROM walk w JOIN links l ON l.a = w.node WHERE w.hops < {hops})
SELECT 's1' AS seed, node, min(hops) AS hops FROM walk GROUP BY node"""


@query(_reach_sql(9))
def khop_reach_9(spark, sf_dir):
    """All nodes within nine undirected hops of a supplier."""
    return g.reachable(supply(spark, sf_dir)[1], _seeds(spark, "s1"), 9)


@query(f"""WITH {SUPPLY_SQL}, links AS (SELECT DISTINCT src AS a, dst AS b FROM edges),
one AS (SELECT b AS node FROM links WHERE a = 's2'), two AS (SELECT DISTINCT a AS node FROM links JOIN one ON b = one.node)
SELECT 's2' AS seed, node, 2 AS hops FROM two WHERE node <> 's2' UNION ALL SELECT 's2', node, 1 FROM one UNION ALL SELECT 's2', 's2', 0""")
def khop_undirected(spark, sf_dir):
    """All nodes within two undirected hops."""
    return g.reachable(supply(spark, sf_dir)[1], _seeds(spark, "s2"), 2)


@query(f"""WITH RECURSIVE {TREE_SQL}, links AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
walk AS (SELECT id AS seed, id AS node, 0 AS hops FROM nodes WHERE type = 'BUILDING'
  UNION SELECT w.seed, l.b, w.hops + 1 FROM walk w JOIN links l ON l.a = w.node WHERE w.hops < 2)
SELECT w.seed AS description, w.node AS chunk, min(w.hops) AS hops FROM walk w JOIN nodes n ON n.id = w.node WHERE n.label = 'Chunk' GROUP BY ALL""")
def chunks_for_description(spark, sf_dir):
    """The chunks within two undirected hops of each node of one type, all in one search."""
    nodes, edges = tree(spark, sf_dir)
    chunks = nodes.where("label = 'Chunk'").select(F.col("id").alias("node"))
    found = g.reachable(edges, nodes.where("type = 'BUILDING'").select(F.col("id").alias("seed")), 2, targets=chunks)
    return found.select(F.col("seed").alias("description"), F.col("node").alias("chunk"), "hops")


def _triples(direction: str):
    def run(spark, sf_dir):
        nodes, edges = supply(spark, sf_dir)
        seed = _seeds(spark, "s3")
        found = g.neighbours(edges, seed, direction)
        name = nodes.select(F.col("id").alias("node"), "name")
        return found.join(name, "node").groupBy("seed", "node", "name", "type").agg(F.count("*").alias("n_edges"))

    return run


def _triples_sql(ends: str) -> str:
    return f"""WITH {SUPPLY_SQL}, both_ends AS ({ends}) SELECT b.a AS seed, b.b AS node, n.name, b.type, count(*) AS n_edges
FROM both_ends b JOIN nodes n ON n.id = b.b WHERE b.a = 's3' GROUP BY ALL"""


_OUT, _IN = "SELECT src AS a, dst AS b, type FROM edges", "SELECT dst AS a, src AS b, type FROM edges"
for _name, _direction, _sql in (("entity_rel_out", "out", _OUT), ("entity_rel_in", "in", _IN), ("entity_rel_both", "both", f"{_OUT} UNION ALL {_IN}")):
    QUERIES[_name], SQL[_name] = _triples(_direction), _triples_sql(_sql)


@query(f"WITH {SUPPLY_SQL} SELECT e.src AS from_id, a.name AS from_name, e.type, e.dst AS to_id, b.name AS to_name, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY ALL")
def entity_triples(spark, sf_dir):
    """All triples of entities, with how many edges say so."""
    nodes, edges = supply(spark, sf_dir)
    return g.triples(nodes, edges).groupBy("from_id", "from_name", "type", "to_id", "to_name").agg(F.count("*").alias("n"))


_STATS = f"WITH {SUPPLY_SQL} SELECT (SELECT count(DISTINCT id) FROM nodes) AS entities, (SELECT array_to_string(list_sort(list(DISTINCT type)), ',') FROM nodes) AS entity_types, {{}} AS relationships"


@query(_STATS.format("(SELECT count(*) FROM edges)"))
def graph_stats(spark, sf_dir):
    """Numbers of entities and relationships, and the entities' types."""
    return g.statistics(*supply(spark, sf_dir)).withColumn("entity_types", F.array_join("entity_types", ","))


@query(_STATS.format("(SELECT count(*) FROM edges) * (SELECT count(DISTINCT id) FROM nodes)"))
def graph_stats_compat(spark, sf_dir):
    """The same with the uncorrelated match's product."""
    return g.statistics(*supply(spark, sf_dir), compat=True).withColumn("entity_types", F.array_join("entity_types", ","))


@query(f"WITH {TREE_SQL} SELECT type, count(*) AS n FROM nodes WHERE label = 'Entity' GROUP BY type")
def type_counts(spark, sf_dir):
    return g.type_counts(tree(spark, sf_dir)[0])


@query(f"WITH {TREE_SQL} SELECT label, count(*) AS nodes, (SELECT count(*) FROM edges) AS relationships, 'healthy' AS status FROM nodes GROUP BY label")
def health(spark, sf_dir):
    """Nodes of each label and all relationships."""
    nodes, edges = tree(spark, sf_dir)
    total = edges.agg(F.count("*").alias("relationships"))
    return nodes.groupBy("label").agg(F.count("*").alias("nodes")).join(F.broadcast(total)).withColumn("status", F.lit("healthy"))


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS type FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def find_by_name_exact(spark, sf_dir):
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    least = nodes.agg(F.min("name")).first()[0]
    return g.find_by_name(nodes, least)


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS type FROM part WHERE contains(lower(p_name), 'part#1')  OR contains(lower(p_name), 'a')")
def find_by_name_contains(spark, sf_dir):
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    return g.find_by_name(nodes, "Part#1", exact=False).unionByName(g.find_by_name(nodes, "A", exact=False)).distinct()


@query("SELECT p_partkey AS id, p_name AS name, p_type AS type FROM part WHERE p_type = (SELECT max(p_type) FROM part)")
def find_by_type(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    most = part.agg(F.max("p_type")).first()[0]
    return part.where(F.col("p_type") == most).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS type FROM customer WHERE c_custkey = 42")
def find_by_id(spark, sf_dir):
    """An equality that reaches the Parquet scan."""
    return read(spark, sf_dir, "customer").where("c_custkey = 42").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))


@query("SELECT DISTINCT source AS document_name FROM documents WHERE trim(source) <> '' ORDER BY 1")
def doc_list(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("source").alias("document_name")).where("trim(document_name) <> ''").distinct().orderBy("document_name")


@query("SELECT source AS document_name, min(doc_id) AS id FROM documents GROUP BY source")
def doc_id_by_name(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("document_name")).agg(F.min("doc_id").alias("id"))


@query("SELECT count(*) > 0 AS found FROM documents WHERE source = 'src7'")
def doc_exists(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("source = 'src7'").select("source").limit(1).agg((F.count("*") > 0).alias("found"))


@query("""SELECT name, type, id FROM (SELECT c_mktsegment AS name, 'segment' AS type, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer) WHERE n = 1
UNION ALL SELECT name, type, id FROM (SELECT p_brand AS name, 'brand' AS type, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n = 1""")
def upsert_first_wins(spark, sf_dir):
    """Entities are created once for each name and type; later ones leave them as they are."""
    old = g.first_of(read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("segment").alias("type"), F.col("c_custkey").alias("id")), ["name", "type"], [F.col("id")])
    new = read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit("brand").alias("type"), F.col("p_partkey").alias("id"))
    return g.create_missing(old, new, ["name", "type"], [F.col("id")])


@query("""WITH new AS (SELECT p_type AS name, max_by(p_name, p_partkey) AS description FROM part WHERE p_size > 25 GROUP BY p_type),
old AS (SELECT p_type AS name, min_by(p_name, p_partkey) AS description FROM part GROUP BY p_type)
SELECT name, description FROM new UNION ALL SELECT name, description FROM old WHERE name NOT IN (SELECT name FROM new)""")
def merge_overwrite(spark, sf_dir):
    """Rows of the same name are overwritten."""
    part = read(spark, sf_dir, "part")
    old = part.groupBy(F.col("p_type").alias("name")).agg(F.min_by("p_name", "p_partkey").alias("description"))
    new = part.where("p_size > 25").select(F.col("p_type").alias("name"), F.col("p_name").alias("description"), F.col("p_partkey").alias("_at"))
    last = g.first_of(new, ["name"], [F.desc("_at")]).drop("_at")
    return g.merge(old, last, ["name"], [F.col("description")])


_GONE = "SELECT id FROM nodes WHERE type = 'supplier' AND name LIKE '%1'"


@query(f"WITH {SUPPLY_SQL}, gone AS ({_GONE}) SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS n_nodes, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM gone)) AS n_edges")
def delete_cascade(spark, sf_dir):
    """What is left when nodes go with their edges."""
    nodes, edges = supply(spark, sf_dir)
    gone = nodes.where("type = 'supplier' and name like '%1'").select("id")
    left, kept = g.delete_nodes(nodes, edges, gone)
    return left.agg(F.count("*").alias("n_nodes")).join(kept.agg(F.count("*").alias("n_edges")))


@query(f"WITH {TREE_SQL} SELECT id, label, type FROM nodes WHERE NOT (label = 'Entity' AND id NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges)) AND NOT (label = 'Item' AND id NOT IN (SELECT src FROM edges UNION ALL SELECT dst FROM edges))")
def delete_strict(spark, sf_dir):
    """Without cascade, nodes with edges stay."""
    nodes, edges = tree(spark, sf_dir)
    return g.delete_nodes(nodes, edges, nodes.where("label in ('Entity', 'Item')").select("id"), cascade=False)[0].select("id", "label", "type")


@query(f"WITH {SUPPLY_SQL} SELECT src, dst, type, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY seq, line) AS n FROM edges) WHERE n = 1")
def edge_dedupe(spark, sf_dir):
    return g.distinct_edges(supply(spark, sf_dir)[1], [F.col("seq"), F.col("line")])


@query("SELECT p_brand AS name, p_type AS type, min(p_partkey) AS id, count(*) AS n FROM part GROUP BY 1, 2")
def entity_dedupe(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("type")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def linked_semi(spark, sf_dir):
    """Orders that a returned item mentions."""
    items = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(items, "id", "left_semi")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unlinked_anti(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(items, "id", "left_anti")


@query("""WITH asked AS (SELECT 'c' || o_custkey AS src, 's' || (o_orderkey % 150) AS dst, 'MENTIONS' AS type, o_orderkey AS seq FROM orders)
SELECT src, dst, type, seq, src IN (SELECT 'c' || c_custkey FROM customer) AND dst IN (SELECT 's' || s_suppkey FROM supplier) AS created FROM asked""")
def create_edges(spark, sf_dir):
    """Edges are created where both ends exist; the others are reported."""
    asked = read(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("s"), F.col("o_orderkey") % 150).alias("dst"), F.lit("MENTIONS").alias("type"), F.col("o_orderkey").alias("seq"))
    ids = tree(spark, sf_dir)[0].select("id").unionByName(supply(spark, sf_dir)[0].select("id"))
    good, bad = g.create_edges(ids, asked)
    return good.withColumn("created", F.lit(True)).unionByName(bad.withColumn("created", F.lit(False)))


@query("SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def uniqueness_check(spark, sf_dir):
    return g.duplicate_ids(read(spark, sf_dir, "events").select(F.col("user_id").alias("id")))
