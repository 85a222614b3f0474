"""The driver's tables as the library's data model: documents, vectors, a containment tree and an entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions contain nations, these customers, these orders: nodes (Document, Chunk, Entity, Item) and CONTAINS edges."""
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))

    def node(df: DataFrame, mark: str, key: str, label: str, name: str, kind: str) -> DataFrame:
        return df.select(_id(mark, key).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), F.expr(kind).alias("type"))

    nodes = node(region, "r", "r_regionkey", "Document", "r_name", "'region'").unionByName(node(nation, "n", "n_nationkey", "Chunk", "n_name", "'nation'"))
    nodes = nodes.unionByName(node(customer, "c", "c_custkey", "Entity", "c_name", "c_mktsegment")).unionByName(node(orders, "o", "o_orderkey", "Item", "o_orderkey", "o_orderstatus"))

    def edge(df: DataFrame, src: tuple[str, str], dst: tuple[str, str]) -> DataFrame:
        return df.select(_id(*src).alias("src"), _id(*dst).alias("dst"), F.lit("CONTAINS").alias("type"))

    edges = edge(nation, ("r", "n_regionkey"), ("n", "n_nationkey")).unionByName(edge(customer, ("n", "c_nationkey"), ("c", "c_custkey"))).unionByName(edge(orders, ("c", "o_custkey"), ("o", "o_orderkey")))
    return nodes, edges


def _id(mark: str, key: str):
    return F.concat(F.lit(mark), F.col(key).cast("string"))


#: The same tree in SQL.
TREE_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS id, 'Document' AS label, r_name AS name, 'region' AS type FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'Chunk', n_name, 'nation' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'Entity', c_name, c_mktsegment FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'Item', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders
), edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'CONTAINS' AS type FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'CONTAINS' FROM orders
)
"""


def supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts as Entity nodes, and what they supply as edges; one edge a line item, so edges repeat."""
    supplier, part, lineitem = (read(spark, sf_dir, t) for t in ("supplier", "part", "lineitem"))
    nodes = supplier.select(_id("s", "s_suppkey").alias("id"), F.lit("Entity").alias("label"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"))
    nodes = nodes.unionByName(part.select(_id("p", "p_partkey").alias("id"), F.lit("Entity").alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("type")))
    edges = lineitem.select(_id("s", "l_suppkey").alias("src"), _id("p", "l_partkey").alias("dst"), F.lit("RELATED").alias("type"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"))
    return nodes, edges


SUPPLY_SQL = """
nodes AS (
  SELECT 's' || s_suppkey AS id, 'Entity' AS label, s_name AS name, 'supplier' AS type FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'Entity', p_name, p_brand FROM part
), edges AS (
  SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, 'RELATED' AS type, l_orderkey AS seq, l_linenumber AS line FROM lineitem
)
"""


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes for hybrid search: each vector with the document of the same number; its label follows from the vector's."""
    vectors, docs = read(spark, sf_dir, "embeddings"), read(spark, sf_dir, "documents")
    label = F.when(F.col("label") == 0, "Document").when(F.col("label") < 6, "Chunk").otherwise("Entity")
    return vectors.join(docs, vectors.vec_id == docs.doc_id, "left").select(
        F.col("vec_id").alias("id"), label.alias("label"), "text", F.col("source").alias("name"), F.lit(None).cast("string").alias("summary"), F.col("lang").alias("description"), "embedding"
    )


SEARCHABLE_SQL = """
searchable AS (
  SELECT e.vec_id AS id, CASE WHEN e.label = 0 THEN 'Document' WHEN e.label < 6 THEN 'Chunk' ELSE 'Entity' END AS label,
         d.text, d.source AS name, d.lang AS description, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id
)
"""


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of all pages in order: ``doc_id, line_no, level, title``."""
    pattern = r"(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>"
    pages = read(spark, sf_dir, "pages")
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("level"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("title"))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(both).alias("line_no", "h"))
    return rows.select("doc_id", "line_no", F.col("h.level").cast("int").alias("level"), F.col("h.title").alias("title"))


HEADINGS_SQL = r"""
heads AS (
  SELECT page_id AS doc_id, CAST(unnest(range(len(lv))) AS INT) AS line_no, CAST(unnest(lv) AS INT) AS level, unnest(ti) AS title
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS lv, regexp_extract_all(html, '(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS ti FROM pages)
)
"""
