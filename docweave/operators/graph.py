"""A labelled property graph in two tables: patterns, expansion, mutations, lookups and statistics.

``nodes`` has at least ``id, label, name, type``, and ``edges`` has ``src, dst, type``;
all further columns are carried along. Partition the stored tables by label and by
edge type, so that scans of one label or type read only its files.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators.store import Store

#: Rows of both sides that a task sorts, on average, where one large table is held against another.
TASK_ROWS = 1 << 19


def turned(edges: DataFrame) -> DataFrame:
    """Every edge the other way round."""
    other = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns])


def both_ways(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """Every edge in both directions; a loop comes twice unless ``distinct``."""
    out = edges.unionByName(turned(edges))
    return out.distinct() if distinct else out


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "out") -> DataFrame:
    """``seed, node, type`` for each edge at a row of ``seeds(seed)``: out, in or both."""
    chosen = {"out": lambda: edges, "in": lambda: turned(edges), "both": lambda: both_ways(edges)}[direction]()
    return seeds.join(chosen.select(F.col("src").alias("seed"), F.col("dst").alias("node"), "type"), "seed")


def triples(nodes: DataFrame, edges: DataFrame, direction: str = "out", label: str | None = "Entity") -> DataFrame:
    """``from_id, from_name, type, to_id, to_name`` of edges whose ends both have the label."""
    chosen = nodes.where(F.col("label") == label) if label else nodes
    a, b = (chosen.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name")) for c in ("from", "to"))
    pairs = (both_ways(edges) if direction == "both" else edges).select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "type")
    return pairs.join(a, "from_id").join(b, "to_id").select("from_id", "from_name", "type", "to_id", "to_name")


def paths(edges: DataFrame, seeds: DataFrame, least: int, most: int) -> DataFrame:
    """``seed, node, hops``, one row for each directed walk of ``least`` to ``most`` edges from a seed.

    Walks are not made distinct; use it on trees and other graphs with few walks.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next"))
    at, found = seeds.select("seed", F.col("seed").alias("node")), []
    for hops in range(1, most + 1):
        at = at.join(step, "node").select("seed", F.col("_next").alias("node"))
        if hops >= least:
            found.append(at.withColumn("hops", F.lit(hops)))
    return reduce(DataFrame.unionByName, found)


def steps(edges: DataFrame, directed: bool = False) -> DataFrame:
    """``node, _next``: each step of a search once; an edge that ends where it begins is none."""
    both = edges.select("src", "dst") if directed else both_ways(edges.select("src", "dst"))
    return both.where("src <> dst").distinct().select(F.col("src").alias("node"), F.col("dst").alias("_next"))


def reachable(edges: DataFrame, seeds: DataFrame, most: int, directed: bool = False, targets: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """``seed, node, hops`` of every node within ``most`` hops, with its least number of hops.

    A breadth-first search of all seeds at once: each hop joins the frontier with
    the edges, drops what was seen, and is written, so the plan stays short and a
    lost executor costs one hop. It ends early with an empty frontier.

    With ``targets(node)`` only these are found. How far every node is from its next target is known
    first, by one search from all targets together, with one row a node; a hop then goes only to nodes from
    which the hops that are left can lead to a target; so in the last hop many seeds at one busy node do not each list its neighbours.
    Edges that lead on to no target are left out once, before the first hop.

    ``links`` are those of ``steps(edges, ...)``, or of ``trimmed``, where several searches of one graph share them.
    """
    store = Store(edges.sparkSession, "reach")
    links = store.save(steps(edges, directed), "links") if links is None else links
    if targets is not None:
        ahead = _hops_to(links, targets, most - 1, store)
        links = store.save(links.join(ahead.select(F.col("node").alias("_next"), "left"), "_next"), "useful")
    frontier = store.save(seeds.select("seed", F.col("seed").alias("node")).distinct().withColumn("hops", F.lit(0)), "hop0")
    seen = frontier
    for hops in range(1, most + 1):
        useful = links if targets is None else links.where(F.col("left") <= most - hops)
        further = frontier.join(useful, "node").select("seed", F.col("_next").alias("node")).distinct()
        frontier = store.save(further.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hops)), f"hop{hops}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if targets is None else seen.join(targets.select("node").distinct(), "node", "left_semi").select("seed", "node", "hops")


def _hops_to(links: DataFrame, targets: DataFrame, most: int, store: Store) -> DataFrame:
    """``node, left``: each node within ``most`` hops of any target, with the least number of hops to one."""
    frontier = store.save(targets.select("node").distinct().withColumn("left", F.lit(0)), "left0")
    seen = frontier
    for left in range(1, most + 1):
        before = links.join(frontier.select(F.col("node").alias("_next")), "_next", "left_semi").select("node").distinct()
        frontier = store.save(before.join(seen.select("node"), "node", "left_anti").withColumn("left", F.lit(left)), f"left{left}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def trimmed(edges: DataFrame, keep: DataFrame, rounds: int = 2) -> DataFrame:
    """``node, _next`` as of ``steps``, without those that no shortest walk between two nodes of ``keep(id)`` takes because they end at a leaf.

    A leaf is a node at one edge only. Unless it is kept it leads from nothing to nothing else, so its edge goes; so does, a round
    later, what has become a leaf by that. Numbers of hops between kept nodes stay. Each round counts edges by node, and holds them
    against the nodes that stay, first by their ends: edges lead to what is contained, so most leaves are there and few edges
    are left for the starts. Repeated edges only keep a leaf for the first round. Tasks hold ``TASK_ROWS`` rows on average.
    """
    store, left = Store(edges.sparkSession, "trim"), edges.select("src", "dst")
    for n in range(rounds):
        counted = left.select(F.col("src").alias("id")).unionByName(left.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
        stay = store.save(counted.where("n > 1").select("id").unionByName(keep.select("id")), f"stay{n}")
        few, tasks = (rows := stay.count()) <= TASK_ROWS, _tasks(edges.sparkSession, left.count() + rows)
        for end in ("dst", "src"):
            ids = stay.select(F.col("id").alias(end))
            left = left.join(ids, end, "left_semi") if few else left.repartition(tasks, end).join(ids.repartition(tasks, end), end, "left_semi")
        pairs = left.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        left = store.save(pairs.distinct(), f"pairs{n}")
    return both_ways(left).select(F.col("src").alias("node"), F.col("dst").alias("_next"))


def lift(hits: DataFrame, parents: DataFrame, factor: float) -> DataFrame:
    """Hits ``node, score`` moved to their ``parents(node, parent)`` at a reduced score."""
    return hits.join(parents, "node").select(F.col("parent").alias("node"), F.col("node").alias("inherited_from"), (F.col("score") * factor).alias("score"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def create_missing(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows and those new ones whose keys they lack; of several the first."""
    return existing.unionByName(first_of(new, keys, order).join(existing.select(*keys), keys, "left_anti"))


def merge(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows take the place of existing ones with the same keys; of several new ones the last in order."""
    last = first_of(new, keys, order)
    return existing.join(last.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(last)


def create_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends both exist, and those that are rejected."""
    ids = nodes.select("id").distinct()
    starts = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    good = starts.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
    bad = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    return good, bad.where("_s is null or _d is null").select(*edges.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame, cascade: bool = True) -> tuple[DataFrame, DataFrame]:
    """Tables without the nodes of ``ids(id)``. Their edges go too; without ``cascade`` nodes that have edges stay.

    Without ``cascade`` no edge goes. Ids and edges meet in tasks of ``TASK_ROWS`` rows: short ids compress so well
    that partitions of a bounded size on disk are many times as large in memory. The ids that go are written, so that few
    of them are sent to the nodes' tasks, and nodes are neither shuffled nor sorted.
    """
    if not cascade:
        used = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
        gone = Store(nodes.sparkSession, "delete").save(_lacking(ids.select("id"), used, "id"), "gone")
        return nodes.join(gone, "id", "left_anti") if gone.count() <= TASK_ROWS else _lacking(nodes, gone, "id"), edges
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def _lacking(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ``others``; as many tasks as it takes for each to hold ``TASK_ROWS`` rows on average."""
    tasks = _tasks(rows.sparkSession, rows.count() + others.count())
    return rows.repartition(tasks, key).join(others.repartition(tasks, key), key, "left_anti")


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))


def distinct_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """The first edge of each source, target and type."""
    return first_of(edges, ["src", "dst", "type"], order)


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids that more than one node has, the check behind a uniqueness constraint."""
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def statistics(nodes: DataFrame, edges: DataFrame, label: str = "Entity", compat: bool = False) -> DataFrame:
    """One row: entities, relationships and the entities' types. ``compat`` multiplies the first two, as an uncorrelated match does."""
    chosen = nodes.where(F.col("label") == label).agg(F.count_distinct("id").alias("entities"), F.array_sort(F.collect_set("type")).alias("entity_types"))
    counted = edges.agg(F.count("*").alias("relationships"))
    out = chosen.join(F.broadcast(counted))  # two single rows
    return out.withColumn("relationships", F.col("entities") * F.col("relationships")) if compat else out


def type_counts(nodes: DataFrame, label: str = "Entity") -> DataFrame:
    return nodes.where(F.col("label") == label).groupBy("type").agg(F.count("*").alias("n"))


def find_by_name(nodes: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """Nodes of that name, or whose name contains it whatever the case."""
    return nodes.where(F.col("name") == name if exact else F.contains(F.lower("name"), F.lit(name.lower())))


def find_by_name_and_type(nodes: DataFrame, name: str, kind: str) -> DataFrame:
    """Nodes of that name and type."""
    return nodes.where((F.col("name") == name) & (F.col("type") == kind))
