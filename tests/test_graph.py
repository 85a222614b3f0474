"""Graph, vector, builder and retrieval operators on a small graph."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docweave.operators import build, graph, layout, models, retrieval, vectors
from docweave.sources.files import EXTRACTION

NODES = [("a", "Document", "A", "doc"), ("b", "Chunk", "B", "chunk"), ("c", "Entity", "C", "x"), ("d", "Entity", "D", "y"), ("e", "Entity", "E", "y"), ("z", "Entity", "Z", "x")]
EDGES = [("a", "b", "CONTAINS"), ("b", "c", "MENTIONS"), ("c", "d", "REL"), ("c", "d", "REL"), ("d", "b", "REL"), ("e", "e", "LOOP")]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(NODES, "id string, label string, name string, type string"), spark.createDataFrame(EDGES, "src string, dst string, type string")


def test_reachable(spark, small):
    seeds = spark.createDataFrame([("a",), ("e",)], "seed string")
    got = {tuple(r) for r in graph.reachable(small[1], seeds, 9).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("e", "e", 0)}
    directed = {tuple(r) for r in graph.reachable(small[1], seeds, 2, directed=True).collect()}
    assert directed == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("e", "e", 0)}


def test_reachable_targets_do_not_list_the_neighbours_of_busy_nodes(spark, monkeypatch):
    """Many seeds at one hub: the pairs with the target, and within two hops no written table of all pairs of seeds."""
    written = {}
    save = graph.Store.save

    def counted(self, df, name):
        out = save(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(graph.Store, "save", counted)
    edges = spark.createDataFrame([("hub", f"s{k}") for k in range(40)] + [("up", "hub"), ("s0", "x"), ("x", "y")], "src string, dst string")
    seeds = edges.where("dst like 's%'").select(F.col("dst").alias("seed")).unionByName(spark.createDataFrame([("y",), ("up",)], "seed string"))
    for most in (1, 2, 3):
        whole = {tuple(r) for r in graph.reachable(edges, seeds, most).where("node in ('hub', 'up')").collect()}
        written.clear()
        got = [tuple(r) for r in graph.reachable(edges, seeds, most, targets=spark.createDataFrame([("hub",), ("up",), ("none",)], "node string")).collect()]
        assert len(got) == len(set(got)) and set(got) == whole
        assert most > 2 or max(n for name, n in written.items() if name != "links") <= 2 * 42


def test_table_graph_of_repeated_chunks_and_like_ids(spark, monkeypatch):
    """Nodes and edges come once where a chunk comes twice, and where two relationships of a chunk get one id; ids are written once a chunk."""
    columns = {}
    save = graph.Store.save
    monkeypatch.setattr(graph.Store, "save", lambda self, df, name: columns.update({name: df.columns}) or save(self, df, name))
    schema = "document string, chunk_id string, text string, nodes array<struct<id:string,type:string>>, edges array<struct<source:string,target:string,type:string>>"
    plain = ("d", "1", "t", [("t", "Table"), ("i", "Item"), ("a", "City")], [("t", "i", "CONTAINS"), ("i", "a", "MENTIONS"), ("a", "t", "IN")])
    alike = ("d", "2", "t", [("a/b", "City"), ("c", "City"), ("a", "City"), ("b/c", "City")], [("a/b", "c", "IN"), ("a", "b/c", "IN")])
    for rows in ([plain, alike], [plain, plain, alike, ("e", *plain[1:])]):
        nodes, edges = build.table_graph(spark.createDataFrame(rows, schema))
        nodes, edges, documents = nodes.collect(), edges.collect(), len({r[0] for r in rows})
        assert len(nodes) == len({n["id"] for n in nodes}) and len(edges) == len({tuple(e) for e in edges})
        # Of each plain chunk: chunk, table, item, city and relationship; of the other: chunk, three more cities and one relationship; all but chunks described.
        own = {"Document": 1, "Chunk": 1, "Table": 1, "Item": 1, "Entity": 1, "Relationship": 1, "Description": 4}
        count = {k: sum(n["label"] == k for n in nodes) for k in own}
        assert count == {k: n * documents + {"Chunk": 1, "Entity": 3, "Relationship": 1, "Description": 4}.get(k, 0) for k, n in own.items()}
    assert "all_edges" not in columns["chunks"]


def test_layout_order_rounds_the_middle_of_a_table_once(spark):
    """An image 10 below a table's upper edge stands where the table's middle is, also where sums of the two edges are rounded."""
    tops = [k / 100 for k in range(1000, 1400)]
    images = spark.createDataFrame([(k, 5, 0.0, top + 10, 1.0, top + 11, "image", "i") for k, top in enumerate(tops)], "page int, seq int, x0 double, y0 double, x1 double, y1 double, kind string, content string")
    tables = spark.createDataFrame([(k, 0.0, 1.0, top, 20.0, [["a"]]) for k, top in enumerate(tops)], "page int, x0 double, x1 double, y0 double, height double, rows array<array<string>>")
    first = layout.layout_order(images, tables).where("place = 0").select("kind").distinct().collect()
    assert [r["kind"] for r in first] == ["table"]


def test_paths_keep_parallel_walks(spark, small):
    seeds = spark.createDataFrame([("b",)], "seed string")
    assert graph.paths(small[1], seeds, 2, 2).where("node = 'd'").count() == 2


def test_both_ways_and_neighbours(spark, small):
    seeds = spark.createDataFrame([("c",)], "seed string")
    assert graph.neighbours(small[1], seeds, "both").count() == 3
    assert graph.both_ways(small[1]).where("src = 'e'").count() == 2


def test_mutations(spark, small):
    nodes, edges = small
    new = spark.createDataFrame([("n1", "Entity", "C", "x"), ("n2", "Entity", "N", "x"), ("n3", "Entity", "N", "x")], nodes.schema)
    made = graph.create_missing(nodes, new, ["name", "type"], [F.col("id")])
    assert {r["id"] for r in made.collect()} == {n[0] for n in NODES} | {"n2"}
    over = graph.merge(nodes, new, ["name", "type"], [F.desc("id")])
    assert {r["id"] for r in over.collect()} == {"a", "b", "d", "e", "z", "n1", "n3"}
    good, bad = graph.create_edges(nodes, spark.createDataFrame([("a", "c", "X"), ("a", "q", "X")], edges.schema))
    assert (good.count(), bad.count()) == (1, 1)
    left, kept = graph.delete_nodes(nodes, edges, spark.createDataFrame([("c",)], "id string"))
    assert (left.count(), kept.count()) == (5, 3)
    strict, _ = graph.delete_nodes(nodes, edges, spark.createDataFrame([("c",), ("z",)], "id string"), cascade=False)
    assert {r["id"] for r in strict.collect()} == {"a", "b", "c", "d", "e"}
    assert graph.duplicate_ids(nodes.unionByName(nodes.limit(1))).count() == 1


def test_strict_deletion_holds_few_rows_a_task(spark, monkeypatch):
    nodes = spark.range(400).select(F.concat(F.lit("v"), "id").alias("id"), F.lit("Entity").alias("label"))
    edges = spark.range(0, 400, 8).select(F.concat(F.lit("v"), "id").alias("src"), F.concat(F.lit("v"), F.col("id") + 1).alias("dst"), F.lit("X").alias("type"))
    expected = {f"v{k}" for k in range(400) if k % 8 < 2}
    for rows in (10, 1000):  # more ids than that go, then fewer
        monkeypatch.setattr(graph, "TASK_ROWS", rows)
        left, kept = graph.delete_nodes(nodes, edges, nodes.select("id"), cascade=False)
        assert {r["id"] for r in left.collect()} == expected and kept.count() == 50
        if rows == 10:
            assert left.rdd.getNumPartitions() == 70
        else:
            assert "hashpartitioning" not in left._jdf.queryExecution().toString()
    none, _ = graph.delete_nodes(nodes.where("false"), edges, nodes.select("id"), cascade=False)
    assert none.count() == 0


def test_chunks_of_many_targets_list_no_dead_ends(spark, monkeypatch):
    tree = [("d", f"k{c}") for c in range(5)] + [(f"k{c}", f"e{c}{e}") for c in range(5) for e in range(10)]
    tree += [(f"e{c}{e}", f"i{c}{e}{i}") for c in range(5) for e in range(10) for i in range(10)]
    edges = spark.createDataFrame(tree, "src string, dst string").withColumn("type", F.lit("CONTAINS"))
    nodes = spark.createDataFrame([(f"k{c}", "Chunk") for c in range(5)], "id string, label string")
    targets = spark.createDataFrame([(f"e{c}{e}",) for c in range(5) for e in range(2)], "id string")
    sizes, save = {}, graph.Store.save

    def counted(store, df, name):
        out = save(store, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(graph.Store, "save", counted)
    got = {tuple(r) for r in retrieval.chunks_of(edges, nodes, targets, 6).collect()}
    assert got == {(f"e{c}{e}", f"k{k}", 1 if c == k else 3) for c in range(5) for e in range(2) for k in range(5)}
    assert max(n for name, n in sizes.items() if name.startswith("hop")) <= 600  # 2,000 in the fourth hop with all dead ends


@pytest.mark.parametrize("rows", [1 << 19, 10])
def test_trimmed_links_keep_the_hops_between_kept_nodes(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "TASK_ROWS", rows)
    rng = np.random.default_rng(3)
    for n, some in ((40, 38), (6, 4)):
        pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (some, 2))] + [("n0", None), (None, "n1"), ("n2", "n2"), ("n0", "n1"), ("n1", "n0")]
        edges = spark.createDataFrame(pairs, "src string, dst string")
        keep = [f"n{k}" for k in range(0, n, 5)] + ["alone"]
        seeds = spark.createDataFrame([(k,) for k in keep], "seed string")
        whole = {tuple(r) for r in graph.reachable(edges, seeds, 5).collect() if r["node"] in keep}
        for rounds in (1, 2):
            links = graph.trimmed(edges, seeds.select(F.col("seed").alias("id")), rounds)
            assert {tuple(r) for r in graph.reachable(edges, seeds, 5, links=links).collect() if r["node"] in keep} == whole
            assert {tuple(r) for r in links.collect()} <= {tuple(r) for r in graph.steps(edges).collect()} and links.count() == links.distinct().count()


def test_profiles_search_no_branch_without_vectors(spark, monkeypatch):
    """Items below descriptions, and descriptions without vectors, lead to nothing: items are in no table that is written."""
    tree = [("d", f"k{c}") for c in range(3)] + [(f"k{c}", f"e{c}{e}") for c in range(3) for e in range(20)]
    tree += [(f"e{c}{e}", f"i{c}{e}{i}") for c in range(3) for e in range(20) for i in range(20)]
    edges = spark.createDataFrame(tree, "src string, dst string").withColumn("type", F.lit("CONTAINS"))
    vectors = {f"e{c}{e}": [1.0, c + e / 10] for c in range(3) for e in range(2)}
    kinds = {"d": "Document", "k": "Chunk", "e": "Description", "i": "Item"}
    rich = [(n, kinds[n[0]], vectors.get(n)) for n in sorted({x for edge in tree for x in edge})]
    nodes = spark.createDataFrame(rich, "id string, label string, embedding array<double>").withColumn("embeddings", F.lit(None).cast("array<double>"))
    sizes, save = {}, graph.Store.save

    def counted(store, df, name):
        out = save(store, df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(graph.Store, "save", counted)
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "question int, embedding array<double>")
    got = {(r["hit"], r["chunk"]) for r in retrieval.profile_hits(nodes, edges, "d", asked, 3).collect()}
    assert got == {("e21", "k0"), ("e21", "k1"), ("e21", "k2")}
    assert max(sizes.values()) <= 200, sizes  # 2,526 links with all items


def test_statistics(small):
    assert tuple(graph.statistics(*small).first()) == (4, ["x", "y"], 6)
    assert graph.statistics(*small, compat=True).first()["relationships"] == 24


def test_cosine_cases(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [r["x"] for r in rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == 0 and math.isclose(got[1], 1) and got[2:] == [None, None, None, None]


def test_batch_topk_ties_go_to_the_smaller_key(spark):
    vec = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0]), (5, None)], "id long, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "question string, embedding array<double>")
    got = [(r["id"], r["rank"]) for r in vectors.batch_topk(vec, asked, 2).orderBy("rank").collect()]
    assert got == [(1, 1), (3, 2)]
    assert vectors.batch_topk(vec, asked.limit(0), 2).count() == 0


def test_batch_topk_holds_few_scores_at_once(spark, monkeypatch):
    """With room for the scores of seven questions the result is that of all at once."""
    rows = [(k, [float((k * 7 + j * 3) % 11), float(j + k % 5), 1.0]) for k in range(100) for j in [k % 4]]
    vec = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = vec.select(F.col("id").alias("question"), "embedding")
    whole = {tuple(r)[:2] + (round(r["similarity"], 9),) for r in vectors.batch_topk(vec, asked, 3).collect()}
    assert vectors.SCORES * 8 <= 8 << 20
    monkeypatch.setattr(vectors, "SCORES", 700)
    assert {tuple(r)[:2] + (round(r["similarity"], 9),) for r in vectors.batch_topk(vec, asked, 3).collect()} == whole


def test_batch_topk_keeps_questions_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 30, raising=False)
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    rng = np.random.default_rng(3)
    found = [(k, [float(x) for x in rng.integers(-2, 3, 3 + k % 2)]) for k in range(100)]
    vec = spark.createDataFrame(found, "id long, embedding array<double>")
    asked = vec.where("id % 3 = 0").withColumnRenamed("id", "question")
    got = sorted((r["question"], r["rank"], r["id"]) for r in vectors.batch_topk(vec, asked, 4).collect())
    expected = []
    for q, x in found[::3]:
        scored = [(-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), k) for k, y in found if len(x) == len(y) and any(x) and any(y)]
        expected += [(q, n + 1, k) for n, (_, k) in enumerate(sorted(scored)[:4])]
    near = {(q, n): s for q, n, s in ((r["question"], r["rank"], round(r["similarity"], 9)) for r in vectors.batch_topk(vec, asked, 4).collect())}
    assert [x[:2] for x in got] == [x[:2] for x in sorted(expected)]
    for q, n, k in expected:
        x, y = found[q][1], found[k][1]
        assert near[q, n] == pytest.approx(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)))


def test_extraction_becomes_the_expected_graph(spark):
    about = lambda text: Row(type="Description", text=text, embedding=[])
    entity = lambda name, kind: Row(id=name, name=name, type=kind, description_node=about(f"about {name}"))
    relation = lambda a, b, kind: Row(id=kind, source=a, target=b, type=kind, description_node=about(kind))
    entities = [entity("Microsoft", "Organization"), entity("Windows 11", "Product"), entity("2021", "Date")]
    relations = [relation("Microsoft", "Windows 11", "Develops"), relation("Windows 11", "2021", "Released_In")]
    rows = spark.createDataFrame([Row(document="d", chunk_id="1", chunk_text="t", entities=entities, relationships=relations)], f"document string, {EXTRACTION}".replace("summary STRING, metadata MAP<STRING,STRING>, embedding ARRAY<DOUBLE>, ", ""))
    got = {(r["kind"], r["name"]): r["n"] for r in build.build_counts(*build.text_graph(rows)).collect()}
    assert got == {("node", "Document"): 1, ("node", "Chunk"): 1, ("node", "Entity"): 3, ("node", "Relationship"): 2, ("node", "Description"): 5, ("edge", "CONTAINS"): 1, ("edge", "MENTIONS"): 3, ("edge", "RELATED"): 4, ("edge", "DESCRIBES"): 5}


def test_summaries_replace_the_largest_chunks(spark):
    rows = [(1, k, n, s, has) for k, (n, s, has) in enumerate([(50, 5, True), (80, 90, True), (80, 10, True), (100, 1, False), (0, 0, True)])]
    df = spark.createDataFrame(rows, "doc_id long, chunk_number int, text_tokens int, summary_tokens int, has_summary boolean")

    def loop(budget):
        left, used = {r[1]: r for r in rows}, set()
        total = sum(r[2] for r in rows)
        while total > budget:
            can = [r for r in left.values() if r[4] and r[2] > 0 and r[1] not in used]
            if not can:
                break
            best = max(can, key=lambda r: (r[2], -r[1]))
            used.add(best[1])
            total += best[3] - best[2]
        return used

    for budget in (400, 300, 250, 150, 10):
        got = {r["chunk_number"] for r in retrieval.substitute_summaries(df, budget).where("use_summary").collect()}
        assert got == loop(budget)


def test_consume_whole_hits(spark):
    hits = spark.createDataFrame([("q", "h1", "c1", 9), ("q", "h2", "c1", 8), ("q", "h2", "c2", 8), ("q", "h2", "c3", 8), ("q", "h3", "c4", 7)], "question string, hit string, chunk string, score int")
    got = {(r["hit"], r["chunk"]) for r in retrieval.consume_until(hits, 2, [F.desc("score")]).collect()}
    assert got == {("h1", "c1"), ("h2", "c2"), ("h2", "c3")}


def test_models(spark):
    assert models.family("gpt-4o") == "openai"
    with pytest.raises(ValueError, match="unknown model"):
        models.family("other")

    class Echo(models.Provider):
        def complete(self, prompts):
            return [p.upper() for p in prompts]

    class Broken(models.Provider):
        def complete(self, prompts):
            raise RuntimeError

    df = spark.createDataFrame([("a",)], "p string")
    assert df.select(models.completion(Echo(), F.col("p"))).first()[0] == "A"
    assert df.select(models.completion(Broken(), F.col("p"), tries=2, pause=0.01)).first()[0] is None
    answer = df.select(models.extractive_answer(F.lit("Where is Paris located"), F.lit("Nothing here. Well, paris is in France. End."))).first()[0]
    assert answer["answerable"] and answer["answer"] == "Well, paris is in France."


def test_caption_places(spark):
    place = lambda text, phrase: spark.range(1).select(layout.caption_place(F.lit(text), F.lit(phrase))).first()[0]
    assert place("a b the cat sat on the mat", "the cat sat on the hat") == 5
    assert place("only the cat", "the cat sat on") == 6
    assert place("nothing", "the cat") == 0
