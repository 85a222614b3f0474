"""From search hits to contexts: lifting, deduplication, budgets, and the summaries of answering and profiling runs."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import iso_stamp, token_count, words
from docweave.operators.graph import both_ways, first_of, merge, reachable, trimmed
from docweave.operators.models import extractive_answer
from docweave.operators.store import Store
from docweave.operators.vectors import SEMANTIC, batch_topk, hybrid_topk, scoped, semantic_topk, vector

#: Hits that are ranked for each chunk that is looked for, at first.
DEPTH = 4
#: What a hit's score is multiplied with when its parent chunk or a related chunk takes its place.
CHILD, RELATED = 0.9, 0.8
#: Labels whose hits are replaced by their chunk.
CHILD_LABELS = ("Entity", "Table", "Item", "Paragraph", "Section")


def lift_hits(hits: DataFrame, parents: DataFrame, related: DataFrame, k: int = 10, most_related: int = 3) -> DataFrame:
    """Hits ``node, label, score`` as chunks ``node, score, inherited_from``: the best ``k``, each once.

    Chunks stay as they are; hits of ``CHILD_LABELS`` move to ``parents(node, parent)``
    and all others to up to three of ``related(node, parent)``, by id, at a reduced score.
    """
    own = hits.where("label = 'Chunk'").select("node", "score", F.lit(None).cast(hits.schema["node"].dataType).alias("inherited_from"))
    child = hits.where(F.col("label").isin(*CHILD_LABELS)).join(parents, "node").select(F.col("parent").alias("node"), (F.col("score") * CHILD).alias("score"), F.col("node").alias("inherited_from"))
    near = related.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("parent"))).where(F.col("_n") <= most_related)
    other = hits.where(~F.col("label").isin("Chunk", *CHILD_LABELS)).join(near, "node").select(F.col("parent").alias("node"), (F.col("score") * RELATED).alias("score"), F.col("node").alias("inherited_from"))
    every = own.unionByName(child).unionByName(other)
    return first_of(every, ["node"], [F.desc("score"), F.asc_nulls_first("inherited_from")]).orderBy(F.desc("score"), "node").limit(k)


def substitute_summaries(chunks: DataFrame, budget: int, group: str = "doc_id", order: str = "chunk_number") -> DataFrame:
    """Chunks ``text_tokens, summary_tokens, has_summary`` with ``use_summary`` and ``selected_tokens``.

    While a group is above the budget, its largest chunk with a summary gives way
    to the summary; ties in order. A chunk is replaced if the total is still above the
    budget before its turn, and was so at all turns before, since a summary may be longer.
    """
    turn = Window.partitionBy(group, "_can").orderBy(F.desc("text_tokens"), order)
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    upto = turn.rowsBetween(Window.unboundedPreceding, 0)
    out = chunks.withColumn("_can", F.col("has_summary") & (F.col("text_tokens") > 0))
    out = out.withColumn("_total", F.sum("text_tokens").over(Window.partitionBy(group)))
    out = out.withColumn("_left", F.col("_total") - F.coalesce(F.sum(F.col("text_tokens") - F.col("summary_tokens")).over(before), F.lit(0)))
    out = out.withColumn("use_summary", F.col("_can") & (F.min("_left").over(upto) > budget))
    return out.withColumn("selected_tokens", F.when(F.col("use_summary"), F.col("summary_tokens")).otherwise(F.col("text_tokens"))).drop("_can", "_total", "_left")


def document_context(chunks: DataFrame, group: str, order: str, text: str, kind: Column) -> DataFrame:
    """The texts of each group in order, each under a line with its number and kind; blank texts are left out."""
    part = F.concat(F.lit("--- Chunk "), F.col(order).cast("string"), F.lit(" ("), kind, F.lit(") ---\n"), F.col(text))
    rows = chunks.where(F.trim(text) != "").groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))).alias("_parts"))
    return rows.select(group, F.array_join(F.transform("_parts", lambda x: x["p"]), "\n\n").alias("context"))


def search_context(hits: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """One context for each group of hits, in order."""
    rows = hits.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.concat(F.lit("Content: "), F.col(text)).alias("p")))).alias("_parts"))
    return rows.select(group, F.concat(F.lit("=== CONTEXT INFORMATION ===\n"), F.array_join(F.transform("_parts", lambda x: x["p"]), "\n")).alias("context"))


def consume_until(hits: DataFrame, k: int, order: list[Column], group: str = "question", hit: str = "hit", chunk: str = "chunk") -> DataFrame:
    """Rows ``question, hit, chunk`` of the ranked hits that are read until ``k`` different chunks are there.

    Whole hits are read, so the last one may lead beyond ``k``. Each chunk comes once, at its first hit.
    """
    place = F.dense_rank().over(Window.partitionBy(group).orderBy(*order, hit))
    seen = F.row_number().over(Window.partitionBy(group, chunk).orderBy("_hit"))
    before = F.count("*").over(Window.partitionBy(group).orderBy("_hit").rangeBetween(Window.unboundedPreceding, -1))
    first = hits.withColumn("_hit", place).withColumn("_seen", seen).where("_seen = 1")
    return first.withColumn("_before", before).where(F.col("_before") < k).drop("_hit", "_seen", "_before")


#: Edge types that relate chunks.
RELATED_TYPES = ("NEXT", "PREVIOUS", "SIMILAR_TO", "RELATED_TO")


def related_chunks(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``node, parent``: the chunks of ``chunks(id)`` that an edge of ``RELATED_TYPES`` joins with a node, in either direction."""
    both = both_ways(edges.where(F.col("type").isin(*RELATED_TYPES)).select("src", "dst"))
    return both.select(F.col("src").alias("node"), F.col("dst").alias("parent")).join(chunks.select(F.col("id").alias("parent")), "parent", "left_semi").distinct()


def lift_scored(hits: DataFrame, parents: DataFrame, related: DataFrame, k: int = 10) -> DataFrame:
    """Hits ``node, label, semantic_score, keyword_score, content_bonus, combined_score`` lifted as by ``lift_hits``, with their parts rescored.

    A lifted hit has the type bonus of a chunk, and its semantic and combined scores at the reduced rate.
    """
    lifted = lift_hits(hits.select("node", "label", F.col("combined_score").alias("score")), parents, related, k)
    origin = F.coalesce("inherited_from", "node")
    parts = hits.select(F.col("node").alias("_origin"), "label", "semantic_score", "keyword_score", "content_bonus")
    out = lifted.withColumn("_origin", origin).join(parts, "_origin")
    rate = F.when(F.col("inherited_from").isNull(), 1.0).when(F.col("label").isin(*CHILD_LABELS), CHILD).otherwise(RELATED)
    return out.select("node", "inherited_from", (F.col("semantic_score") * rate).alias("semantic_score"), "keyword_score", F.lit(0.05).alias("type_bonus"), "content_bonus", F.col("score").alias("combined_score"))


def chunks_of(edges: DataFrame, nodes: DataFrame, targets: DataFrame, hops: int, links: DataFrame | None = None) -> DataFrame:
    """``target, chunk, hops`` of all chunks within so many undirected hops of ``targets(id)``.

    Walks in both directions find the same pairs, so the search starts at the side with fewer nodes, at
    the targets or at the chunks, and goes only where the other side can still be met. ``links`` as for ``reachable``.
    """
    chunks, targets = nodes.where("label = 'Chunk'").select("id"), targets.select("id").distinct()
    if targets.count() <= chunks.count():
        found = reachable(edges, targets.select(F.col("id").alias("seed")), hops, targets=chunks.select(F.col("id").alias("node")), links=links)
        return found.select(F.col("seed").alias("target"), F.col("node").alias("chunk"), "hops")
    found = reachable(edges, chunks.select(F.col("id").alias("seed")), hops, targets=targets.select(F.col("id").alias("node")), links=links)
    return found.select(F.col("node").alias("target"), F.col("seed").alias("chunk"), "hops")


def context_of_document(nodes: DataFrame, edges: DataFrame, document: str, budget: int = 900_000, hops: int = 10) -> DataFrame:
    """One row ``context, total_chunks, selected_chunks, used_summaries, total_tokens``: all chunks within ``hops`` of a document, in order.

    ``nodes`` hold ``id, label, chunk_number, text, summary``. Summaries take the
    place of the largest chunks until the budget of tokens holds. A document
    without chunks gives an empty context. The context is one text, as long as the budget allows.
    """
    seed = nodes.where(F.col("id") == document).select(F.col("id").alias("seed")).distinct()
    near = reachable(edges, seed, hops).where("hops > 0").select(F.col("node").alias("id")).distinct()
    text, summary = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "summary"))
    chunks = nodes.where("label = 'Chunk'").join(near, "id", "left_semi").select(
        F.lit(document).alias("doc_id"), "id", "chunk_number", text.alias("text"), summary.alias("summary"),
        token_count(text).alias("text_tokens"), token_count(summary).alias("summary_tokens"), (F.trim(summary) != "").alias("has_summary"),
    )
    chosen = substitute_summaries(chunks, budget, "doc_id", "id").withColumn("kind", F.when(F.col("use_summary"), "summary").otherwise("full_text"))
    chosen = chosen.withColumn("selected", F.when(F.col("use_summary"), F.col("summary")).otherwise(F.col("text")))
    part = F.concat(F.lit("--- Chunk "), F.col("chunk_number").cast("string"), F.lit(" ("), "kind", F.lit(") ---\n"), "selected")
    parts = F.array_sort(F.collect_list(F.when(F.trim("selected") != "", F.struct("chunk_number", "id", part.alias("p")))))
    return chosen.agg(
        F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("context"), F.count("*").alias("total_chunks"), F.count("*").alias("selected_chunks"),
        F.coalesce(F.bool_or("use_summary"), F.lit(False)).alias("used_summaries"), F.coalesce(F.sum("selected_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
    )


def profile_hits(nodes: DataFrame, edges: DataFrame, document: str, queries: DataFrame, k: int, hops: int = 9, chunk_hops: int = 6) -> DataFrame:
    """``question, hit, chunk, score`` of the chunks that profile questions find below a document.

    All vectors within ``hops`` of the document are ranked for each question of
    ``queries(question, embedding)``; a Description leads to the chunks within
    ``chunk_hops`` of it. Reach is computed once for all questions, over a graph without the branches
    that hold neither chunk nor vector, and questions meet vectors block by block. Vectors are ranked no deeper than it takes to find ``k`` chunks for every
    question: first ``DEPTH`` times ``k``, then ``DEPTH`` times as deep, and so on.
    """
    spark, store = nodes.sparkSession, Store(nodes.sparkSession, "profile")
    start = spark.createDataFrame([(document,)], nodes.select(F.col("id").alias("seed")).schema)
    asked = nodes.where("label in ('Chunk', 'Description')").select("id", "label", vector("embedding", "embeddings").alias("embedding"))
    asked = store.save(asked.where("label = 'Chunk' or embedding is not null"), "asked")
    links = trimmed(edges, asked.select("id").unionByName(start.select(F.col("seed").alias("id"))))
    found = reachable(edges, start, hops, links=links).select(F.col("node").alias("id")).distinct()
    near = store.save(asked.where("embedding is not null").join(found, "id"), "near")
    of_text = store.save(chunks_of(edges, nodes, near.where("label = 'Description'").select("id"), chunk_hops, links).select(F.col("target").alias("hit"), "chunk"), "of_text")
    labels, total, depth = near.select(F.col("id").alias("hit"), "label"), near.count(), DEPTH * k
    while True:
        scored = batch_topk(near, queries.select("question", "embedding"), min(depth, max(total, 1))).select("question", F.col("id").alias("hit"), F.col("similarity").alias("score")).join(labels, "hit")
        direct = scored.where("label = 'Chunk'").select("question", "hit", "score", F.col("hit").alias("chunk"))
        reached = store.save(direct.unionByName(scored.where("label = 'Description'").join(of_text, "hit").select("question", "hit", "score", "chunk")), f"reached{depth}")
        enough = reached.groupBy("question").agg(F.count_distinct("chunk").alias("n")).where(F.col("n") >= k).select("question")
        if depth >= total or queries.select("question").join(enough, "question", "left_anti").isEmpty():
            return consume_until(reached, k, [F.desc("score")])
        depth *= DEPTH


def profile_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``question, context``: the summaries of ``chunks(id, summary)`` that ``profile_hits`` found, best first, each after a newline."""
    rows = hits.join(chunks.select(F.col("id").alias("chunk"), F.coalesce("summary", F.lit("")).alias("summary")), "chunk")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "hit", "chunk", F.concat(F.lit("\n"), "summary").alias("p"))))
    return rows.groupBy("question").agg(F.array_join(F.transform(listed, lambda x: x["p"]), "").alias("context"))


def classify_labels(contexts: DataFrame, labels: DataFrame) -> DataFrame:
    """``category, label``: the label of ``labels(category, place, label, definition)`` that a context of ``contexts(category, context)`` speaks of most.

    The default scorer counts the different longer words that context and definition
    share; the first label of equals wins. A blank context, or one that shares no
    word with any definition, gives ``Unknown``.
    """
    long = lambda c: F.array_distinct(F.filter(words(F.lower(c)), lambda w: F.length(w) > 3))
    pairs = contexts.select("category", "context", long(F.coalesce("context", F.lit(""))).alias("_said")).join(labels, "category", "left")
    scored = pairs.withColumn("_score", F.size(F.array_intersect("_said", long(F.concat_ws(" ", "label", "definition")))))
    best = scored.groupBy("category").agg(F.max_by("label", F.struct("_score", -F.col("place"))).alias("label"), F.max("_score").alias("_score"))
    return best.select("category", F.when(F.col("_score") > 0, F.col("label")).otherwise("Unknown").alias("label"))


def definitions_for(definitions: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``definitions(category, label, definition)`` whose label the category of ``labels(category, label)`` has."""
    return definitions.join(labels.select("category", "label").distinct(), ["category", "label"], "left_semi")


def merge_definitions(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """Definitions after an import: imported ones take the place of those of the same category and label; blank ones are left out."""
    new = imported.where(F.trim("definition") != "").select(*existing.columns)
    return merge(existing, new, ["category", "label"], [F.desc("definition")])


def profile_run(nodes: DataFrame, edges: DataFrame, document: str, viewpoints: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """``category, label, n_chunks`` for each of ``viewpoints(category, embedding)``: retrieval, context and label of all categories in one pass."""
    hits = profile_hits(nodes, edges, document, viewpoints.select(F.col("category").alias("question"), "embedding"), k)
    contexts = profile_context(hits, nodes.where("label = 'Chunk'").select("id", "summary")).withColumnRenamed("question", "category")
    contexts = viewpoints.select("category").join(contexts, "category", "left")
    counts = hits.groupBy(F.col("question").alias("category")).agg(F.count_distinct("chunk").alias("n_chunks"))
    return classify_labels(contexts, labels).join(counts, "category", "left").select("category", "label", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def without_vector(questions: DataFrame, field: str) -> DataFrame:
    """The questions of ``questions(embeddings map<string, array<double>>, ...)`` whose vector of that name is absent or empty."""
    return questions.where(F.coalesce(F.size(F.try_element_at("embeddings", F.lit(field))), F.lit(0)) <= 0)


def with_vectors(questions: DataFrame, field: str, make) -> DataFrame:
    """The questions with a vector of that name each; ``make(question)`` gives the missing ones, and null where it cannot."""
    old = F.try_element_at("embeddings", F.lit(field))
    own = F.when(F.coalesce(F.size(old), F.lit(0)) > 0, old).otherwise(make(F.col("question")))
    added = F.when(own.isNotNull(), F.map_concat(F.map_filter("embeddings", lambda k, _: k != field), F.create_map(F.lit(field), own)))
    return questions.withColumn("embeddings", F.coalesce(added, F.col("embeddings")))


def ask_all(questions: DataFrame, nodes: DataFrame, field: str, make, k: int = 10, hybrid: bool = True, least: float = 0.1) -> DataFrame:
    """Answers to all of ``questions(question_index, question, embeddings)`` from ``nodes(id, label, text, embedding)``.

    Missing vectors are made first; if some cannot be made there are no answers at
    all. Each question's best nodes give its context, and the context its
    extractive answer. Columns: ``question_index, question, context, answer,
    answerable, related_context, embedding_field_used``.
    """
    ready = with_vectors(questions, field, make)
    if not without_vector(ready, field).isEmpty():
        return ready.limit(0).select("question_index", "question", F.lit("").alias("context"), F.lit("").alias("answer"), F.lit(False).alias("answerable"), F.lit("").alias("related_context"), F.lit(field).alias("embedding_field_used"))
    size = F.length(F.coalesce("text", F.lit("")))
    kind = F.when(F.col("label") == "Document", 0.1).when(F.col("label") == "Chunk", 0.05).otherwise(0.0)
    weighed = nodes.where("embedding is not null").withColumn("_bonus", kind + F.when(size < 50, -0.1).when(size > 500, 0.05).otherwise(0.0))
    asked = ready.select(F.col("question_index").alias("question"), F.element_at("embeddings", field).alias("embedding"))
    hits = batch_topk(weighed, asked, k, least, weight=SEMANTIC if hybrid else 1.0, bonus="_bonus" if hybrid else None)
    texts = hits.join(nodes.select("id", F.coalesce("text", F.lit("")).alias("text")), "id")
    contexts = search_context(texts, "question", "rank", "text").withColumnRenamed("question", "question_index")
    rows = ready.select("question_index", "question").join(contexts, "question_index", "left").withColumn("context", F.coalesce("context", F.lit("")))
    found = extractive_answer(F.col("question"), F.col("context"))
    return rows.select("question_index", "question", "context", found["answer"].alias("answer"), found["answerable"].alias("answerable"), found["related_context"].alias("related_context"), F.lit(field).alias("embedding_field_used"))


def search(nodes: DataFrame, query: list[float], keywords: list[str] | None = None, k: int = 10, least: float = 0.1, hybrid: bool = True) -> DataFrame:
    """``id, label, text, score, method`` of the best ``k`` nodes: by the hybrid score or, where that fails, by the cosine alone.

    The result is written at once, so that a failure shows here; a failure of the plain search is raised.
    """
    if not query:
        raise ValueError("a search needs the question's vector")
    store = Store(nodes.sparkSession, "search")
    columns = lambda df, score, method: df.select("id", "label", "text", F.col(score).alias("score"), F.lit(method).alias("method"))
    if hybrid:
        try:
            return store.save(columns(hybrid_topk(nodes, query, keywords, k, least), "combined_score", "hybrid"), "hybrid")
        except PySparkException as error:
            logging.getLogger(__name__).warning("plain search in place of the hybrid one: %s", error)
    return store.save(columns(semantic_topk(nodes, query, k, least), "similarity", "semantic"), "plain")


def ask_question(question: str, query: list[float], nodes: DataFrame, edges: DataFrame | None = None, document: str | None = None, keywords: list[str] | None = None, k: int = 10, hybrid: bool = True, least: float = 0.1) -> DataFrame:
    """One row ``question, context, answer, answerable, related_context, document_scope, method``: the answer from the whole graph or from what ``document`` contains.

    ``query`` is the question's vector. The best nodes, in the order of their scores, give the context. Without
    any, the context is empty, the question cannot be answered, and ``method`` is null.
    """
    chosen = nodes if document is None else scoped(nodes, edges, document)
    found = search(chosen, query, keywords, k, least, hybrid)
    hits = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumns({"question": F.lit(question), "text": F.coalesce("text", F.lit(""))})
    asked = nodes.sparkSession.createDataFrame([(question,)], "question string")
    rows = asked.join(search_context(hits, "question", "rank", "text"), "question", "left").join(hits.groupBy("question").agg(F.first("method").alias("method")), "question", "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit("")))
    reply = extractive_answer(F.col("question"), F.col("context"))
    return rows.select("question", "context", *[reply[c].alias(c) for c in ("answer", "answerable", "related_context")], F.lit(document or "global_graph").alias("document_scope"), "method")


def answer_metadata(answers: DataFrame, model: str, language: str, field: str, scope: str = "global_graph", stamp: Column | None = None) -> DataFrame:
    """The one row of metadata that goes with a file of answers."""
    counted = answer_summary(answers if "error" in answers.columns else answers.withColumn("error", F.lit(None).cast("string")))
    given = {"all_questions_have_embeddings": F.lit(True), "model_used": F.lit(model), "detected_language": F.lit(language), "embedding_field": F.lit(field), "document_scope": F.lit(scope)}
    return counted.withColumns(given | {"timestamp": iso_stamp(F.current_timestamp()) if stamp is None else stamp})


def run_summary(results: DataFrame) -> DataFrame:
    """One row over ``results(answerable, error, label)``: what a user is told after a run."""
    return results.agg(
        F.count_if(F.coalesce("answerable", F.lit(False))).alias("answerable"), F.count_if(F.col("error").isNull()).alias("successful"),
        F.bool_and(F.col("error").isNull()).alias("all_succeeded"), F.count_if(F.coalesce("label", F.lit("Unknown")) != "Unknown").alias("labelled"),
    )


def answer_summary(answers: DataFrame) -> DataFrame:
    """One row of counts over ``answers(answerable, error)``; an answer without error counts as successful."""
    return answers.agg(
        F.count("*").alias("total_questions"),
        F.count_if(F.col("error").isNull()).alias("successful_answers"),
        F.count_if(F.col("error").isNotNull()).alias("failed_answers"),
        F.count_if(F.coalesce("answerable", F.lit(False))).alias("answerable_questions"),
        F.count_if(~F.coalesce("answerable", F.lit(False))).alias("unanswerable_questions"),
    )


def chunk_statistics(chunks: DataFrame, tokens: str, limit: int) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"), F.min(tokens).alias("min_tokens"), F.max(tokens).alias("max_tokens"),
        F.round(F.avg(tokens), 6).alias("avg_tokens"), F.count_if(F.col(tokens) > limit).alias("oversized"),
    )


def nearest_texts(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """With ``before`` and ``after``: the nearest texts in the group that are not blank."""
    w = Window.partitionBy(group).orderBy(order)
    filled = F.nullif(F.trim(text), F.lit(""))
    before = F.last(filled, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(filled, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"before": before, "after": after})


def budget_context(rows: DataFrame, group: str, order: str, text: str, budget: int = 200) -> DataFrame:
    """``group, order, context_before, context_after`` of rows with text: the texts around, the nearest first to count, up to ``budget`` characters; the farthest is cut.

    Texts are gathered by the running number of characters, so a row holds no more
    than the texts within the budget.
    """
    w = Window.partitionBy(group).orderBy(order)
    filled = rows.where(F.length(text) > 0).select(group, order, F.col(text).alias("_text"))
    filled = filled.withColumn("_upto", F.sum(F.length("_text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    filled = filled.withColumn("_from", F.col("_upto") - F.length("_text"))
    near = F.collect_list("_text").over(Window.partitionBy(group).orderBy("_upto").rangeBetween(-(budget - 1), 0))
    far = F.collect_list("_text").over(Window.partitionBy(group).orderBy("_from").rangeBetween(0, budget - 1))
    listed = filled.withColumns({"_near": near, "_far": far})
    none = F.array().cast("array<string>")
    listed = listed.withColumns({"_before": F.coalesce(F.lag("_near").over(w), none), "_after": F.coalesce(F.lead("_far").over(w), none)})
    return listed.select(group, order, F.right(F.array_join("_before", ""), F.lit(budget)).alias("context_before"), F.left(F.array_join("_after", ""), F.lit(budget)).alias("context_after"))
