"""Queries over vector search, hit lifting, contexts, budgets, answering and profiling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.operators import models as m
from docweave.operators import retrieval as r
from docweave.operators import vectors as v
from docweave.operators.graph import first_of
from docweave.plans.tables import SEARCHABLE_SQL, read, searchable

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: The vector that single searches ask for.
ASKED = 0
KEYWORDS = ["the", "der"]


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _asked(spark, sf_dir) -> list[float]:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == ASKED).first()["embedding"]


_COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {ASKED}))"


@query(f"SELECT id, similarity FROM (SELECT vec_id AS id, {_COSINE} AS s, round({_COSINE}, 9) AS similarity FROM embeddings) WHERE s >= 0.1 ORDER BY s DESC, id LIMIT 10")
def semantic_topk(spark, sf_dir):
    nodes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.semantic_topk(nodes, _asked(spark, sf_dir), 10).select("id", F.round("similarity", 9).alias("similarity"))


@query(f"SELECT vec_id AS id, round({_COSINE}, 9) AS similarity FROM embeddings WHERE {_COSINE} >= 0.1")
def semantic_threshold(spark, sf_dir):
    """All nodes above the threshold."""
    nodes = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    literal = F.array(*[F.lit(float(x)) for x in _asked(spark, sf_dir)])
    return nodes.select("id", F.round(v.cosine(v.vector("embedding"), literal), 9).alias("similarity")).where("similarity >= 0.1")


def _hybrid_sql(hit: str, rest: str = "ORDER BY combined DESC, id LIMIT 10") -> str:
    return f"""WITH {SEARCHABLE_SQL}, parts AS (SELECT id, label, {_COSINE} AS semantic, CASE WHEN {hit} THEN 0.3 ELSE 0.0 END AS keyword_score,
  CASE label WHEN 'Document' THEN 0.1 WHEN 'Chunk' THEN 0.05 ELSE 0.0 END AS type_bonus, CASE WHEN length(coalesce(text, '')) < 50 THEN -0.1 WHEN length(coalesce(text, '')) > 500 THEN 0.05 ELSE 0.0 END AS content_bonus FROM searchable),
scored AS (SELECT *, semantic * 0.6 + keyword_score * 0.3 + type_bonus + content_bonus AS combined FROM parts)
SELECT id, label, round(semantic, 9) AS semantic_score, CAST(keyword_score AS DOUBLE) AS keyword_score, CAST(type_bonus AS DOUBLE) AS type_bonus, CAST(content_bonus AS DOUBLE) AS content_bonus, round(combined, 9) AS combined_score FROM scored WHERE combined >= 0.1 {rest}"""


_HIT = " OR ".join(f"contains(lower(coalesce({c}, '')), '{k}')" for c in ("text", "name", "description") for k in KEYWORDS)

def _parts(df):
    return df.select("id", "label", F.round("semantic_score", 9).alias("semantic_score"), "keyword_score", "type_bonus", "content_bonus", F.round("combined_score", 9).alias("combined_score"))


@query(_hybrid_sql(_HIT))
def hybrid_topk(spark, sf_dir):
    """Vector, keyword, type and length scores together."""
    return _parts(v.hybrid_topk(searchable(spark, sf_dir), _asked(spark, sf_dir), KEYWORDS))


@query(_hybrid_sql("false"))
def hybrid_topk_no_keywords(spark, sf_dir):
    return _parts(v.hybrid_topk(searchable(spark, sf_dir), _asked(spark, sf_dir)))


@query(_hybrid_sql(_HIT, ""))
def hybrid_scores(spark, sf_dir):
    """The scores of all nodes above the minimum."""
    return _parts(v.hybrid_scores(searchable(spark, sf_dir), _asked(spark, sf_dir), KEYWORDS).where("combined_score >= 0.1"))


@query(f"WITH {SEARCHABLE_SQL} SELECT id, round({_COSINE}, 9) AS similarity FROM searchable WHERE name = 'src3' AND {_COSINE} >= 0.1 ORDER BY {_COSINE} DESC, id LIMIT 10")
def scoped_topk(spark, sf_dir):
    """A search below one document: the scope filters before vectors are compared."""
    nodes = searchable(spark, sf_dir).where("name = 'src3'")
    return v.semantic_topk(nodes, _asked(spark, sf_dir), 10).select("id", F.round("similarity", 9).alias("similarity"))


_BATCH = """WITH scored AS (SELECT q.vec_id AS question, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM (SELECT * FROM embeddings WHERE label = 3) q, embeddings e)
SELECT question, id, round(s, 9) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY s DESC, id) AS rank FROM scored) WHERE rank <= 5"""


@query(_BATCH)
def batch_topk_per_question(spark, sf_dir):
    """Each question's five nearest nodes; the questions are the vectors of one label."""
    e = read(spark, sf_dir, "embeddings")
    questions = e.where("label = 3").select(F.col("vec_id").alias("question"), "embedding")
    return v.batch_topk(e.select(F.col("vec_id").alias("id"), "embedding"), questions, 5).select("question", "id", F.round("similarity", 9).alias("similarity"), "rank")


@query("""WITH hits AS (SELECT vec_id AS node, CASE WHEN label < 4 THEN 'Chunk' WHEN label < 8 THEN 'Entity' ELSE 'Feature' END AS label, vec_id % 100 AS score FROM embeddings),
parents AS (SELECT vec_id AS node, vec_id // 10 AS parent FROM embeddings), related AS (SELECT vec_id AS node, unnest([vec_id + 1, vec_id + 2, vec_id + 3, vec_id + 4]) AS parent FROM embeddings),
near AS (SELECT node, parent FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY parent) AS n FROM related) WHERE n <= 3),
lifted AS (SELECT node, CAST(score AS DOUBLE) AS score, NULL::BIGINT AS inherited_from FROM hits WHERE label = 'Chunk' UNION ALL SELECT p.parent, h.score * 0.9, h.node FROM hits h JOIN parents p USING (node) WHERE h.label = 'Entity'
  UNION ALL SELECT n.parent, h.score * 0.8, h.node FROM hits h JOIN near n USING (node) WHERE h.label = 'Feature')
SELECT node, round(score, 6) AS score, inherited_from FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, inherited_from NULLS FIRST) AS n FROM lifted) WHERE n = 1 ORDER BY score DESC, node LIMIT 25""")
def lift_hits(spark, sf_dir):
    """Hits move to their chunks and related chunks at reduced scores; each chunk stays once."""
    e = read(spark, sf_dir, "embeddings")
    hits = e.select(F.col("vec_id").alias("node"), F.when(F.col("label") < 4, "Chunk").when(F.col("label") < 8, "Entity").otherwise("Feature").alias("label"), (F.col("vec_id") % 100).cast("double").alias("score"))
    parents = e.select(F.col("vec_id").alias("node"), F.floor(F.col("vec_id") / 10).alias("parent"))
    related = e.select(F.col("vec_id").alias("node"), F.explode(F.array(*[F.col("vec_id") + k for k in (1, 2, 3, 4)])).alias("parent"))
    return r.lift_hits(hits, parents, related, 25).select("node", F.round("score", 6).alias("score"), "inherited_from")


@query("""WITH c AS (SELECT source AS doc, doc_id, length(text) // 4 AS text_tokens, length(text) // 11 AS summary_tokens, doc_id % 3 <> 0 AS has_summary FROM documents),
o AS (SELECT *, has_summary AND text_tokens > 0 AS can, sum(text_tokens) OVER (PARTITION BY doc) AS total FROM c),
l AS (SELECT *, total - coalesce(sum(text_tokens - summary_tokens) OVER (PARTITION BY doc, can ORDER BY text_tokens DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM o),
u AS (SELECT *, can AND min(l) OVER (PARTITION BY doc, can ORDER BY text_tokens DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 20000 AS use_summary FROM l)
SELECT doc, doc_id, use_summary, CASE WHEN use_summary THEN summary_tokens ELSE text_tokens END AS selected_tokens FROM u""")
def budget_substitution(spark, sf_dir):
    """Summaries take the place of the largest chunks until a budget holds."""
    n = F.length("text")
    chunks = read(spark, sf_dir, "documents").select(F.col("source").alias("doc"), "doc_id", F.floor(n / 4).alias("text_tokens"), F.floor(n / 11).alias("summary_tokens"), (F.col("doc_id") % 3 != 0).alias("has_summary"))
    return r.substitute_summaries(chunks, 20000, "doc", "doc_id").select("doc", "doc_id", "use_summary", "selected_tokens")


@query("SELECT conv_id, string_agg('--- Chunk ' || turn || ' (' || role || ') ---' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def doc_context(spark, sf_dir):
    return r.document_context(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", F.col("role"))


@query("SELECT conv_id, '=== CONTEXT INFORMATION ===' || chr(10) || string_agg('Content: ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def qa_context(spark, sf_dir):
    return r.search_context(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_REPLY = "CASE turn % 3 WHEN 0 THEN 'Answer: ' || text || chr(10) || '========' || chr(10) || 'Answerable: ' || CASE WHEN role = 'user' THEN 'Yes' ELSE 'no' END || chr(10) || '========' || chr(10) || 'Related Context: ' || role ELSE text END"
_CUT = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN {_CUT.format('text')} ELSE {_CUT.format('text')} END AS answer,
CASE WHEN turn % 3 = 0 THEN role = 'user' ELSE {_CUT.format('text')} <> '' END AS answerable, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS related_context FROM conversations""")
def answer_parse(spark, sf_dir):
    """Structured replies and plain ones."""
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Answer: "), "text", F.lit("\n========\nAnswerable: "), F.when(F.col("role") == "user", "Yes").otherwise("no"), F.lit("\n========\nRelated Context: "), "role")).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(F.array(t.parse_answer(reply))))


@query("SELECT lang, count(*) AS total_questions, count(*) FILTER (WHERE toxic IS NOT NULL) AS successful_answers, count(*) FILTER (WHERE toxic IS NULL) AS failed_answers, count(*) FILTER (WHERE coalesce(quality, 0) = 1) AS answerable_questions, count(*) FILTER (WHERE coalesce(quality, 0) <> 1) AS unanswerable_questions FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY lang")
def qa_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return r.answer_summary(rows.select((F.col("quality") == 1).alias("answerable"), F.when(F.col("toxic").isNull(), "none").alias("error"))).withColumn("lang", F.lit("en"))


@query("SELECT doc_id, quality FROM labels WHERE coalesce(quality = 1, false)")
def answerable_filter(spark, sf_dir):
    return read(spark, sf_dir, "labels").where(F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id", "quality")


@query("SELECT conv_id, turn, round(CASE WHEN role <> 'system' THEN least(0.9, length(text) / 1000 * 0.5 + length(role) / 500 * 0.4) ELSE 0 END, 9) AS confidence FROM conversations")
def confidence(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(t.confidence(F.col("role"), F.col("text"), F.col("role") != "system"), 9).alias("confidence"))


_LABELS = ["PROMO", "STANDARD", "MED", "Small item"]


def _label_sql(compat: bool) -> str:
    fit = "contains(said, lower(x)) OR contains(lower(x), said)" + (" OR said = 'unknown'" if compat else "")
    guard = "true" if compat else "said NOT IN ('', 'unknown')"
    return f"""WITH s AS (SELECT p_partkey AS id, CASE p_size % 10 WHEN 0 THEN 'unknown' WHEN 1 THEN '' ELSE lower(p_type) END AS said FROM part),
c AS (SELECT id, x, n FROM s, (SELECT unnest({_LABELS}) AS x, unnest(range({len(_LABELS)})) AS n) WHERE ({fit}) AND {guard})
SELECT s.id, coalesce(min_by(c.x, c.n), 'Unknown') AS label FROM s LEFT JOIN c ON c.id = s.id GROUP BY s.id"""


def _label(compat: bool):
    def run(spark, sf_dir):
        said = F.when(F.col("p_size") % 10 == 0, "unknown").when(F.col("p_size") % 10 == 1, "").otherwise(F.col("p_type"))
        return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.first_label(said, F.array(*map(F.lit, _LABELS)), compat).alias("label"))

    return run


QUERIES["label_first_match"], SQL["label_first_match"] = _label(False), _label_sql(False)
QUERIES["label_first_match_compat"], SQL["label_first_match_compat"] = _label(True), _label_sql(True)


@query("SELECT p_brand AS category, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS missing FROM part p WHERE p_type NOT IN (SELECT p_type FROM part q WHERE q.p_brand = p.p_brand AND q.p_size > 40) GROUP BY p_brand")
def label_missing_defs(spark, sf_dir):
    """Labels of each category that have no definition."""
    by = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("category")).agg(F.collect_set("p_type").alias("a"), F.collect_set(F.when(F.col("p_size") > 40, F.col("p_type"))).alias("b"))
    missing = F.array_sort(F.array_except("a", "b"))
    return by.where(F.size(missing) > 0).select("category", F.array_join(missing, ",").alias("missing"))


@query("SELECT lang AS language, n FROM (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS p FROM documents WHERE length(text) > 10 GROUP BY lang) WHERE p = 1")
def lang_mode(spark, sf_dir):
    """The most frequent language of longer texts."""
    counts = read(spark, sf_dir, "documents").where(F.length("text") > 10).groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "language").limit(1)


@query("""SELECT conv_id, turn, last_value(nullif(trim(text), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
first_value(nullif(trim(text), '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM conversations""")
def nearest_context(spark, sf_dir):
    return r.nearest_texts(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "before", "after")


@query("SELECT conv_id, turn, coalesce(right(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 200), '') AS context_before FROM conversations WHERE length(text) > 0")
def char_budget_context(spark, sf_dir):
    """The 200 characters before each turn."""
    return r.budget_context(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 200).drop("context_after")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 3")
def last_three(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return read(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id", "event_type")


@query("SELECT event_type, max_by(event_id, (ts, event_id)) AS newest, count(*) AS n FROM events GROUP BY event_type")
def newest_history(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"), F.count("*").alias("n"))


@query("SELECT source AS node, max(doc_id) AS id, max(n_chars) AS score FROM documents d WHERE n_chars = (SELECT max(n_chars) FROM documents x WHERE x.source = d.source) GROUP BY source")
def keep_best(spark, sf_dir):
    """The best-scored row of each node."""
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("node"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    return first_of(rows, ["node"], [F.desc("score"), F.desc("id")])


@query("""WITH scored AS (SELECT vec_id AS hit, label AS question, vec_id // 4 AS chunk, (vec_id * 7919) % 1000 AS score FROM embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, hit) AS p FROM scored),
firsts AS (SELECT question, chunk, min(p) AS p FROM ranked GROUP BY 1, 2), b AS (SELECT *, count(*) OVER (PARTITION BY question ORDER BY p) - 1 AS before FROM firsts)
SELECT b.question, r.hit, b.chunk FROM b JOIN ranked r ON r.question = b.question AND r.p = b.p WHERE before < 5""")
def consume_until(spark, sf_dir):
    """Ranked hits are read until five chunks are there."""
    hits = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hit"), F.col("label").alias("question"), F.floor(F.col("vec_id") / 4).alias("chunk"), ((F.col("vec_id") * 7919) % 1000).alias("score"))
    return r.consume_until(hits, 5, [F.desc("score")]).select("question", "hit", "chunk")


_DIGIT = "(instr('0123456789abcdef', substr(h, {}, 1)) - 1)"


@query(rf"""WITH w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[^\t\n\x0B\f\r ]+'))) AS h FROM documents),
p AS (SELECT doc_id, ({_DIGIT.format(1)} * 4096 + {_DIGIT.format(2)} * 256 + {_DIGIT.format(3)} * 16 + {_DIGIT.format(4)}) % 64 AS place, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, CAST(place AS INT) AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS value FROM p""")
def embed_documents(spark, sf_dir):
    """The default embedding of every document, component by component."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(m.embed(F.col("text"))).alias("place", "value"))
    return rows.where("value <> 0").select("doc_id", "place", F.round("value", 9).alias("value"))


@query()
def extractive_answers(spark, sf_dir):
    """An answer to each benchmark text from the document of the same number."""
    asked = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    rows = asked.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("context")), "item_id", "left")
    return rows.select("item_id", F.inline(F.array(m.extractive_answer(F.col("question"), F.col("context")))))
