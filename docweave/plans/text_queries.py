"""Queries over the text functions and chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions import text as t
from docweave.operators import chunking as c
from docweave.plans.tables import HEADINGS_SQL, headings, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


#: Python's strip for texts whose white space is ASCII.
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("SELECT lang, count(*) AS n_docs, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang")
def token_count(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(t.token_count(F.col("text"))).alias("tokens"))


@query("SELECT count(*) AS chunks, CAST(min(length(text) // 4) AS INT) AS min_tokens, CAST(max(length(text) // 4) AS INT) AS max_tokens, round(avg(length(text) // 4), 6) AS avg_tokens, count(*) FILTER (WHERE length(text) // 4 > 650) AS oversized FROM documents")
def chunk_token_stats(spark, sf_dir):
    from docweave.operators.retrieval import chunk_statistics

    return chunk_statistics(docs(spark, sf_dir).select(t.token_count(F.col("text")).alias("tokens")), "tokens", c.LIMIT)


_SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(f"SELECT doc_id, CAST(unnest(range(len({_SENTENCES}))) AS INT) AS n, unnest({_SENTENCES}) AS sentence FROM documents")
def split_sentences(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(t.sentences(F.col("text"))).alias("n", "sentence"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS n_words, regexp_extract_all(text, '\S+')[1] AS first_word, CAST(length(text) AS INT) AS n_chars FROM documents")
def split_words(spark, sf_dir):
    found = t.words(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(found).alias("n_words"), F.try_element_at(found, F.lit(1)).alias("first_word"), F.length("text").alias("n_chars"))


_PACK = """WITH RECURSIVE pieces AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS n, unnest(p) AS piece FROM (SELECT doc_id, {split} AS p FROM documents)),
fold AS (SELECT doc_id, n, piece AS cur, 0 AS chunk_id FROM pieces WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, CASE WHEN length(f.cur || '{joint}' || p.piece) {measure} <= {limit} THEN f.cur || '{joint}' || p.piece ELSE p.piece END,
    CASE WHEN length(f.cur || '{joint}' || p.piece) {measure} <= {limit} THEN f.chunk_id ELSE f.chunk_id + 1 END FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.n = f.n + 1)
SELECT doc_id, chunk_id, max_by(cur, n) AS content FROM fold GROUP BY doc_id, chunk_id"""


def _packed(spark, sf_dir, pieces, limit, joint, measure=t.token_count):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(c.pack(pieces, limit, joint, measure)).alias("chunk_id", "content"))


@query(_PACK.format(split=r"string_split(text, chr(10))", joint="' || chr(10) || '", measure="// 4", limit=650))
def pack_lines_budget(spark, sf_dir):
    """Lines packed into chunks of 650 tokens."""
    return _packed(spark, sf_dir, F.split("text", "\n", -1), 650, "\n")


@query(_PACK.format(split=_SENTENCES, joint=" ", measure="// 4", limit=100))
def pack_sentences_budget(spark, sf_dir):
    return _packed(spark, sf_dir, t.sentences(F.col("text")), 100, " ")


@query(_PACK.format(split=r"string_split(text, chr(10))", joint="' || chr(10) || chr(10) || '", measure="", limit=2000))
def pack_chars_budget(spark, sf_dir):
    """Paragraphs packed by characters."""
    return _packed(spark, sf_dir, F.split("text", "\n", -1), 2000, "\n\n", F.length)


@query("SELECT doc_id, CAST(sum(words) AS BIGINT) AS n_words FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words FROM documents) GROUP BY doc_id")
def chunk_documents(spark, sf_dir):
    """All chunks of all documents, checked by their words: none is lost."""
    found = c.chunks(docs(spark, sf_dir), separator="\n")
    return found.groupBy("doc_id").agg(F.sum(F.size(t.words(F.col("content")))).cast("decimal(38,0)").cast("long").alias("n_words"))


@query()
def chunk_contents(spark, sf_dir):
    """The chunks themselves."""
    return c.chunks(docs(spark, sf_dir), separator="\n")


@query("SELECT doc_id, length(text) // 4 <= 650 AS whole FROM documents")
def whole_document_test(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", (t.token_count(F.col("text")) <= c.LIMIT).alias("whole"))


_LETTERS = r"length(regexp_replace(w, '[^\p{L}]', '', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)
_CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"


@query(rf"""WITH words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
good AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS n FROM words
  WHERE length(w) >= CASE WHEN regexp_matches(w, '{_CJK}') THEN 1 ELSE 2 END AND length(w) <= 20 AND NOT regexp_full_match(w, '\p{{N}}+') AND w NOT IN ({_STOP})
    AND {_LETTERS} / length(w) >= CASE WHEN length(w) <= 5 THEN 0.6 ELSE 0.4 END)
SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY w), '') AS keywords FROM documents d LEFT JOIN good g ON d.doc_id = g.doc_id AND g.n <= 10 GROUP BY d.doc_id""")
def keyword_extract(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(t.keywords(F.col("text")), " ").alias("keywords"))


@query(f"SELECT doc_id, regexp_matches(text, '{_CJK}') AS cjk FROM documents")
def cjk_flag(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.is_cjk(F.col("text")).alias("cjk"))


_CELL = "replace(replace(replace(replace(replace({}, chr(10), '<br>'), chr(13), ''), '|', '&#124;'), '*', '\\*'), '_', '\\_')"


@query(f"SELECT doc_id, {_CELL.format(_STRIP.format('text'))} AS cell FROM documents")
def cell_escape(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", t.cell(F.col("text")).alias("cell"))


@query("SELECT p_partkey AS id, '| ' || p_partkey || ' | ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' |' AS row, '| --- | --- | --- | --- |' AS separator FROM part")
def md_table_render(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), t.table_row([t.cell(F.col(x)) for x in ("p_partkey", "p_name", "p_brand", "p_size")]).alias("row"), t.table_separator(4).alias("separator"))


_PLAIN = r"regexp_replace(regexp_replace(url, '[^a-zA-Z0-9[:space:]()\[\]-]', '-', 'g'), '\s+', ' ', 'g')"
_SAFE = r"""regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '-', 'g'), '\s+', ' ', 'g')"""


@query(f"SELECT page_id, {_STRIP.format(_PLAIN)} AS plain, {_STRIP.format(_SAFE)} AS safe FROM pages")
def filename_norm(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.file_name_plain(F.col("url")).alias("plain"), t.file_name_safe(F.col("url")).alias("safe"))


_NAMES = "SELECT doc_id, lang || '/' || source || CASE doc_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.xls' ELSE '.xlsx' END AS path FROM documents"


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' ELSE 'excel' END AS file_type, split_part(path, '/', 2) AS base_name, split_part(split_part(path, '/', 2), '.', 1) AS stem, doc_id % 4 <> 2 AS allowed FROM ({_NAMES})")
def file_router(spark, sf_dir):
    """Type, name and admission of files by their paths."""
    kind = F.element_at(F.array(*map(F.lit, (".docx", ".pdf", ".xls", ".xlsx"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), "source", kind)
    return docs(spark, sf_dir).select("doc_id", t.file_type(path).alias("file_type"), t.base_name(path).alias("base_name"), t.stem(path).alias("stem"), t.is_allowed_upload(path, F.length("text")).alias("allowed"))


_LINES = "lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(rf"""WITH {_LINES}, s AS (SELECT doc_id, line_no, {_STRIP.format('line')} AS t FROM lines)
SELECT doc_id, line_no, CASE WHEN length(t) > 150 THEN 0 WHEN regexp_matches(t, '^[0-9]+$') THEN 0 WHEN regexp_matches(t, '(?i)^REQUEST FOR PROPOSAL') OR regexp_matches(t, '(?i)^SECTION\s+[IVX0-9]+') THEN 1
 WHEN regexp_matches(t, '^[A-Z]\.?\s+[A-Z]') OR t IN ('Introduction', 'Questions', 'Submission', 'Award', 'Note') THEN 2 WHEN regexp_matches(t, '^[0-9]+\.?\s+[A-Z]') THEN 3
 WHEN line_no = 0 AND length(t) < 80 THEN 4 ELSE 0 END AS level FROM s""")
def header_level(spark, sf_dir):
    """Heading levels of lines, the first line of a text counting as large and bold."""
    rows = c.lines(docs(spark, sf_dir))
    first = F.col("line_no") == 0
    return rows.select("doc_id", "line_no", t.heading_level(F.col("line"), F.when(first, 16).otherwise(11), first).alias("level"))


_PATHS = ", ".join(f"sum(CASE WHEN level < {k} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS s{k}" for k in range(1, 7))
_TITLES = ", ".join(f"last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, s{k} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h{k}" for k in range(1, 7))


@query(f"WITH {HEADINGS_SQL}, s AS (SELECT *, {_PATHS} FROM heads) SELECT doc_id, line_no, level, title, {_TITLES} FROM s")
def header_path(spark, sf_dir):
    """The headings in force at each heading of the pages."""
    return c.heading_paths(headings(spark, sf_dir))


@query(f"WITH {HEADINGS_SQL} SELECT doc_id, count(*) AS headings, min(level) AS highest, max(level) AS deepest, string_agg(title, ' > ' ORDER BY line_no) AS outline FROM heads GROUP BY doc_id")
def outline(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("line_no", "title")))
    rows = headings(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("headings"), F.min("level").alias("highest"), F.max("level").alias("deepest"), listed.alias("l"))
    return rows.select("doc_id", "headings", "highest", "deepest", F.array_join(F.transform("l", lambda x: x["title"]), " > ").alias("outline"))


def _markdown(spark, sf_dir):
    """Pages as Markdown: headings with marks, everything else without tags."""
    out = F.col("html")
    for k in range(1, 7):
        out = F.regexp_replace(out, rf"<h{k}[^>]*>", "\n" + "#" * k + " ")
    out = F.regexp_replace(out, r"</h[1-6]>|</p>|<br>", "\n")
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace(out, r"<[^>]*>", "").alias("text"))


@query()
def page_sections(spark, sf_dir):
    """Sections of all pages with their heading paths."""
    return c.sections(_markdown(spark, sf_dir))


@query()
def page_chunks(spark, sf_dir):
    """Sections packed into chunks."""
    return c.section_chunks(_markdown(spark, sf_dir), 120)


_UPTO = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_POINTS = rf"""stripped AS (SELECT doc_id, line_no, line, {_STRIP.format('line')} AS t, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS after, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines),
ahead AS (SELECT *, coalesce(first_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '[') AS soon2, coalesce(first_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '[') AS soon3 FROM stripped),
marked AS (SELECT *, contains(lower(t), 'contents') AS named, starts_with(t, '#') AS heads, t = '' AND NOT starts_with(soon2, '[') AS leaves FROM ahead),
tocs AS (SELECT *, coalesce(last_value(CASE WHEN named THEN true WHEN heads OR leaves THEN false END IGNORE NULLS) {_UPTO}, false) AS toc FROM marked),
opens AS (SELECT *, coalesce(last_value(CASE WHEN named OR heads OR leaves THEN false WHEN toc AND regexp_matches(t, '^\[[^\[\]]*$') THEN true WHEN toc AND (ends_with(t, ')') OR contains(t, '](')) THEN false END IGNORE NULLS) {_UPTO}, false) AS open FROM tocs),
points AS (SELECT *, after - length(line) - 1 AS before, CASE WHEN NOT toc AND line_no < last AND t = '' THEN 'paragraph_break' WHEN NOT toc AND heads THEN 'header' WHEN toc AND t = '' AND NOT open THEN CASE WHEN NOT starts_with(soon3, '[') THEN 'toc_end' END
   WHEN NOT toc AND regexp_matches(t, '^([-*+]|[0-9]+\.)\s') THEN 'list_item' WHEN NOT toc AND NOT open AND regexp_matches(t, '[.!?]$') THEN 'sentence_end' WHEN NOT toc AND NOT open AND ends_with(t, ':') THEN 'colon_end'
   WHEN NOT toc AND NOT open THEN 'line_break' WHEN toc AND NOT open THEN 'toc_safe_break' END AS kind FROM opens),
scored AS (SELECT doc_id, line_no, kind, CASE kind WHEN 'paragraph_break' THEN 100 WHEN 'toc_end' THEN 95 WHEN 'header' THEN 90 WHEN 'list_item' THEN 80 WHEN 'sentence_end' THEN 70 WHEN 'colon_end' THEN 60 WHEN 'line_break' THEN 30 ELSE 15 END AS priority,
   CAST(CASE WHEN kind IN ('header', 'list_item') THEN before ELSE after END AS BIGINT) AS position FROM points WHERE kind IS NOT NULL)"""


@query(f"WITH {_LINES}, {_POINTS} SELECT doc_id, line_no, position, kind, priority FROM scored")
def split_points(spark, sf_dir):
    return c.split_points(docs(spark, sf_dir))


@query(f"""WITH {_LINES}, {_POINTS}, long AS (SELECT doc_id, floor(length(text) * 487 / (length(text) // 4)) AS target FROM documents WHERE length(text) // 4 > 650),
near AS (SELECT s.doc_id, position, priority * (1 - abs(position - target) / target) AS score FROM scored s JOIN long l ON l.doc_id = s.doc_id WHERE position >= target * 0.3 AND position <= target * 1.5)
SELECT doc_id, position, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS n FROM near WHERE score > -1) WHERE n = 1""")
def best_splits(spark, sf_dir):
    """Where texts beyond the limit are best split."""
    return c.best_splits(docs(spark, sf_dir)).select("doc_id", "position", F.round("score", 6).alias("score"))


_TIDY = "replace(html, '![IMAGE_DESCRIPTION]:', '[IMAGE_DESCRIPTION]:')"
for _mark in (r"# Page \| [0-9]+", r"Page \| [0-9]+", r"===+ PAGE [0-9]+ ===+", r"--- PAGE [0-9]+ ---", r"Page [0-9]+"):
    _TIDY = f"regexp_replace({_TIDY}, '{_mark}', '', 'gi')"
_TIDY = rf"regexp_replace({_TIDY}, '\n{{3,}}', chr(10) || chr(10), 'g')"
for _old, _new in ((r"#\s+#\s+", "## "), (r"#\s+#\s+#\s+", "### "), (r"#\s+#\s+##\s+", "### "), *[("#" * k + r"\s+" + "#" * k + r"\s+", "#" * 2 * k + " ") for k in range(6, 0, -1)]):
    _TIDY = rf"regexp_replace({_TIDY}, '(?m)^{_old}', '{_new}', 'g')"


@query(f"SELECT page_id, {_STRIP.format(_TIDY)} AS markdown FROM pages")
def postprocess_md(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", t.tidy_markdown(F.col("html")).alias("markdown"))


@query(r"SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{' || chr(34) || 'k' || chr(34) || ':' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_fields(spark, sf_dir):
    """Parsed and written again; broken JSON gives null."""
    parsed = F.from_json(t.json_block(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))), "k BIGINT")
    return read(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("again"))


@query("SELECT event_id, 'event_' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 32) AS id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS at, printf('%.1f', value / 1024.0) || ' KB' AS size FROM events")
def make_ids(spark, sf_dir):
    """Deterministic ids, local times and sizes."""
    return read(spark, sf_dir, "events").select("event_id", t.make_id(F.lit("Event"), F.col("event_id").cast("string")).alias("id"), t.local_time(F.col("ts").cast("timestamp")).alias("at"), t.kilobytes(F.col("value")).alias("size"))


@query("""SELECT p_partkey AS id, CASE p_size % 4
 WHEN 0 THEN 'Table ''' || p_name || ''' containing columns: ' || p_brand WHEN 1 THEN 'An ' || lower(p_type) || ' record named ''' || p_name || ''''
 WHEN 2 THEN 'A supplies relationship connecting ' || p_brand || ' to ' || p_type ELSE 'A Part entity named ''' || p_name || ''' with brand: ' || p_brand || ', size: ' || p_size END AS description FROM part""")
def fallback_description(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("Table", "Item", "Relationship", "Part"))), (F.col("p_size") % 4 + 1).cast("int"))
    pairs = {0: {"columns": "p_brand"}, 1: {"item_type": "lower(p_type)"}, 2: {"relationship_type": "'supplies'", "source": "p_brand", "target": "p_type"}, 3: {"brand": "p_brand", "size": "cast(p_size as string)", "name": "p_name"}}
    maps = [F.create_map(*[x for k, v in p.items() for x in (F.lit(k), F.expr(v))]) for p in pairs.values()]
    chosen = F.when(F.col("p_size") % 4 == 0, maps[0]).when(F.col("p_size") % 4 == 1, maps[1]).when(F.col("p_size") % 4 == 2, maps[2]).otherwise(maps[3])
    return part.select(F.col("p_partkey").alias("id"), t.describe(kind, F.col("p_name"), chosen).alias("description"))


@query("SELECT p_partkey AS id, 'prop:brand=' || p_brand || ',prop:name=override,prop:size=' || p_size AS properties FROM part")
def map_properties(spark, sf_dir):
    """Prefixed, merged with the later map first in right, and without the key id."""
    base = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name"), F.lit("id"), F.lit("x"))
    over = F.create_map(F.lit("name"), F.lit("override"), F.lit("size"), F.col("p_size").cast("string"))
    final = F.map_filter(t.prefixed(t.merged(base, over)), lambda k, _: k != "prop:id")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.transform(F.array_sort(F.map_entries(final)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("properties"))


_LETTER = "chr(CAST(65 + ({}) AS INT))"


@query(f"SELECT id, CASE WHEN n < 26 THEN {_LETTER.format('n')} ELSE {_LETTER.format('(n - 26) // 26')} || {_LETTER.format('(n - 26) % 26')} END || p_size AS address FROM (SELECT p_partkey AS id, p_partkey % 702 AS n, p_size FROM part)")
def cell_address(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.cell_address(F.col("p_size"), F.col("p_partkey") % 702 + 1).alias("address"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS summary, base64(encode(substr(text, 1, 30))) AS head FROM documents")
def summaries(spark, sf_dir):
    """Fallback summaries, and text starts in base64."""
    return docs(spark, sf_dir).select("doc_id", t.preview(F.col("text")).alias("summary"), F.base64(F.substring("text", 1, 30).cast("binary")).alias("head"))


_MARKDOWN = "regexp_replace(regexp_replace({}, '</h[1-6]>|</p>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g')"
_HEADS = "html"
for _k in range(1, 7):
    _HEADS = f"regexp_replace({_HEADS}, '<h{_k}[^>]*>', chr(10) || '{'#' * _k} ', 'g')"
_LEVELS = ", ".join(f"last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, s{k} ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h{k}" for k in range(1, 7))
_ABOVE = ", ".join(f"sum(CASE WHEN level < {k} AND section > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section) AS s{k}" for k in range(1, 7))
_PREFIX = "[" + ", ".join(f"CASE WHEN h{k} <> '' THEN '{'#' * k} ' || h{k} END" for k in range(1, 7)) + "]"


@query(rf"""WITH p AS MATERIALIZED (SELECT page_id AS doc_id, {_MARKDOWN.format(_HEADS)} AS text FROM pages),
l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM p WHERE length(text) // 4 > 120)),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+') THEN length(regexp_extract(line, '^#+')) END AS level, trim(regexp_extract(line, '^#{{1,6}}\s+(.*)', 1)) AS title FROM l),
n AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM m),
s AS (SELECT doc_id, section, coalesce(max(level), 0) AS level, max(CASE WHEN level IS NOT NULL THEN title END) AS title, coalesce(list(line ORDER BY n) FILTER (WHERE level IS NULL), []) AS body FROM n GROUP BY ALL),
h AS (SELECT *, {_LEVELS} FROM (SELECT *, {_ABOVE} FROM s)),
x AS MATERIALIZED (SELECT doc_id, section, level, body, list_filter([h1, h2, h3, h4, h5, h6], lambda t: t IS NOT NULL) AS path, list_filter({_PREFIX}, lambda t: t IS NOT NULL) AS prefix FROM h),
r AS MATERIALIZED (SELECT *, array_to_string(list_concat(prefix, body), chr(10)) AS shown, len(prefix) + len(body) AS n_lines FROM x),
e AS MATERIALIZED (SELECT a.*, (SELECT coalesce(min(b.section), 1000000) FROM r b WHERE b.doc_id = a.doc_id AND b.section > a.section AND b.level <= a.level) AS until, (SELECT max(b.section) FROM r b WHERE b.doc_id = a.doc_id AND b.section < a.section AND b.level < a.level) AS parent FROM r a),
t AS MATERIALIZED (SELECT a.doc_id, a.section, string_agg(CASE WHEN b.n_lines > 0 THEN b.shown END, chr(10) ORDER BY b.section) AS text, count(*) = 1 AS leaf FROM e a JOIN r b ON b.doc_id = a.doc_id AND b.section >= a.section AND b.section < a.until GROUP BY ALL),
f AS MATERIALIZED (SELECT e.*, t.text, t.leaf, e.level > 0 AND length(t.text) // 4 <= 120 AS fits, coalesce(e.parent > 0 AND length(u.text) // 4 <= 120, false) AS within FROM e JOIN t USING (doc_id, section) LEFT JOIN t u ON u.doc_id = e.doc_id AND u.section = e.parent),
o AS (SELECT doc_id, section, path, CASE WHEN fits OR leaf THEN {_STRIP.format('text')} WHEN {_STRIP.format('array_to_string(body, chr(10))')} <> '' THEN array_to_string(prefix, chr(10) || chr(10)) || chr(10) || chr(10) || {_STRIP.format('array_to_string(body, chr(10))')} END AS content FROM f WHERE NOT within
  UNION ALL SELECT doc_id, 0, CAST([] AS VARCHAR[]), text FROM p WHERE length(text) // 4 <= 120)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INT) AS chunk_id, array_to_string(path, ' > ') AS path, content, CAST(length(content) // 4 AS INT) AS token_count FROM o WHERE {_STRIP.format('content')} <> ''""")
def header_chunks(spark, sf_dir):
    """All pages as Markdown, cut at headings as deep as the limit asks for, each section under its headings."""
    found = c.header_chunks(_markdown(spark, sf_dir), 120)
    return found.select("doc_id", "chunk_id", F.array_join("path", " > ").alias("path"), "content", "token_count")
