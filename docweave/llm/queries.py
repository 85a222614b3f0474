"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from docweave.llm.best_fit import op1_best_fit_packing
from docweave.llm.disclosure import op7_disclosure
from docweave.llm.edit_fingerprints import op4_edit_fingerprints
from docweave.llm.exact_topk import op9_exact_topk
from docweave.llm.filter_audit import op13_filter_audit
from docweave.llm.lexical_search import op11_ranked_search
from docweave.llm.line_dedup import op3_line_dedup
from docweave.llm.lm_scoring import op8_lm_scoring
from docweave.llm.minhash import op10_minhash_near_dedup
from docweave.llm.mixing import op5_mix_sources
from docweave.llm.quality import op6_quality_classifier
from docweave.llm.suffix_dedup import op12_suffix_dedup
from docweave.llm.token_packing import op2_token_packing

_ALL = (
    op1_best_fit_packing, op2_token_packing, op3_line_dedup, op4_edit_fingerprints, op5_mix_sources, op6_quality_classifier, op7_disclosure, op8_lm_scoring, op9_exact_topk, op10_minhash_near_dedup,
    op11_ranked_search, op12_suffix_dedup, op13_filter_audit,
)

QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op3_line_dedup": """
WITH l AS (SELECT doc_id, CAST(unnest(range(len(x))) AS INT) AS place, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, place, trim(line) || chr(10) || lead(trim(line)) OVER o || chr(10) || lead(trim(line), 2) OVER o AS passage FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
r AS (SELECT *, row_number() OVER p AS nth, count(*) OVER (PARTITION BY passage) AS n FROM w WHERE passage IS NOT NULL AND length(replace(passage, chr(10), '')) > 0 WINDOW p AS (PARTITION BY passage ORDER BY doc_id, place)),
c AS (SELECT doc_id, nth > 1 AS later, unnest([place, place + 1, place + 2]) AS place FROM r WHERE n > 1),
g AS (SELECT doc_id, place FROM c GROUP BY ALL HAVING bool_or(later))
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(g.place) AS INT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS text
FROM l LEFT JOIN g USING (doc_id, place) GROUP BY doc_id""",
    "op9_exact_topk": """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_ranked_search": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS x FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(x)) AS BIGINT) AS n_terms FROM t WHERE len(x) > 0),
d AS (SELECT doc_id, 75 + (25 * len(x) * n_docs) // n_terms AS m FROM t, s WHERE len(x) > 0),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(x) AS term FROM t) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM r WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20""",
    "op12_suffix_dedup": """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, n, c, substr(x, 512 * c + 1, 1310) AS y FROM (SELECT *, unnest(range((n - 144) // 256)) AS c FROM d WHERE n >= 400)),
h AS MATERIALIZED (SELECT doc_id, 256 * c + i AS i, hash(substr(y, 2 * i + 1, 800)) AS h FROM (SELECT *, unnest(range(least(256, n - 399 - 256 * c))) AS i FROM p)),
r AS (SELECT doc_id, i FROM h JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT doc_id, i, sum(CAST(coalesce(i > p + 400, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r)),
c AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY ALL),
k AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM c GROUP BY doc_id),
e AS (SELECT doc_id, n, coalesce(len(a), 0) AS n_spans, CASE WHEN a IS NULL THEN x ELSE list_reduce([substr(x, 2 * z[1] + 1, 2 * (z[2] - z[1])) FOR z IN list_zip(list_prepend(0, b), list_append(a, n))], lambda y, z: y || z) END AS kept FROM (SELECT d.*, a, b FROM d LEFT JOIN k USING (doc_id)))
SELECT doc_id, n AS n_bytes, n - length(kept) // 2 AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM e""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS MATERIALIZED (SELECT doc_id, part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
v AS MATERIALIZED (SELECT part, x.subset, coalesce(sum(n) FILTER (WHERE mask & x.subset = 0), 0) AS n, coalesce(sum(good) FILTER (WHERE mask & x.subset = 0), 0) AS good, coalesce(sum(toxic) FILTER (WHERE mask & x.subset = 0), 0) AS toxic
  FROM c, (SELECT unnest(range(32)) AS subset) x GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
p AS MATERIALIZED (SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM o)),
y AS MATERIALIZED (SELECT part, list(n ORDER BY subset) AS n, list(good ORDER BY subset) AS good, list(toxic ORDER BY subset) AS toxic FROM v GROUP BY part),
r AS (SELECT part, filter_order, step, own, n[1 + before + own] AS kept, n[1 + before] - n[1 + before + own] AS removed, n[1] - n[1 + own] AS fails, n[32 - own] - n[32] AS unique_fails,
  good[1 + before] - good[1 + before + own] AS good_lost, toxic[1 + before] - toxic[1 + before + own] AS toxic_lost FROM y, p)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(fails - removed AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
