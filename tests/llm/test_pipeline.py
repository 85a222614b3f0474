"""The pipeline's stages against brute force, each on its own input."""

import collections

import pytest
from test_operators import brute_components, brute_lines, words

import __spark_entry__
import corpus_pipeline
from docweave.llm.common import Scratch, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    scratch, docs, out = Scratch(spark, "test"), documents(spark, sf_dir), {}
    out["input"] = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        out[name] = docs.toPandas()
    return out


def test_stage_names_and_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "mixing", "best_fit_packing"]
    assert all(list(stages[name].columns) == COLUMNS for name in names[:-1])


def test_quality_keeps_rows_as_they_are(stages):
    before, after = ({(r.doc_id, r.text) for r in stages[k].itertuples()} for k in ("input", "quality_classifier"))
    assert after <= before and 0.6 * len(before) < len(after) < len(before)


def test_lines(stages):
    rows = sorted((r.doc_id, r.text) for r in stages["quality_classifier"].itertuples())
    expected = {k: t for k, t in brute_lines(rows).items() if t.strip(" ") or t == dict(rows)[k]}
    assert {r.doc_id: r.text for r in stages["line_dedup"].itertuples()} == expected
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"].itertuples())


def test_near_dedup(stages):
    rows = sorted((r.doc_id, r.text) for r in stages["line_dedup"].itertuples())
    _, component = brute_components([t for _, t in rows], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.PERCENT)
    assert sorted(stages["near_dedup"].doc_id) == [i for k, (i, _) in enumerate(rows) if component[k] == k]


ROWS = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")


def odd_rows(spark):
    """Repeated and null ids, equal rows, null, empty and very long texts, ties."""
    texts = [(1, A), (5, A), (5, B), (7, C), (7, C), (None, A), (None, "n " + C.upper()), (None, "only here " * 3), (8, None), (8, None), (9, ""), (9, " \n"), (10, "w " * 200_000)]
    return spark.createDataFrame([(k, t, "en", None if k == 1 else f"s{(k or 0) % 3}", 0) for k, t in texts], ROWS)


def test_near_dedup_of_odd_rows(spark, sf_dir):
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, odd_rows(spark), sf_dir).collect()]
    expected = [(1, A), (5, B), (7, C), (None, "only here " * 3), (8, None), (8, None), (9, ""), (9, " \n"), (10, "w " * 200_000)]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_empty_tables_and_other_columns(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd_rows(spark)
    got = stage(spark, docs, sf_dir).toPandas()
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.count() == 0 and list(empty.columns) == list(got.columns)
    if name == "best_fit_packing":
        assert got.words.sum() == sum(len(words(r["text"])) for r in docs.collect())
        return
    assert list(got.columns) == COLUMNS
    before = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [(None if r.doc_id != r.doc_id else r.doc_id, r.text if isinstance(r.text, str) else None) for r in got.itertuples()]
    if name == "quality_classifier":  # labels of the table know some of the ids; texts without characters go
        assert not collections.Counter(rows) - before and all(t for _, t in rows)
    if name == "line_dedup":  # no text here has three lines
        assert collections.Counter(rows) == before
    if name == "mixing":
        assert set(rows) <= set(before)
    clash = docs.selectExpr("*", "'x' as size", "'y' as copies", "'z' as _key", "'w' as kept", "1 as words", "'v' as signature", "'u' as perplexity", "'t' as _row", "'s' as band")
    other = stage(spark, clash, sf_dir)
    assert other.columns == clash.columns
    kept = other.toPandas()
    assert len(kept) == len(got) and set(kept._8 if hasattr(kept, "_8") else kept["_key"]) <= {"z"} and set(kept["kept"]) <= {"w"}


def test_mixing(stages):
    before, after = stages["near_dedup"], stages["mixing"]
    copies = collections.Counter(after.doc_id)
    assert set(copies) <= set(before.doc_id) and max(copies.values()) <= 3
    size = {r.doc_id: len(words(r.text)) for r in before.itertuples()}
    total = sum(size.values())
    assert sum(size[k] * n for k, n in copies.items()) == pytest.approx(total, rel=0.1)


def test_packing(stages):
    bins, docs = stages["best_fit_packing"], stages["mixing"]
    assert bins.words.sum() == sum(len(words(t)) for t in docs.text)
    # The corpus can be rebuilt from the result: as many rows of each document, with its whole text.
    rebuilt = collections.Counter()
    for doc_id, rows in bins.groupby("doc_id"):
        rebuilt[doc_id, "".join(t for _, t in sorted({(r.piece, r.text) for r in rows.itertuples()}))] += len(rows) // rows.n_pieces.iloc[0]
    assert rebuilt == collections.Counter((r.doc_id, r.text) for r in docs.itertuples())
    for _, members in bins.groupby(["shard", "bin"]):
        assert members.words.sum() <= 2048 and not members.source.duplicated().any() and not members.doc_id.duplicated().any()


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = __spark_entry__.queries()["pipeline"](spark, sf_dir).toPandas()
    assert len(got) == len(stages["best_fit_packing"]) and got.words.sum() == stages["best_fit_packing"].words.sum()


def test_all_operators_are_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
