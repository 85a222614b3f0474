"""Search, removal of repeated strings and filter audit against brute-force versions."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import filter_audit, lexical_search, suffix_dedup
from docweave.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, block string, score string, kept string, rank string, mask string, shard string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    """Null, empty and very long texts, ties, repeated rows, null and repeated ids."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdeéß中$ZQ"), rng.integers(1, 7))) for _ in range(120)]
    text = lambda n: " ".join(rng.choice(words, n))
    out = [(k, text(int(rng.integers(1, 90))), ("a", "b", None, "")[k % 4]) for k in range(120)]
    out += [(200, None, "a"), (201, "", "b"), (202, " \n\x0b", None), (203, text(40_000), "a"), (204, "x" * 9000, "b"), (205, "One-two ONE", "c")]
    out += [out[3], out[3], (None, out[5][1], "a"), (None, None, None), (7, "same id, other text", "a"), (300, out[9][1], "b"), (301, out[9][1], "a")]
    return out


def brute_search(rows, items, k):
    docs = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t, *_ in rows]
    docs = [(i, c, c.total()) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item_id, text in items:
        asked, scored = TERM.findall((text or "").translate(LOWER)), []
        for i, c, n in docs:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item_id, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "most", "k"), [(2048, 4 << 20, 20), (7, 4 << 20, 5), (3, 60, 200)])
def test_search_is_that_of_all_documents(spark, rows, monkeypatch, shard, most, k):
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "SET_BYTES", most)
    items = [(1, rows[3][1]), (2, rows[203 - 83][1] or "one"), (3, None), (4, "nothing like it"), (5, "one one TWO"), (None, rows[8][1]), (5, "one one TWO"), (6, rows[123][1][:400])]
    asked = spark.createDataFrame([(*x, "x", 1) for x in items], "item_id long, text string, doc_id string, q int")
    got = lexical_search.ranked_search(frame(spark, rows), asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(rows, items, k)


def test_search_of_empty_tables(spark, rows):
    none, asked = frame(spark, rows).where("false"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked_search(none, asked).count() == 0
    assert lexical_search.ranked_search(frame(spark, rows), asked.where("false")).count() == 0


def test_search_skips_documents_that_cannot_qualify():
    """A shard with a high threshold leaves out what only non-essential lists hold, and nothing else."""
    rng = np.random.default_rng(4)
    lists = {t: np.sort(rng.choice(500, int(rng.integers(1, 400)), replace=False)) for t in range(12)}
    row = {"doc_ids": list(range(500)), "sizes": rng.integers(5, 90, 500).tolist(), "terms": list(lists), "df": [len(x) for x in lists.values()]}
    row |= {"slots": np.concatenate(list(lists.values())).astype(np.int32).tobytes(), "tfs": rng.integers(1, 6, sum(row["df"])).astype(np.int64).tobytes()}
    shard = lexical_search.Shard(row, 500, sum(row["sizes"]))
    weighted = [(t, int(rng.integers(0, 3000))) for t in range(14)]
    full = np.zeros(500, np.int64)
    for t, w in weighted:
        if t in shard.lists:
            full[shard.lists[t][0]] += w * shard.lists[t][1]
    for k, threshold in itertools.product((1, 5, 600), (1, int(np.median(full)), int(full.max()), int(full.max()) + 1)):
        slots, scores = shard.best(weighted, k, threshold)
        assert (full[slots] == scores).all()
        expected = sorted((x for x in full.tolist() if x >= threshold), reverse=True)[:k]
        assert sorted(scores.tolist(), reverse=True)[: len(expected)] == expected


def brute_repeats(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + width] for x in raw for i in range(len(x) - width + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                gone[i : i + width] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        out.append((len(x), int(gone.sum()), [tuple(e) for e in edge.reshape(-1, 2).tolist()], bytes(b for b, g in zip(x, gone[:-1], strict=True) if not g)))
    return out


def repeated(df):
    return sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect())


@pytest.mark.parametrize(("width", "gram", "most", "step"), [(400, 100, 1024, 1 << 18), (40, 10, 1024, 1 << 18), (40, 10, 3, 256), (12, 12, 1, 64), (24, 6, 5, 512)])
def test_repeats_are_those_of_all_strings(spark, rows, monkeypatch, width, gram, most, step):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", step)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(width)
    shared = ["".join(rng.choice(list("ab é"), 300)) for _ in range(4)]
    more = [(1000 + k, "".join(rng.choice(list("abcdeé"), 50)) + shared[k % 4][k : 300 - k] + "".join(rng.choice(list("xyz"), 60)) + shared[(k + 1) % 4] * (k % 3), "a") for k in range(40)]
    table = [r for r in rows if r[0] != 203] + more
    got = repeated(suffix_dedup.remove_repeats(frame(spark, table), width, gram, most))
    assert got == sorted((repr(r[0]), *x) for r, x in zip(table, brute_repeats([r[1] for r in table], width), strict=True))


def test_repeats_of_empty_and_very_long_texts(spark, rows):
    assert suffix_dedup.remove_repeats(frame(spark, rows).where("false")).count() == 0
    rng = np.random.default_rng(1)
    passage, long = ("".join(rng.choice(list("abcdefgh"), n)) for n in (401, 900_000))
    table = [(1, long[:450_000] + passage + long[450_000:], "a"), (2, "q" + passage + "q", "a"), (3, passage[:399], "a"), (4, passage[1:], "a")]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, table)).collect()}
    assert {k: [tuple(s) for s in r["spans"]] for k, r in got.items()} == {1: [(450_000, 450_401)], 2: [(1, 402)], 3: [], 4: [(0, 400)]}
    assert got[1]["kept"] == long.encode() and got[2]["kept"] == b"qq"


def test_suffix_columns_give_the_longest_common_prefixes():
    """Orders and prefixes of every round, by way of the strings found at several widths."""
    rng = np.random.default_rng(3)
    for width in (3, 5, 9):
        low, high = -rng.integers(0, 6, 60), rng.integers(0, 4, 60)
        bodies = [rng.integers(0, 3, h - a + width).astype(np.uint8) for a, h in zip(low.tolist(), high.tolist(), strict=True)]
        begin = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]])
        found = suffix_dedup.repeats(np.concatenate(bodies), begin - low, low, high, width)
        seen = collections.Counter((a + i, b[i : i + width].tobytes()) for a, b in zip(low.tolist(), bodies, strict=True) for i in range(len(b) - width + 1))
        for a, b, flags in zip(low.tolist(), bodies, found, strict=True):
            assert flags.tolist() == [seen[a + i, b[i : i + width].tobytes()] > 1 for i in range(len(b) - width + 1)]


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(8)
    part = rng.integers(97, 101, 500).astype(np.uint8)
    for data in (part, np.concatenate([rng.integers(97, 101, 37).astype(np.uint8), part, part[:90]])):
        runs = suffix_dedup.Runs(data, np.ones(len(data) - 399, bool), 400, 100)
        shift = len(data) - 500 if len(data) == 500 else 37
        at = {int(s) - shift: (int(a) - int(s), int(k)) for low, high, a, k in zip(runs.low, runs.high, runs.anchor, runs.keys, strict=True) for s in range(low, high + 1)}
        if len(data) == 500:
            first = at
    assert all(at[s] == first[s] for s in range(101))


def test_equal_strings_have_equal_anchors_in_pieces_of_any_length(monkeypatch):
    """Hashes that differ in their low bits only: a long piece may not cut more of them than a short one."""
    whole = suffix_dedup.Sums.of
    monkeypatch.setattr(suffix_dedup.Sums, "of", lambda self, start, end: whole(self, start, end) >> np.uint64(52))
    data = np.random.default_rng(8).integers(97, 101, 5000).astype(np.uint8)
    found = []
    for part in (data[:500], data):
        runs = suffix_dedup.Runs(part, np.ones(len(part) - 399, bool), 400, 100)
        found.append([a - s for low, high, a in zip(runs.low.tolist(), runs.high.tolist(), runs.anchor.tolist(), strict=True) for s in range(low, high + 1)][:101])
    assert found[0] == found[1]


def test_query_of_repeats(spark, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_suffix_dedup"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_repeats([r["text"] for r in rows], 400)
    assert got == {r["doc_id"]: (n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, want, strict=True)}


def brute_audit(rows, labels):
    masks = []
    for i, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        own = [x for x in labels if x[0] == i and i is not None]
        masks.append((source or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {m[0] for m in masks}:
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                before = [m for m in masks if m[0] == part and f in m[1] and m not in left]
                left = [m for m in left if f not in m[1]]
                redundant = sum(m[0] == part and f in m[1] for m in masks) - len(gone)
                assert redundant >= 0 or before
                out[part, order, step] = [len(left), len(gone), redundant, sum(m[0] == part and m[1] == {f} for m in masks), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                shapley[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_is_that_of_applying_every_order(spark, rows):
    rows = [r for r in rows if r[0] != 203] + [(500 + k, "Aa " * (40 + k) + "$" * (k % 2), "b") for k in range(20)] + [(None, rows[5][1], "a")] * 2
    labels = [(r[0], k % 2, k % 3 % 2) for k, r in enumerate(rows)] + [(3, None, 1), (None, 1, 1), (9999, 1, 1)]
    named = spark.createDataFrame([(*x, "x", 5) for x in labels], "doc_id long, quality int, toxic int, part string, mask int")
    got = filter_audit.audit_filters(frame(spark, rows), named)
    assert {tuple(r)[:3]: list(r)[3:] for r in got.collect()} == brute_audit(rows, labels)
    assert got.count() == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.audit_filters(frame(spark, rows).where("false"), named).count() == 0
    assert filter_audit.audit_filters(frame(spark, rows), named.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("p", 0, True, None), ("p", 1, None, True), ("p", 3, True, False), ("p", None, None, None)], "part string, mask int, good boolean, toxic boolean")
    got = {tuple(r)[1:3]: tuple(r)[3:] for r in filter_audit.audit_masks(masks, "XY").collect()}
    assert got == {("XY", 1): (2, 2, 0, 1, 1, 1, 3), ("XY", 2): (2, 0, 1, 0, 0, 0, 1), ("YX", 1): (3, 1, 0, 0, 1, 0, 1), ("YX", 2): (2, 1, 1, 1, 0, 1, 3)}
    with pytest.raises(ValueError, match="letters"):
        filter_audit.audit_masks(masks, "XX")


def test_zeta_sums_over_subsets():
    counts = np.random.default_rng(2).integers(0, 9, (3, 2, 16))
    got = filter_audit.zeta(counts, 4)
    assert all((got[..., m] == counts[..., [s for s in range(16) if s & m == s]].sum(axis=-1)).all() for m in range(16))


def test_terms():
    assert lexical_search.terms_of("Ab1-É中 x_Y".encode()) == ["ab1".encode(), "É中".encode(), b"x", b"y"]
    assert list(lexical_search._texts(pa.array(["a", None]))) == [b"a", b""]


def test_token_rows_of_odd_documents_and_their_files(spark, tmp_path):
    from docweave.llm import token_packing as packing

    odd = spark.createDataFrame([(None, "one two"), (None, "one two"), (4, "same id"), (4, "other text"), (5, None), (6, "")], "doc_id long, text string").coalesce(1)
    packed = packing.pack_tokens(odd, row_tokens=64)
    packing.write_packed(packed, str(tmp_path / "rows"))
    read = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted(map(repr, read.collect())) == sorted(map(repr, packed.collect())) and read.schema["input_ids"].dataType.typeName() == "binary"
    ids = [i for r in read.collect() for i in r["doc_ids"]]
    assert collections.Counter(ids) == {None: 2, 4: 2}  # no row without tokens has a segment
    long = "q" + "z" * 200_000  # no blank to cut at
    whole = packing.pack_tokens(spark.createDataFrame([(9, long)], "doc_id long, text string"), row_tokens=512, group_tokens=4000)
    assert whole.agg(F.max("n_tokens")).first()[0] == 512
    assert packing.unpack(whole).first()["text"] == long
