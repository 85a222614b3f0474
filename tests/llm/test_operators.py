"""Each operator against a brute-force version on awkward small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import best_fit, counting, disclosure, edit_fingerprints, exact_topk, line_dedup, lm_scoring, minhash, mixing, quality, token_packing
from docweave.llm.common import Scratch, iter_words
from docweave.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, block string, signature string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_of(texts, sources=("s1", "s2", None)):
    return [(k, t, "en", sources[k % len(sources)], len(t or ""), "x", "x", "x", "x") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdeéß中"), rng.integers(1, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary, n))
    out = [None, "", " \n\t ", "one", "One", "one two", "ONE two\x0bthree", "x" * 5000]
    base = sentence(120)
    for k in range(40):  # near copies of one text, from nearly equal to far apart
        w = base.split(" ")
        for at in rng.integers(0, 120, k // 2):
            w[at] = str(rng.choice(vocabulary))
        out.append(" ".join(w))
    out += [base] * 5 + [base.upper()] * 2
    out += ["\n".join(sentence(8) for _ in range(12)) for _ in range(20)] + [sentence(30_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = rows_of(texts)
    rows += [rows[9], rows[9], (None, "null id", "en", "s1", 7, "x", "x", "x", "x"), (3, "same id, other text", "de", "s2", 0, "x", "x", "x", "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def plain(spark, texts):
    """The same without repeated ids."""
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_are_those_of_words(texts):
    import pyarrow as pa

    known = {}
    for text, hashes in zip(texts, iter_words(pa.array(texts)), strict=True):
        found = words(text)
        assert len(found) == len(hashes)
        for word, value in zip(found, hashes.tolist(), strict=True):
            assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    parent = list(range(1100))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def brute_components(texts, n, percent):
    sets = []
    for text in texts:
        w = words(text)
        m = min(n, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return [len(s) for s in sets], [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_loses_no_link(plain, texts, n):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(plain, n, 80).collect()}
    sizes, expected = brute_components(texts, n, 80)
    assert [got[k]["n_shingles"] for k in range(len(texts))] == sizes
    assert [got[k]["component_id"] for k in range(len(texts))] == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_minhash_odd_rows(docs, none):
    got = minhash.near_duplicates(docs, 2, 80).collect()
    assert len(got) == docs.count()
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, False)]
    assert {r["component_id"] for r in got if r["doc_id"] == 9} == {8}
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_null_and_repeated_ids_do_not_multiply(spark, none):
    rng = np.random.default_rng(12)
    base = [str(x) for x in rng.integers(0, 900, 40)]
    rows = [(None, " ".join([*base[:-1], f"x{k}"]), "x") for k in range(600)] + [(None, " ".join(base), "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, signature string").withColumn("text_key", F.xxhash64("text"))
    scratch = Scratch(spark, "t")
    nodes = scratch.save(df.select(F.xxhash64("text").alias("set_id"), "doc_id", "text_key").distinct(), "nodes")
    assert minhash._sets_of(df, nodes, nodes.select("set_id"), 2).count() == 601
    plan = df.join(nodes.drop("doc_id"), "text_key")
    assert plan.count() == 650  # each row meets one node
    got = minhash.near_duplicates(df, 2, 80).collect()
    assert len(got) == 650 and {(r["component_id"], r["kept"]) for r in got} == {(None, False)}
    assert minhash.without_near_duplicates(df, 2, 80).count() == 1
    assert minhash.without_near_duplicates(none).columns == none.columns and minhash.without_near_duplicates(none).count() == 0


def test_minhash_blocks_lose_no_link(plain, texts, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 400)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(plain, 2, 80).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts, 2, 80)[1]


def test_best_fit_picks_the_tightest_compatible_bin():
    # bins end with 4, 2 and 1 units free; the item of 2 may not join the second, so it goes to the first
    assert best_fit.best_fit([(6, 1), (8, 2), (9, 4), (2, 2)], 10) == [(0, 0), (1, 0), (2, 0), (0, 6)]
    rng = np.random.default_rng(3)
    items = [(int(s), 1 << int(b)) for s, b in zip(rng.integers(0, 60, 400), rng.integers(0, 12, 400), strict=True)]
    free, bits = [], []
    for (size, own), (got, offset) in zip(items, best_fit.best_fit(items, 100), strict=True):
        fits = [(f, k) for k, f in enumerate(free) if f >= size and f > 0 and not bits[k] & own]
        if fits:
            assert free[got] == min(fits)[0] and got in [k for _, k in fits]
        else:
            assert got == len(free)
            free.append(100), bits.append(0)
        assert offset == 100 - free[got]
        free[got] -= size
        bits[got] |= own


def test_packing_is_lossless_and_free_of_conflicts(docs, none):
    got = best_fit.pack_documents(docs, capacity=500, shard_rows=20).toPandas()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["doc_id"]] += len(words(r["text"]))
    for doc_id, size in sizes.items():
        assert got[got.doc_id.isna() if doc_id is None else got.doc_id == doc_id].words.sum() == size
    for _, members in got.groupby(["shard", "bin"]):
        assert members.words.sum() == members.bin_words.iloc[0] <= 500
        assert not members.source.fillna("none").duplicated().any()
        assert not members.cluster.dropna().duplicated().any()
    assert best_fit.pack_documents(none).count() == 0


def test_packed_texts_are_whole(docs, none):
    packed = best_fit.with_texts(best_fit.pack_documents(docs, capacity=50, shard_rows=20), docs)
    got = packed.toPandas()
    texts = collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    whole = collections.Counter()
    for (_, _), rows in got.assign(k=got.doc_id.fillna(-1)).groupby(["k", got.cluster.fillna(0)]):
        copies = len(rows) // rows.n_pieces.iloc[0]
        one = "".join(t or "" for _, t in sorted({(r.piece, r.text) for r in rows.itertuples()}, key=lambda x: x[0]))
        whole[None if rows.k.iloc[0] == -1 else int(rows.k.iloc[0]), one] += copies
    assert whole == texts
    assert all(len(words(r.text)) == r.words for r in got.itertuples())
    assert best_fit.with_texts(best_fit.pack_documents(none), none).count() == 0


def test_segment_tree_finds_the_least_free_space():
    rng = np.random.default_rng(2)
    tree, held = token_packing.FreeSpace(50), []
    for step in range(800):
        if rng.random() < 0.6:
            free = int(rng.integers(0, 51))
            tree.add(free, step)
            held.append(free)
        else:
            least = int(rng.integers(0, 51))
            got = tree.take(least)
            best = min((f for f in held if f >= least), default=None)
            assert (got[0] if got else None) == best
            if got:
                held.remove(best)


def test_tokens_round_trip(plain, texts, none):
    packed = token_packing.pack_tokens(plain, row_tokens=256, group_tokens=3000).cache()
    got = {r["doc_id"]: r["text"] for r in token_packing.unpack(packed).collect()}
    assert got == {k: t for k, t in enumerate(texts) if t}
    for r in packed.collect():
        ids = np.frombuffer(r["input_ids"], "<u2")
        assert len(ids) == 256 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert (ids[r["n_tokens"] :] == token_packing.FILL).all() and r["position_resets"] == r["cu_seqlens"][:-1]
    assert token_packing.pack_tokens(none).count() == 0


def brute_lines(rows):
    seen = collections.defaultdict(list)
    for key, text in rows:
        lines = (text or "").split("\n")
        for k in range(len(lines) - 2):
            passage = tuple(x.strip(" ") for x in lines[k : k + 3])
            if any(passage):
                seen[passage].append((key, k))
    later = collections.defaultdict(set)
    for places in seen.values():
        for key, k in places[1:]:
            later[key] |= {k, k + 1, k + 2}
    return {key: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in later[key]) for key, text in rows}


def test_line_dedup(spark, none):
    passage = "p one\np two\np three\np four"
    texts = [f"a\n{passage}\nb", f"{passage}\nc\nd", f"x\ny\n {passage} \nz", "\n\n\n\n\n\n", None, "", "r\nr\nr\nr\nr\nr", "two\nlines", passage, "e\n" + passage.replace("two", "2")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    expected = brute_lines(list(enumerate(texts)))
    assert {k: r["text"] for k, r in got.items()} == expected
    assert got[1]["text"] == "c\nd" and got[3]["text"] == texts[3] and got[0]["n_removed"] == 0
    assert line_dedup.dedup_lines(none).count() == 0
    # A passage goes from the first of two copies, too, if an earlier text has it.
    texts = ["p\nq\nr", "a\nb\nc\np\nq\nr\nd\ne\nf", "a\nb\nc\np\nq\nr\nd\ne\nf"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert got == {0: texts[0], 1: "a\nb\nc\nd\ne\nf", 2: ""}


def test_line_dedup_repeated_rows_share_a_fate(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "other\na\nb\nc"), (None, "a\nb\nc")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(got.values()) == 4
    assert max(got.values()) == 2  # the two equal rows


def test_fingerprints_follow_the_edits(plain, texts, none):
    got = {r["doc_id"]: r for r in edit_fingerprints.edited_fingerprints(plain).collect()}
    walks = edit_fingerprints.Walks()
    for k, text in enumerate(texts):
        text, after = text or "", texts[k - 1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[k]["n_chars"] == len(text)
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["fingerprint"] == edit_fingerprints.to_string(walks.of(text))
        assert got[k]["edited_fingerprint"] == edit_fingerprints.to_string(walks.of(edited))
        assert got[k]["near_next"] == pytest.approx(walks.likeness(walks.of(text), walks.of(after)))
    assert edit_fingerprints.edited_fingerprints(none).count() == 0
    only = plain.where("doc_id = 20")
    assert edit_fingerprints.edited_fingerprints(only).first()["near_next"] == 1.0


def test_fingerprints_of_odd_rows(docs):
    got = edit_fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"] for r in got}
    assert None in by_id
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 9}) == 1


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghij "))
    base = "".join(rng.choice(letters, 4000))
    walks = edit_fingerprints.Walks()
    found = []
    for edits in (1, 40, 400):
        changed = list(base)
        for at in rng.integers(0, 4000, edits):
            changed[at] = str(rng.choice(["", "zz", "y"]))
        found.append(walks.likeness(walks.of(base), walks.of("".join(changed))))
    assert found[0] > 0.95 and found[0] > found[1] > found[2]
    assert walks.likeness(walks.of(base), walks.of("".join(rng.choice(letters, 4000)))) < 0.15
    for text in ("", "a", "ab" * 40, base):
        state = walks.of(text)
        back = edit_fingerprints.unpack(edit_fingerprints.pack(state))
        assert back[0] == state[0] and np.array_equal(back[1], state[1])


def plain_walk(text, walks):
    """The fingerprint by the definition: one character after the other, one place after the other."""
    j, symbols, shown = 0, [], []
    for c in map(ord, text):
        stays = walks.steps[(c * 2654435761 & 0xFFFFFFFF) >> 26][j % edit_fingerprints.PERIOD]
        shown += [c] * stays
        j += stays
    for place, salt in zip(walks.places.tolist(), walks.salts.tolist(), strict=True):
        if place < j:
            symbols.append(((shown[place] + 1) * salt & (1 << 64) - 1) >> 60)
    return j, symbols


def plain_likeness(walks, a, b):
    if a == b:
        return 1.0
    short, long = sorted((len(a[1]), len(b[1])))
    agree = sum(w for w, x, y in zip(walks.weights.tolist(), a[1], b[1], strict=False) if x == y) / max(sum(walks.weights[:long].tolist()), 1e-300)
    return min(1.0, max(0.0, (agree - 1 / 8) / (7 / 8))) if short else 0.0


def test_classes_of_near_copies_and_their_recall(spark, none, monkeypatch):
    monkeypatch.setattr(edit_fingerprints, "BLOCK", 5)
    rng = np.random.default_rng(14)
    letters = np.array(list("abcdefghij "))
    texts = [None, "", "a", "ab", "ab", "abcdefgh" * 3, "abcdefgh" * 3 + "x"]
    for family in range(12):
        base = "".join(rng.choice(letters, int(rng.integers(20, 3000))))
        texts.append(base)
        for _ in range(9):
            changed = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, max(2, len(base) // 60)))):
                changed[at] = str(rng.choice(["", "zz", "y"]))
            texts.append("".join(changed))
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(4)
    got = {r["doc_id"]: r for r in edit_fingerprints.edited_fingerprints(df).collect()}
    walks = edit_fingerprints.Walks()
    states = [plain_walk(t or "", walks) for t in texts]
    for k, text in enumerate(texts):
        text, after = text or "", texts[k - 1] or ""
        cut = len(text) // 3
        edited = plain_walk(text[: len(text) - cut] + after[:cut], walks)
        assert got[k]["fingerprint"] == f"{states[k][0]:x}." + "".join(f"{x:x}" for x in states[k][1])
        assert got[k]["near_edited"] == pytest.approx(plain_likeness(walks, states[k], edited))
        assert got[k]["near_next"] == pytest.approx(plain_likeness(walks, states[k], states[k - 1]))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if plain_likeness(walks, states[a], states[b]) >= edit_fingerprints.LEAST]
    assert len(pairs) > 150
    assert sum(got[a]["class_id"] == got[b]["class_id"] for a, b in pairs) >= 0.95 * len(pairs)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(b)] = find(a)
    joined = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if got[a]["class_id"] == got[b]["class_id"]}
    assert all(find(a) == find(b) for a, b in joined)  # classes hold nothing that links do not reach
    assert got[0]["class_id"] == got[1]["class_id"] != got[2]["class_id"]
    assert edit_fingerprints.near_copies(edit_fingerprints.fingerprints(none)).count() == 0


def test_ranges_split_one_id_by_its_texts(spark):
    rows = [(None if k % 3 else 7, f"text {k} of one id") for k in range(300)] + [(None, "same")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = edit_fingerprints.edited_fingerprints(df, least=None).collect()
    order = [r["text"] for r in edit_fingerprints._placed(df).orderBy("place", "tie").collect()]
    walks = edit_fingerprints.Walks()
    expected = []
    for k, text in enumerate(order):
        expected.append((len(text), edit_fingerprints.to_string(walks.of(text)), round(walks.likeness(walks.of(text), walks.of(order[k - 1])), 9)))
    assert sorted((r["n_chars"], r["fingerprint"], round(r["near_next"], 9)) for r in got) == sorted(expected)
    parts = edit_fingerprints._ranges(edit_fingerprints._placed(df), 16)(edit_fingerprints._placed(df)).groupBy("part").count().collect()
    assert len(parts) >= 10 and max(r["count"] for r in parts) <= 80


def test_mixing(docs, none):
    docs = docs.where("length(text) < 50000 or text is null")  # the longest text alone is more than its source's target
    got = mixing.mix_sources(docs).toPandas()
    assert list(got.columns) == ["doc_id", "text", "lang", "source", "n_chars", "kept", "block", "signature", "size", "source_size", "target", "copies", "taken"]
    assert (got["size"] == [len(words(t)) for t in got.text]).all() and (got.taken <= 3 * got["size"]).all()
    for source, part in got.groupby(got.source.fillna("")):
        assert part["size"].sum() == part.source_size.iloc[0]
        assert part.taken.sum() == pytest.approx(part.target.iloc[0], rel=0.2), source
    again = mixing.mix_sources(docs.repartition(3)).toPandas()
    key = ["doc_id", "text", "copies"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert mixing.mix_sources(none).count() == 0


def test_mixing_goes_on_past_a_document_that_does_not_fit(spark, docs):
    sizes = [("a", 100)] * 200 + [("a", 10_000)] + [("b", 300)] * 100
    df = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes)], "doc_id long, text string, source string").cache()
    for seed in (1, 2):
        got = mixing.mix_sources(df, (65, 935), seed=seed).toPandas()
        part = got[got.source == "a"]
        assert part.target.iloc[0] == pytest.approx(3900) and part.taken.sum() == 3900, seed
    got = mixing.mix_sources(docs).toPandas()  # with the long text, and repeated rows
    for source, part in got.groupby(got.source.fillna("")):
        assert abs(part.target.iloc[0] - part.taken.sum()) <= part["size"].max(), source


def brute_mix(rows, target, seed):
    """Copies of ``(doc_id, key, size, random number, octave)`` rows of one source, from the random numbers alone."""
    weight = {row[:2]: 2.0 ** (-row[4] * mixing.DAMPING) for row in rows}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3.0, level * weight[r[:2]]) * r[2] for r in rows) < target else (low, level)
    times = {r[:2]: 3.0 if target >= 3 * sum(x[2] for x in rows) else min(3.0, high * weight[r[:2]]) for r in rows}
    copies = {k: math.floor(t + 1e-9) for k, t in times.items()}
    gap = target - sum(copies[r[:2]] * r[2] for r in rows)
    odds = lambda p: p / (1 - p)
    order = sorted((odds(r[3]) / odds(times[r[:2]] - copies[r[:2]]), r[:2], r[2]) for r in rows if times[r[:2]] - copies[r[:2]] > 1e-9)
    left = []
    for _, key, size in order:
        if size <= gap + 1e-6:
            copies[key] += 1
            gap -= size
        else:
            left.append((key, size))
    for key, size in left:
        if size < 2 * gap:
            copies[key] += 1
            break
    return copies


def test_mixing_is_the_pareto_sample_of_the_random_numbers(spark):
    rng = np.random.default_rng(21)
    sizes = [("a", int(n)) for n in rng.integers(1, 900, 300)] + [("b", int(n)) for n in rng.integers(1, 60, 250)] + [("c", 5000), ("c", 40), ("c", 3)]
    df = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
    for seed, weights in ((1, (5, 2, 1)), (3, (65, 935, 1))):
        got = mixing.mix_sources(df, weights, seed=seed).withColumns({"key": F.xxhash64("text", F.lit(seed)), "octave": mixing.octave(F.col("size"))})
        got = got.withColumn("u", mixing.random_number("doc_id", "key", seed)).collect()
        for source in "abc":
            part = [r for r in got if r["source"] == source]
            expected = brute_mix([(r["doc_id"], r["key"], r["size"], r["u"], r["octave"]) for r in part], part[0]["target"], seed)
            assert {(r["doc_id"], r["key"]): r["copies"] for r in part} == expected, (seed, source)


def test_mixing_prefers_documents_by_their_chances(spark):
    rows = [(k, f"{k} " + "w " * (3 if k % 2 else 511), "a" if k < 4000 else "b") for k in range(4100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, (1, 1)).where("source = 'a'").groupBy(F.col("size") > 10).agg(F.avg("copies").alias("n")).collect()
    share = {r[0]: r["n"] for r in got}
    assert share[False] / share[True] == pytest.approx(2 ** (7 * mixing.DAMPING), rel=0.1)


@pytest.mark.parametrize("sizes", [[10, 1000, 10, 10, 10], [5], [0, 0], [7, 7, 7, 7, 7, 7, 7], [1, 100, 1, 1, 1, 50]])
def test_targets_fill_up_to_their_caps(spark, sizes):
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    free, fixed, total = set(range(len(sizes))), {}, sum(sizes)
    while free:
        share = {k: (total - sum(fixed.values())) * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            break
        fixed |= {k: 3 * sizes[k] for k in over}
        free -= set(over)
    expected = {k: fixed.get(k, share.get(k, 0)) for k in range(len(sizes))}
    df = spark.createDataFrame([(f"s{k}", s) for k, s in enumerate(sizes)], "source string, source_size long")
    got = {int(r["source"][1:]): r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(expected)


def test_classifier_keeps_prose_and_rejects_junk(spark, none):
    rng = np.random.default_rng(4)
    syllables = ["the", "and", "ing", "er", "tion", "an", "re", "es"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    prose = [" ".join(word() for _ in range(80)) + "." for _ in range(300)]
    junk = ["".join(rng.choice(list("#$%&*!|QXZ0123"), 300)) for _ in range(20)]
    texts = [*prose, *junk, None, ""]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)] + [(k, 0, 0) for k in range(300, 310)] + [(5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert sum(got[k]["kept"] for k in range(200, 300)) >= 95  # texts that the model never saw
    assert not any(got[k]["kept"] for k in range(300, 322))
    assert got[320]["perplexity"] is None and got[0]["size"] == "x"
    untrained = {r["doc_id"]: r["kept"] for r in quality.classify(df, labels.where("quality = 7")).collect()}
    assert untrained[0] and untrained[300] and not untrained[321]
    assert quality.classify(none, labels).count() == 0


def test_thresholds_come_from_all_trusted_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 60)
    rng = np.random.default_rng(11)
    rows = []
    for k in range(400):
        lang, letters = ("de", "opqrst ") if k % 5 == 0 else ("en", "abcdef ")
        rows.append((k, "".join(rng.choice(list(letters), 200)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).toPandas()
    for _, part in got.groupby("lang"):  # de has 80 trusted rows, about 12 of them in the sample
        assert part.threshold.nunique() == 1 and part.threshold.iloc[0] in set(part.perplexity)
        assert (~part.kept).sum() <= 0.02 * len(part)
    assert got.threshold.nunique() == 2
    slim = quality.classify(df, labels, columns=["doc_id"]).toPandas()
    assert list(slim.columns) == ["doc_id", "perplexity", "threshold", "kept"]
    assert dict(zip(slim.doc_id, slim.kept, strict=True)) == dict(zip(got.doc_id, got.kept, strict=True))


def brute_kneser_ney(texts, order):
    """The log10 probability of a text's bytes, by plain dictionaries."""
    pad = b"\n" * (order - 1)
    counts = {order: collections.Counter(tuple((pad + t)[k : k + order]) for t in texts for k in range(len(t)))}
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    off, total, left = {}, {}, {}
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4))
        y = n1 / max(1, n1 + 2 * n2)
        off[n] = [0.0, *(max(quality.LEAST_DISCOUNT, d) for d in (1 - 2 * y * n2 / max(1, n1), 2 - 3 * y * n3 / max(1, n2), 3 - 4 * y * n4 / max(1, n3)))]
        total[n], left[n] = collections.Counter(), collections.Counter()
        for gram, c in counts[n].items():
            total[n][gram[:-1]] += c
            left[n][gram[:-1]] += off[n][min(c, 3)]

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 256
        if not total[n][gram[:-1]]:
            return p(gram[1:])
        c = counts[n][gram]
        return ((c - off[n][min(c, 3)] if c else 0) + left[n][gram[:-1]] * p(gram[1:])) / total[n][gram[:-1]]

    return lambda text: sum(math.log10(p(tuple((pad + text)[k : k + order]))) for k in range(len(text)))


def test_classifier_equals_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_ROWS", 10)
    rng = np.random.default_rng(31)
    rows = []
    for k in range(60):
        lang = ("en", "de", None)[k % 3] if k < 54 else "fr"
        rows.append((k, "".join(rng.choice(list("abcdé \n" if k % 2 else "stuv "), rng.integers(1, 90))), lang))
    rows += [(60, None, "en"), (61, "", "en"), (3, "a repeated id, longer" * 9, "en"), rows[4], (None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 7 != 0), int(k % 11 == 0)) for k in range(62)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, order=3).collect()
    key = F.xxhash64("doc_id", F.lit(6))
    good = [k for k in range(62) if k % 7 and k % 11]
    of = {k: min(((len(t.encode()), t, lang) for j, t, lang in rows if j == k and t), default=None) for k in good}
    order = [r["doc_id"] for r in spark.createDataFrame([(k,) for k in good if of[k]], "doc_id long").orderBy(key, "doc_id").collect()]
    trained = [k for n, k in enumerate(order) if n % 3 != 2]
    score = brute_kneser_ney([of[k][1].encode() for k in trained], 3)
    perplexity = lambda t: 10 ** (-score(t.encode()) / len(t.encode()))
    held = [min(((lang is not None, lang or ""), perplexity(t)) for j, t, lang in rows if j == k) for k in order if k not in trained]

    def quantile(values):
        return sorted(values)[math.ceil(0.99 * len(values)) - 1]

    for r in got:
        if not r["text"]:
            assert r["perplexity"] is None and not r["kept"]
            continue
        assert r["perplexity"] == pytest.approx(perplexity(r["text"]), rel=1e-5)
        own = [v for (named, lang), v in held if named and lang == r["lang"]]
        threshold = quantile(own if len(own) >= 10 else [v for _, v in held])
        assert r["threshold"] == pytest.approx(threshold, rel=1e-5)
        assert r["kept"] == (r["perplexity"] <= r["threshold"])


def test_a_long_first_text_does_not_end_the_training(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_BYTES", 4000)
    rows = [(k, f"plain words of a text with number {k} and so on", "en") for k in range(60)] + [(60 + k, "words of a long text " * 60_000 if k == 0 else "#$%!" * 30, "en") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(61)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels, columns=["doc_id"]).collect()}
    assert not got[61] and not got[62] and sum(got[k] for k in range(60)) >= 57
    assert quality.training_rows([(1, 9), (2, 3), (3, 1), (4, 3), (5, 8)], 7) == [(2, 3), (4, 3)]
    assert quality.training_rows([(1, 9), (2, 30)], 7) == [(1, 9)] and quality.training_rows([], 7) == []
    only = quality.classify(docs.where("doc_id = 60"), labels, columns=["doc_id"]).first()
    assert only["perplexity"] is not None and only["kept"]


def test_kneser_ney_sums_to_one(spark):
    text = "abracadabra abra cadabra " * 5
    model = quality.train(Scratch(spark, "t"), spark.createDataFrame([(text,)], "text string"), 3)
    for history in (b"ab", b"zz", b"ra"):
        total = 0.0
        for last in range(256):
            data = np.frombuffer(history + bytes([last]), np.uint8)
            whole = quality.log_probabilities(model, data, np.array([0, 3]))[0]
            prefix = quality.log_probabilities(model, data[:2], np.array([0, 2]))[0]
            total += 10 ** (whole - prefix)
        assert total == pytest.approx(1, rel=1e-4)


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_base_spans(spark, none):
    rng = np.random.default_rng(6)
    parts = ["a@b.c", "@", ".", "1", "23", "256", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "  ", "-", "é", "中", "10.0.0.1", "x", "+", "(", "\n", "00000000000000", "_%"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 14))) for _ in range(400)] + [None, "", "a@b" * 500, "a.b@" + "c." * 3000 + "d", "1" * 3000, "1.1." * 3000]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r["doc_id"]: [(s["start"], s["kind_no"] - 1, s["end"], s["kind"]) for s in r["spans"] if s["kind"] != "term"] for r in disclosure.disclosures(df).collect()}
    assert got == {k: brute_spans(t or "") for k, t in enumerate(texts)}
    assert disclosure.disclosures(none).count() == 0


def brute_disclosures(rows, near_words=8):
    """Spans and sanitised texts of ``(id, text)`` rows, by plain counting."""
    blank = " \t\n\x0b\x0c\r"
    counts, together, per_entity, texts_of, held = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set), {}
    for _, text in rows:
        text = text or ""
        counts.update(words(text))
        spans = brute_spans(text)
        for _, _, _, kind in spans:
            held.setdefault(text, set()).add((kind,))
        for kind, pattern in KINDS.items():
            found = list(re.finditer(pattern, text))
            for n, m in enumerate(found):
                if (m.start(), m.end(), kind) not in {(s, e, k) for s, _, e, k in spans}:
                    continue
                held[text].add((kind, m[0]))
                left = text[found[n - 1].end() if n else 0 : m.start()]
                right = text[m.end() : found[n + 1].start() if n + 1 < len(found) else len(text)]
                before, after = WORD.findall(left)[::-1], WORD.findall(right)
                before = before[1:] if left and left[-1] not in blank else before
                after = after[1:] if right and right[0] not in blank else after
                for word in before[:near_words] + after[:near_words]:
                    if re.search(r"[^\W\d_]{2}", word) and not re.search(r"[0-9@+]", word):
                        for entity in ((kind,), (kind, m[0])):
                            key = entity, word.translate(LOWER)
                            together[key] += 1
                            texts_of[key].add(text)
                            per_entity[entity] += 1
    total = sum(counts.values())
    reveals = collections.defaultdict(set)
    for (entity, word), n in together.items():
        least, texts = (disclosure.SUPPORT, disclosure.SUPPORT_TEXTS) if len(entity) == 1 else (disclosure.VALUE_SUPPORT, disclosure.VALUE_TEXTS)
        content = -math.log2(per_entity[entity] / total)
        if n >= least and len(texts_of[entity, word]) >= texts and content:
            if (math.log2(min(n, counts[word]) / counts[word]) + content) / content >= disclosure.DISCLOSURE:
                reveals[word].add(entity)
    tags = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
    for k, text in rows:
        base = brute_spans(text or "")
        terms = [(m.start(), 4, m.end(), "term") for m in WORD.finditer(text or "") if reveals[m[0].translate(LOWER)] & held.get(text, set())]
        spans = sorted(base + [t for t in terms if not any(s <= t[2] and t[0] <= e for s, _, e, _ in base)])
        out, at = "", 0
        for start, _, end, kind in spans:
            if start >= at:
                out += text[at:start] + tags[kind]
            at = max(at, end)
        yield k, spans, text and out + text[at:]


def disclosure_rows():
    rng = np.random.default_rng(17)
    plain = [f"w{x}ord" if x % 9 == 0 else "word" + "abcdefghij"[x % 10] * (x // 10 + 1) for x in range(60)]
    some = lambda n: " ".join(rng.choice(plain, n))
    texts = [f"{some(9)} Kundennummerkontakt {some(2)} user{k}@mail.example.org and {some(12)}" for k in range(12)]
    texts += [f"{some(30)} {some(10)}" for _ in range(60)]
    texts += [f"Geheimwort {'x' * 70} ann@home.example {some(40)} Annabella Geheimwort,", f"{some(4)} Annabella ann@home.example {some(5)} Geheimwort", f"Annabella lives here {some(20)}", f"{some(5)} annabella: ann@home.example"]
    texts += [f"mailto:bob@x.example, 4111 1111 1111 1111 +1 (555) 010-9999 {some(3)}\nhost 10.0.0.{k} and 10.0.0.{k + 1}" for k in range(3)]
    texts += [None, "", "é" * 9 + " 中 a@b.c", "long " * 30_000 + "tail user3@mail.example.org Kundennummerkontakt " + "y" * 100_000]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[3])] * 3 + [(None, texts[4]), (None, texts[4]), (3, texts[72]), (None, None)]


def test_disclosures_equal_plain_counting(spark):
    rows = disclosure_rows()
    df = spark.createDataFrame([(k, t, "s", "x") for k, t in rows], "doc_id long, text string, spans string, found string").repartition(3)
    expected = sorted((repr(k), repr(t), [(s, e, kind) for s, _, e, kind in spans], repr(out)) for (k, spans, out), (_, t) in zip(brute_disclosures(rows), rows, strict=True))
    got = disclosure.disclosures(df).collect()
    assert sorted((repr(r["doc_id"]), repr(r["text"]), [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in got) == [x[:3] for x in expected]
    clean = disclosure.sanitise(df)
    assert clean.columns == ["doc_id", "text", "found", "spans"]
    assert sorted((repr(r["doc_id"]), repr(r["text"])) for r in clean.collect()) == sorted((x[0], x[3]) for x in expected)
    terms = {t[s:e] for (_, spans, _), (_, t) in zip(brute_disclosures(rows), rows, strict=True) for s, _, e, kind in spans if kind == "term"}
    assert {"Kundennummerkontakt", "Geheimwort"} <= terms  # also beyond a long word, and where it stands alone


def test_disclosure_query_digests(spark, tmp_path):
    rows = disclosure_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = disclosure.op7_disclosure(spark, str(tmp_path)).collect()
    expected = []
    for k, spans, out in brute_disclosures(rows):
        line = [f"{kind}:{s}:{e}" for s, _, e, kind in spans]
        base = [x for x in line if not x.startswith("term")]
        expected.append((repr(k), *[sum(x.startswith(kind) for x in line) for kind in KINDS], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(line), len(base), len(line) - len(base), repr(out)))
    assert sorted((repr(r[0]), *r[1:-1], repr(r["sanitised"])) for r in got) == sorted(expected)


def brute_automaton(tokens, trained, order, prior):
    """Each text's score by explicit states, arcs and failure arcs of all n-grams, and its base counts."""
    counts = collections.Counter(tuple(w[k : k + n]) for w in trained for n in range(1, order + 1) for k in range(len(w) - n + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1 and g != ("<s>",))
    v = sum(len(g) == 1 for g in counts) - (1 if ("<s>",) in counts else 0)
    states = {()} | {g for g in counts if len(g) < order}
    fail = {h: (h[1:], math.log10(prior / (counts[h] + prior))) for h in states if h}

    def p(h, w):
        return (counts[h + (w,)] + prior * p(h[1:], w)) / (counts[h] + prior) if h else (counts[w,] + 1) / (n + v + 1)

    arcs = {(g[:-1], g[-1]): math.log10(p(g[:-1], g[-1])) for g in counts if g[:-1] in states}
    for w in tokens:
        state, total, base = ("<s>",) if ("<s>",) in states and order > 1 else (), 0.0, 0.0
        for x in w[1:]:
            while state and (state, x) not in arcs:
                state, weight = fail[state][0], fail[state][1]
                total += weight
            total += arcs.get((state, x), math.log10(1 / (n + v + 1)))
            state = state + (x,)
            while state not in states:
                state = state[1:]
            base += math.log10((counts[x,] + 1) / (n + v + 1))
        yield len(w) - 1, sum(counts[x,] > 0 for x in w[1:]), n, round(base, 6), round(total, 6)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_those_of_an_automaton_in_dictionaries(docs, none, order, monkeypatch):
    monkeypatch.setattr(counting, "BLOCK_BYTES", 20_000)
    got = lm_scoring.score_documents(docs, order=order, prior=1.5).collect()
    rows = docs.collect()
    tokens = [["<s>", *words(r["text"]), "</s>"] for r in rows]
    held = [r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    found = brute_automaton(tokens, [w for w, h in zip(tokens, held, strict=True) if not h], order, 1.5)
    expected = [(repr(r["doc_id"]), h, *x) for r, h, x in zip(rows, held, found, strict=True)]
    assert sorted((repr(r["doc_id"]), *r[1:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == sorted(expected)
    if order == 3:
        assert lm_scoring.score_documents(none).count() == 0
        untrained = lm_scoring.score_documents(docs.where("doc_id < 12"), trained="false").collect()
        assert {r["train_tokens"] for r in untrained} == {0} and all(r["score"] == r["base_score"] == 0 for r in untrained)


def test_arcs_of_a_state_and_its_failure_arc_sum_to_one():
    import pyarrow as pa

    texts = pa.array(["a b a c", "a b b", "c a b a b", ""])
    grams = counting.Grams(texts, 3)
    known = []
    for level in range(3):
        places = np.flatnonzero(grams.valid[level])
        keys, first, back = np.unique(grams.keys[level][places], return_index=True, return_inverse=True)
        at = np.full(len(grams.keys[level]), -1)
        at[places] = back
        known.append((np.bincount(back), places[first], at))
    tokens = int(grams.token().sum())
    outcomes = tokens + len(known[0][0]) - 1 + 1.0
    model = lm_scoring.Automaton(grams, known, outcomes, 2.0)
    p = 10**model.weight
    first_arc = np.concatenate([[0], np.cumsum([len(k[0]) for k in known])])
    start = known[0][2][0]
    assert sum(p[: first_arc[1]]) - p[start] + 1 / outcomes == pytest.approx(1)  # with the unknown word, without the start
    for level in (1, 2):
        for state in range(len(known[level - 1][0])):
            own = [j for j, place in enumerate(known[level][1]) if known[level - 1][2][place - 1] == state]
            if own:
                at = model.first_state[level - 1] + state
                lower = sum(p[first_arc[level - 1] + known[level - 1][2][known[level][1][j]]] for j in own)
                assert sum(p[first_arc[level] + j] for j in own) + 10 ** model.fail_weight[at] * (1 - lower) == pytest.approx(1)


def brute_topk(rows, k, every):
    usable = [(n, i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, own in usable:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for m, i, v in usable if m != n)
            out += [(q, rank + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(9)
    vectors = [[float(x) for x in rng.choice([0.0, 0.1, -0.2, 0.7], 6)] for _ in range(120)]
    vectors[3], vectors[4], vectors[5], vectors[6] = None, [0.1, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5
    vectors[7], vectors[8], vectors[9], vectors[10], vectors[11], vectors[12] = [], [0.5, 0.5], [1e30] * 6, [-1.7e308] * 6, [1.7e308, 0.0], [1.6e308, 1e9]
    vectors[100] = [1e20, 1.0, -3e15]
    rows = list(enumerate(vectors)) + [(None, [0.1] * 6), (50, vectors[50]), (50, vectors[50]), (0, [0.7] * 6), (7, vectors[8]), (-50, [1e200, -1e200])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, rank string, q string")
    got = exact_topk.exact_topk(df, df.where("vec_id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, 5, 50)
    assert exact_topk.exact_topk(df.limit(0), df.limit(0)).count() == 0
    assert exact_topk.exact_topk(df.where("vec_id = 100"), df.where("vec_id = 100")).count() == 0


def test_topk_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(exact_topk, "LEAST_BLOCK", 20)
    rng = np.random.default_rng(10)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 5) / 256]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_topk.exact_topk(df, df.where("vec_id % 20 = 0"), 5).collect()))
    assert got == brute_topk(rows, 5, 20)
