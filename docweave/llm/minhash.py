"""MinHash near-duplicate detection (operator 10).

Universal hash minima of every document's word shingles, banding, signature
verification, confirmation on the full shingle sets, and connected components
by alternating large-star and small-star steps.

How it stays bounded:

* Documents with equal shingle sets become one node first, so a group of exact
  copies is a single row in everything that follows.
* A bucket of a band is never expanded into its pairs. Each member is paired
  with the bucket's leader, the node that meets most others. When the components
  of these confirmed links are known, only members of one leader's group that lie
  in *different* components are compared, block by block within tasks, so no link
  is lost, none inside a component is spelt out, and only links leave a task.
* Signatures only rule out pairs far below the threshold (by ``SLACK``, six
  standard errors); each surviving pair is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import WORD, Scratch, documents, iter_words, mix
from docweave.llm.components import components

#: Bands times rows is the number of hash minima; at a similarity of 0.8 all but one pair in ten million share a band.
BANDS, ROWS = 40, 5
#: By so much an estimated similarity may fall short of the threshold before the full sets are not looked at.
SLACK = 0.17
#: Nodes of a group, and shingles of their sets, on either side of a comparison in one task.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20

_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_LINK = np.uint64(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a document's ``n``-word shingles; a shorter document is one shingle."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1]
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * _LINK + words[k : len(words) - n + 1 + k]
    return np.unique(mix(out))


def set_key(found: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([found.sum() + np.uint64(len(found)) * _LINK], np.uint64)).view(np.int64)[0])


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of every universal hash function (multiply, add, keep the upper half) over a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(found), 2048):
        part = ((found[None, k : k + 2048] * _MULTIPLY[:, None] + _ADD[:, None]) >> np.uint64(32)).astype(np.uint32)
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _signatures(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, signatures, bands = [], [], [], []
            for words in iter_words(batch.column("text")):
                found = shingles(words, n_words)
                sizes.append(len(found))
                if not len(found):
                    ids.append(None), signatures.append(None), bands.append(None)
                    continue
                with np.errstate(over="ignore"):
                    least = minima(found)
                    key = np.zeros(BANDS, np.uint64)
                    for column in least.reshape(BANDS, ROWS).T:
                        key = mix(key * _LINK + column)
                    key = mix(key + np.arange(BANDS, dtype=np.uint64))
                ids.append(set_key(found))
                signatures.append((least & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "set_id", "signature", "bands"],
            )

    return run


def _sets(n_words: int):
    """The sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shingles(words, n_words).tobytes() for words in iter_words(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(out, pa.binary())], names=["set_id", "members"])

    return run


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _likely(threshold: float):
    """Keeps pairs whose signatures agree in nearly the threshold's share of positions or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sig_a", "sig_b"))
            same = (a == b).mean(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array((same - 1 / 256) / (1 - 1 / 256) >= threshold - SLACK))

    return run


def _confirmed(percent: int):
    """Keeps pairs whose full sets reach the threshold: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = _unpack(x.as_py()), _unpack(y.as_py())
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_shingles, component_id, kept``.

    Words are runs without ASCII white space, A-Z in lower case. A document's
    set holds its distinct ``n_words``-word shingles; a shorter document's whole
    sequence is its one shingle. Two documents are linked if
    ``100 * |A & B| >= percent * |A | B|``; ``component_id`` is the smallest
    doc_id that can be reached, ``kept`` says whether that is the row's own.

    Null or wordless texts have an empty set and are linked with nothing. Rows
    with a null doc_id take part, but do not name a component: their
    component_id is the smallest doc_id linked to them, or null, and they are
    not kept. Rows that repeat a doc_id are separate documents. Very long texts
    count whole; their sets cross the network only if a likely partner exists.
    Further columns are ignored; an empty table gives an empty result.
    """
    rows, of_set = _grouped(docs, n_words, percent)
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(of_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that stay when one row of each group of near duplicates does.

    Groups are the components of ``near_duplicates``. The row that stays has the
    smallest doc_id, null after all others; of rows with that doc_id the one whose
    text has the least hash, and of equal ones a single row, picked by a hash of its other columns
    (those that can be hashed). So rows that repeat a doc_id are told apart by their text, and
    rows with a null doc_id go like others. Null and wordless texts are in no
    group: all their rows stay. All columns are kept, whatever their names.
    """
    _, of_set = _grouped(docs, n_words, percent)
    first = of_set.select("first.*").distinct()
    key = {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_unnamed": F.col("doc_id").cast("long").isNull(), "_key": F.xxhash64(F.col("text").cast("string"))}
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString()]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in key.items()], F.xxhash64(*others).alias("_other"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_words"))
    # Equal rows become one before the shuffle, however many there are.
    once = keyed.where("_words").groupBy(*key).agg(F.min_by("_row", "_other").alias("_row"))
    stay = first.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("unnamed").alias("_unnamed"), F.col("text_key").alias("_key"))
    return once.join(stay.hint("merge"), list(key), "left_semi").select("_row.*").unionByName(keyed.where("not _words").select("_row.*"))


def _grouped(docs: DataFrame, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets, and for each set the first row of its component: ``set_id, first(unnamed, doc_id, text_key)``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows = scratch.save(docs.mapInArrow(_signatures(n_words), "doc_id long, text_key long, n_shingles long, set_id long, signature binary, bands array<long>"), "rows")

    # One node for each distinct set; one of its documents stands for its text.
    nodes = rows.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "n_shingles")).alias("one"))
    nodes = scratch.save(nodes.select("set_id", "one.*"), "nodes")
    chosen = rows.join(nodes.select("set_id", F.col("doc_id").alias("one_id"), F.col("text_key").alias("one_key")), "set_id").where("doc_id <=> one_id and text_key = one_key")
    signed = scratch.save(chosen.dropDuplicates(["set_id"]).select("set_id", "n_shingles", "signature", "bands"), "signed")

    buckets = signed.select("set_id", F.explode("bands").alias("band"))
    several = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.save(buckets.join(several, "band"), "shared")
    # The node that meets most others leads its bucket: of a family of copies that is one with few edits.
    weight = shared.groupBy("set_id").agg(F.sum("n").alias("weight"))
    led = shared.join(weight, "set_id").groupBy("band").agg(F.max(F.struct("weight", "set_id")).alias("best")).select("band", F.col("best.set_id").alias("leader"))
    groups = scratch.save(shared.join(led, "band").select("leader", "set_id").distinct(), "groups")
    tested = groups.where("set_id <> leader").select(F.least("set_id", "leader").alias("a"), F.greatest("set_id", "leader").alias("b")).distinct()
    tested = scratch.save(_likely_pairs(tested, signed, percent), "likely")
    needed = tested.select(F.col("a").alias("set_id")).unionByName(tested.select(F.col("b").alias("set_id")))
    sets = scratch.save(_sets_of(docs, nodes, needed, n_words), "sets")
    linked = _confirmed_pairs(sets, tested, percent)
    labels = scratch.save(components(scratch, linked.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")

    further = scratch.save(_links_between(scratch, docs, nodes, groups, labels, n_words, percent), "further")
    if not further.isEmpty():
        merged = components(scratch, further, "again").withColumnsRenamed({"node": "_node", "component": "_component"})
        whole = labels.select("node", "component").unionByName(merged.select(F.col("_node").alias("node"), F.col("_node").alias("component"))).dropDuplicates(["node"])
        labels = scratch.save(whole.join(merged, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_component", "component").alias("component")), "all_labels")

    named = nodes.join(labels, nodes.set_id == labels.node, "left").select("set_id", F.struct("unnamed", "doc_id", "text_key").alias("own"), F.coalesce("component", "set_id").alias("label"))
    named = scratch.save(named, "named")
    first = named.groupBy("label").agg(F.min("own").alias("first"))
    return rows, named.join(first, "label").select("set_id", "first")


def _likely_pairs(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    a, b = (signed.select(F.col("set_id").alias(c), F.col("signature").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    both = pairs.join(b, "b").join(a, "a").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely(percent / 100), "a long, b long")


def _sets_of(docs: DataFrame, nodes: DataFrame, needed: DataFrame, n_words: int) -> DataFrame:
    """``set_id, members``: the full sets of the nodes in ``needed(set_id)``. No other text is read into a set.

    A node's text is found by its hash and its doc_id, so rows that share a doc_id, or have none, do not multiply.
    """
    wanted = nodes.join(needed.distinct(), "set_id").select("set_id", F.col("doc_id").alias("one_id"), F.col("text_key").alias("one_key"))
    texts = docs.join(wanted, (F.col("text_key") == F.col("one_key")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select("set_id", "text")
    return texts.mapInArrow(_sets(n_words), "set_id long, members binary").dropDuplicates(["set_id"])


def _links_between(scratch: Scratch, docs: DataFrame, nodes: DataFrame, groups: DataFrame, labels: DataFrame, n_words: int, percent: int) -> DataFrame:
    """``u, v``: labels of components that some link between two members of one leader's group joins.

    Nodes that share a bucket are in its leader's group together. A group in which
    all nodes have one label is done. In the others every node outside the most
    frequent label is compared with every node of another label, on full sets, by
    counting common shingles over an inverted index. Groups are cut into blocks of
    about ``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles, whichever is less, and a
    pair only leaves its task as a link of two labels.
    """
    members = groups.join(labels, groups.set_id == labels.node, "left").select("leader", "set_id", F.coalesce("component", "set_id").alias("label"))
    members = members.join(nodes.select("set_id", "n_shingles"), "set_id")
    counts = members.groupBy("leader", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    mixed = counts.groupBy("leader").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("labels")).where("labels > 1 and n > 2")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES))
    mixed = mixed.select("leader", F.col("top.label").alias("main"), blocks(F.col("n"), F.col("size")).alias("y_blocks"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("x_blocks"))
    apart = scratch.save(members.join(mixed, "leader"), "apart")
    spread = lambda blocks: F.pmod(F.xxhash64("set_id"), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    xs = apart.where("label <> main").withColumns({"x": spread("x_blocks"), "y": every("y_blocks"), "asks": F.lit(True)})
    ys = apart.withColumns({"y": spread("y_blocks"), "x": every("x_blocks"), "asks": F.lit(False)})
    columns = ["leader", "x", "y", "asks", "set_id", "label"]
    sets = scratch.save(_sets_of(docs, nodes, apart.select("set_id"), n_words), "apart_sets")
    rows = xs.select(*columns).unionByName(ys.select(*columns)).join(sets, "set_id")

    def compare(table: pa.Table) -> pa.Table:
        rows = table.select(["asks", "label", "members"]).to_pylist()
        asking, others = [r for r in rows if r["asks"]], [r for r in rows if not r["asks"]]
        found = set()
        if asking and others:
            sets = [_unpack(r["members"]) for r in others]
            sizes, of = np.array([len(x) for x in sets]), np.array([r["label"] for r in others])
            keys = np.concatenate(sets)
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], np.repeat(np.arange(len(sets)), sizes)[order]
            for r in asking:
                own = _unpack(r["members"])
                left, right = np.searchsorted(keys, own, "left").tolist(), np.searchsorted(keys, own, "right").tolist()
                common = np.bincount(np.concatenate([owner[a:b] for a, b in zip(left, right, strict=True)]), minlength=len(sets))
                close = (100 * common >= percent * (sizes + len(own) - common)) & (of != r["label"])
                found.update((max(r["label"], x), min(r["label"], x)) for x in of[close].tolist())
        links = sorted(found)
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})

    return rows.groupBy("leader", "x", "y").applyInArrow(compare, "u long, v long").distinct()


def _confirmed_pairs(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    a, b = (sets.select(F.col("set_id").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, two-word shingles, similarity 0.8."""
    return near_duplicates(documents(spark, sf_dir), n_words=2, percent=80)
