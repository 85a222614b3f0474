"""Document fingerprints by randomised edit embedding (operator 4).

All texts walk over the same random bits: at output place ``j`` a text shows its
current character ``c``, and goes on to its next one if the shared bit
``R(j, c)`` is set. Two texts that differ by few edits fall back into step soon
after each edit, so the edit distance of the texts becomes a Hamming distance
of the walks (Chakraborty, Goldenberg and Koucky, 2016).

A fingerprint keeps the walk's length and, at shared random places, ``PER_OCTAVE``
in each power of two, a four-bit hash of the character shown. Hence fingerprints of
short and very long texts are comparable and grow with the logarithm of the length.

Near copies are found by bands: hashes of the symbols at a few sampled places. How
many places a band samples grows with the logarithm of the number of fingerprints, and
the number of bands with it, so that chance buckets stay small and the share of pairs
missed (``MISS`` at the least likeness) stays the same. Pairs are verified on the
whole fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import Scratch, bound_batches, documents, partitions, shuffle_files_deleted
from docweave.llm.components import components
from docweave.operators.store import temporary_tables

#: Classes of characters that share bits, and places after which the bits repeat.
CLASSES, PERIOD = 64, 1024
#: Sampled places in each octave of the walk.
PER_OCTAVE = 32
#: Share of places at which unrelated texts agree.
CHANCE = 1 / 8
#: Likeness of near copies, and the share of pairs of just that likeness that share no band.
LEAST, MISS = 0.8, 0.05
#: Fingerprints of a leader's group that are compared in one task, on either side.
BLOCK = 1000
_OCTAVES = 40
_CHUNK = 1 << 16


class Walks:
    """The shared random bits and places, and what they make of texts."""

    def __init__(self, seed: int = 4):
        rng = np.random.default_rng(seed)
        bits = rng.random((CLASSES, PERIOD)) < 0.5
        bits[:, -1] = True  # a walk goes on at least once in a period
        after = np.zeros((CLASSES, PERIOD), np.int64)
        run = np.ones(CLASSES, np.int64)
        for j in range(PERIOD - 1, -1, -1):
            run = np.where(bits[:, j], 1, run + 1)
            after[:, j] = run
        self.steps = after.tolist()
        first = PER_OCTAVE.bit_length() - 1
        octaves = [np.arange(PER_OCTAVE, dtype=np.int64)]
        for k in range(first, _OCTAVES):
            octaves.append(np.sort(rng.integers(1 << k, 1 << k + 1, PER_OCTAVE)) if k > first else np.arange(1 << k, 1 << k + 1))
        self.places = np.concatenate(octaves)
        self.weights = np.concatenate([np.ones(PER_OCTAVE), *[np.full(PER_OCTAVE, 2.0**k / PER_OCTAVE) for k in range(first, _OCTAVES)]])
        self.salts = rng.integers(0, 1 << 63, len(self.places), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.first = first
        self.total = np.concatenate([[0.0], np.cumsum(self.weights)])

    def extend(self, state: tuple[int, np.ndarray], points: np.ndarray) -> tuple[int, np.ndarray]:
        """The state (length, symbols) after further characters."""
        j, symbols = state
        found, steps, mask = [symbols], self.steps, PERIOD - 1
        for k in range(0, len(points), _CHUNK):
            part = points[k : k + _CHUNK]
            classes = ((part * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8).tobytes()
            start = j
            ends = np.array([j := j + steps[c][j & mask] for c in classes])
            low, high = np.searchsorted(self.places, (start, j))
            if high > low:
                shown = part[np.searchsorted(ends, self.places[low:high], "right")].astype(np.uint64)
                found.append((((shown + np.uint64(1)) * self.salts[low:high]) >> np.uint64(60)).astype(np.uint8))
        return j, np.concatenate(found)

    def of(self, text: str) -> tuple[int, np.ndarray]:
        return self.extend((0, np.zeros(0, np.uint8)), code_points(text))

    def likeness(self, a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
        """Estimated share of the longer walk in which both agree, 0 to 1; 1 for equal fingerprints."""
        short, long = sorted((len(a[1]), len(b[1])))
        if a[0] == b[0] and np.array_equal(a[1], b[1]):
            return 1.0
        if not short:
            return 0.0
        agree = self.weights[:short][a[1][:short] == b[1][:short]].sum() / self.weights[:long].sum()
        return float(min(1.0, max(0.0, (agree - CHANCE) / (1 - CHANCE))))

    def likeness_to_all(self, one: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``likeness`` of one row of symbols to many, which stand in a matrix filled up with 255."""
        n = min(len(one), others.shape[1])
        agree = (others[:, :n] == one[:n]) @ self.weights[:n] / np.maximum(self.total[np.maximum(sizes, len(one))], 1e-300)
        return np.clip((agree - CHANCE) / (1 - CHANCE), 0.0, 1.0)


    def likeness_of_pairs(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """``likeness`` of two different rows of symbols, for many pairs at once."""
        sizes = np.maximum([len(x) for x in left], [len(x) for x in right])
        a, b = (np.full((len(rows), int(sizes.max(initial=0))), fill, np.uint8) for rows, fill in ((left, 255), (right, 254)))
        for matrix, rows in ((a, left), (b, right)):
            for k, symbols in enumerate(rows):
                matrix[k, : len(symbols)] = symbols
        agree = (a == b) @ self.weights[: a.shape[1]] / np.maximum(self.total[sizes], 1e-300)
        return np.clip((agree - CHANCE) / (1 - CHANCE), 0.0, 1.0)


def band_plan(n: int) -> tuple[int, int]:
    """How many places a band samples and how many bands there are, for ``n`` fingerprints."""
    size = max(4, math.ceil(math.log(max(n, 2)) / math.log(1 / CHANCE)) + 1)
    meets = (LEAST * (1 - CHANCE) + CHANCE) ** size
    return size, math.ceil(math.log(MISS) / math.log(1 - meets))


class Bands:
    """Sampled places of the first so many symbols, in proportion to their weights."""

    def __init__(self, walks: Walks, size: int, bands: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ends = [1 << k for k in range(walks.first)] + [PER_OCTAVE * (k + 1) for k in range(_OCTAVES - walks.first + 1)]
        self.places = [rng.choice(n, (bands, size), p=walks.weights[:n] / walks.weights[:n].sum()) for n in self.ends]
        self.total = walks.total

    def keys(self, symbols: np.ndarray) -> list[int]:
        """Hashes of a walk's bands: those up to the last end that it reaches, and up to the one before if a near copy may stop short of the last."""
        out, n = [], len(symbols)
        top = int(np.searchsorted(self.ends, n, "right")) - 1
        for k in (top, top - 1):
            if k >= 0 and (k == top or self.total[self.ends[top]] >= (LEAST * (1 - CHANCE) + CHANCE) * self.total[n]):
                for b, at in enumerate(self.places[k]):
                    out.append(int.from_bytes(hashlib.blake2b(bytes([k, b]) + symbols[at].tobytes(), digest_size=8).digest(), "little", signed=True))
        return out


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def to_string(state: tuple[int, np.ndarray]) -> str:
    return f"{state[0]:x}." + _HEX[state[1]].tobytes().decode()


def from_string(fingerprint: str) -> tuple[int, np.ndarray]:
    length, _, symbols = fingerprint.partition(".")
    digits = np.frombuffer(symbols.encode(), np.uint8)
    return int(length, 16), np.where(digits >= 97, digits - 87, digits - 48).astype(np.uint8)


def pack(state: tuple[int, np.ndarray]) -> bytes:
    """A fingerprint in half the bytes of its symbols."""
    symbols = np.append(state[1], np.zeros(len(state[1]) % 2, np.uint8))
    return state[0].to_bytes(8, "little") + len(state[1]).to_bytes(2, "little") + (symbols[::2] << 4 | symbols[1::2]).tobytes()


def unpack(raw: bytes) -> tuple[int, np.ndarray]:
    pairs = np.frombuffer(raw, np.uint8, offset=10)
    return int.from_bytes(raw[:8], "little"), np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[: int.from_bytes(raw[8:10], "little")]


def fingerprints(docs: DataFrame, *kept: str, heads: bool = False) -> DataFrame:
    """``node, print`` and the columns ``kept`` of every row of ``docs(text, ...)``.

    ``print`` is the packed fingerprint and ``node`` a hash of it; with ``heads``, ``head`` is the
    state of the walk before the last third of the characters, from which edited texts go on. Null texts count as
    empty; equal texts have equal fingerprints.
    """
    bound_batches(docs.sparkSession)
    chosen = docs.select(*kept, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks()
        empty = (0, np.zeros(0, np.uint8))
        for batch in batches:
            prints, before = [], []
            for text in batch.column("text").to_pylist():
                points = code_points(text or "")
                cut = len(points) - len(points) // 3
                head = walks.extend(empty, points[:cut])
                before.append(pack(head) if heads else None)
                prints.append(pack(walks.extend(head, points[cut:])))
            nodes = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) for p in prints]
            columns = {c: batch.column(c) for c in kept} | {"node": pa.array(nodes, pa.int64()), "print": pa.array(prints, pa.binary())} | ({"head": pa.array(before, pa.binary())} if heads else {})
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = "".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}, " for c in kept)
    return chosen.mapInArrow(run, f"{kinds}node long, print binary{', head binary' if heads else ''}")


def near_copies(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """``node, class_id`` for rows of ``fingerprints()``: bit-sampled banding, then verification.

    Equal fingerprints are one node. Every node of a bucket is held against the
    bucket's least one, its leader, and linked if their likeness reaches ``least``. Then
    nodes of one leader's group that lie in different classes are compared block by
    block within tasks, so no link between nodes that share a bucket is lost and none is
    spelt out. ``class_id`` is the least node that links reach. A pair of just the least
    likeness misses all buckets with a chance of ``MISS``, closer ones far more rarely. Empty
    texts are one node, in a class of its own.
    """
    scratch = Scratch(prints.sparkSession, "editprints")
    nodes = scratch.save(prints.groupBy("node").agg(F.first("print").alias("print")), "nodes")
    size, bands = band_plan(nodes.count())

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Bands(Walks(), size, bands)
        for batch in batches:
            keys = [plan.keys(unpack(p)[1]) for p in batch.column("print").to_pylist()]
            owners = np.repeat(batch.column("node").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array([x for k in keys for x in k], pa.int64()), pa.array(owners, pa.int64())], names=["band", "node"])

    buckets = nodes.mapInArrow(banded, "band long, node long")
    led = buckets.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("band", "leader")
    groups = scratch.save(buckets.join(led, "band").select("leader", "node").distinct(), "groups")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks()
        for batch in batches:
            known: dict[bytes, np.ndarray] = {}  # a leader stands in many pairs
            a, b = ([known[x] if x in known else known.setdefault(x, unpack(x)[1]) for x in batch.column(c).to_pylist()] for c in "ab")
            yield batch.select(["node", "leader"]).filter(pa.array(walks.likeness_of_pairs(a, b) >= least, pa.bool_()))

    pairs = groups.where("node <> leader")
    left, right = nodes.select("node", F.col("print").alias("a")), nodes.select(F.col("node").alias("leader"), F.col("print").alias("b"))
    links = pairs.join(right, "leader").join(left, "node").select("node", "leader", "a", "b").mapInArrow(verify, "node long, leader long")
    labels = scratch.save(components(scratch, links.select(F.col("node").alias("u"), F.col("leader").alias("v"))), "labels")
    further = scratch.save(_links_between(nodes, groups, labels, least), "further")
    merged = scratch.save(components(scratch, further, "again"), "merged").select(F.col("node").alias("_label"), F.col("component").alias("_class"))
    found = nodes.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    return found.join(merged, F.col("label") == F.col("_label"), "left").select("node", F.coalesce("_class", "label").alias("class_id"))


def _links_between(nodes: DataFrame, groups: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """``u, v``: labels that a likeness between two members of one leader's group joins; groups of one label are done."""
    members = groups.join(labels, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("label"))
    counts = members.groupBy("leader", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("leader").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1 and n > 2")
    mixed = mixed.select("leader", F.col("top.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("y_blocks"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("x_blocks"))
    apart = members.join(mixed, "leader")
    spread = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    columns = ["leader", "x", "y", "asks", "node", "label"]
    xs = apart.where("label <> main").withColumns({"x": spread("x_blocks"), "y": every("y_blocks"), "asks": F.lit(True)}).select(*columns)
    ys = apart.withColumns({"y": spread("y_blocks"), "x": every("x_blocks"), "asks": F.lit(False)}).select(*columns)
    rows = xs.unionByName(ys).join(nodes, "node")

    def links(walks: Walks, group: list[tuple]) -> set[tuple[int, int]]:
        """``(greater label, lesser label)`` of the pairs of one block that are alike; members are ``(asks, label, print)``."""
        asking = [(of, unpack(raw)[1]) for asks, of, raw in group if asks]
        others = [(of, unpack(raw)[1]) for asks, of, raw in group if not asks]
        found: set[tuple[int, int]] = set()
        if asking and others:
            labels_of, sizes = np.array([of for of, _ in others]), np.array([len(x) for _, x in others])
            matrix = np.full((len(others), int(sizes.max())), 255, np.uint8)
            for row, (_, symbols) in enumerate(others):
                matrix[row, : len(symbols)] = symbols
            for of, symbols in asking:
                near = (walks.likeness_to_all(symbols, matrix, sizes) >= least) & (labels_of != of)
                found.update((max(of, x), min(of, x)) for x in labels_of[near].tolist())
        return found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Most groups are small: they come one after the other, sorted, rather than each by itself.
        walks, key, group = Walks(), None, []
        table = lambda found: pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["u", "v"])
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for leader, x, y, *member in zip(*(batch.column(c).to_pylist() for c in ("leader", "x", "y", "asks", "label", "print")), strict=True):
                if (leader, x, y) != key:
                    found |= links(walks, group)
                    key, group = (leader, x, y), []
                group.append(tuple(member))
            yield table(found)
        yield table(links(walks, group))

    dealt = rows.select("leader", "x", "y", "asks", "label", "print").repartition("leader", "x", "y").sortWithinPartitions("leader", "x", "y")
    return dealt.mapInArrow(compare, "u long, v long").distinct()


def _placed(docs: DataFrame) -> DataFrame:
    """``place, tie`` (what the order goes by), ``doc_id, text``."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("place"),
        F.xxhash64("text").alias("tie"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _ranges(rows: DataFrame, n: int):
    """A function that adds ``part``, a row's range in the order of place and tie, to a DataFrame with these two.

    Ids are cut at their quantiles; an id that several quantiles fall on is cut again by its ties.
    """
    cuts = rows.agg(F.percentile_approx("place", [k / n for k in range(1, n)], 25 * n)).first()[0] or []
    often = {float(c): times for c, times in Counter(map(float, cuts)).items() if times > 1}
    splits = [float("-inf"), *sorted({float(c) for c in cuts} | {0.0} | {math.nextafter(c, math.inf) for c in often}), float("inf")]
    shares = F.create_map(*[F.lit(x) for c, times in often.items() for x in (c, float(times))]) if often else None

    def add(df: DataFrame) -> DataFrame:
        placed = Bucketizer(splits=splits, inputCol="_x", outputCol="_range").transform(df.withColumn("_x", F.col("place").cast("double")))
        share = F.coalesce(F.try_element_at(shares, F.col("_x")), F.lit(1.0)) if often else F.lit(1.0)
        within = F.floor(F.least((F.col("tie") / F.lit(2.0**64) + 0.5) * share, share - 1e-6))
        return placed.withColumn("part", (F.col("_range") * (n + 1) + within).cast("long")).drop("_x", "_range")

    return add


def edited_fingerprints(docs: DataFrame, least: float | None = LEAST) -> DataFrame:
    """Fingerprints of every text and of its edited form, compared with each other and with the next text's.

    Rows stand in descending order of doc_id (null last, ties by a hash of the
    text); after the last comes the first. In the edited text the last
    ``floor(n_chars / 3)`` code points are the first as many (or all) of the next
    row's. Columns: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, class_id``, the last being the class of ``near_copies``
    (null with ``least=None``). Null texts are empty, and a class of their own;
    a single row is its own next; rows that repeat doc_id and text stand next to each other. Very long
    texts are walked whole. Further columns are ignored; an empty table gives no rows.

    The order never passes through one task: it is cut into ranges at quantiles, each range is
    walked in order, and the last row of a range is also sent to the range after it. Only rows that
    repeat both doc_id and text stay together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "edited")
    rows = _placed(docs)
    n = partitions(spark)
    add_part = _ranges(rows, 4 * n)
    ranged = add_part(rows)
    # One row a range, some per shuffle partition: the number is set by the session, not by the data.
    last = ranged.groupBy("part").agg(F.max(F.struct("place", "tie")).alias("last")).orderBy("part").collect()
    ends = [(r["last"]["place"], r["last"]["tie"], last[(k + 1) % len(last)]["part"]) for k, r in enumerate(last)]
    ends = spark.createDataFrame(ends, "place long, tie long, goes long")
    sent = ranged.join(F.broadcast(ends), ["place", "tie"], "left")
    own, extra = F.struct(F.col("part").alias("part"), F.lit(1).alias("own")), F.struct(F.col("goes").alias("part"), F.lit(0).alias("own"))
    sent = sent.withColumn("to", F.explode(F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, extra))))
    absent = {"doc_id": "long", "text": "string", "class_id": "long", "print": "binary", "head": "binary"}
    columns = ["part", "own", "place", "tie", "kind", *absent]
    row = lambda kind, *given: [F.lit(kind).alias("kind"), *[F.col(c) if c in given else F.lit(None).cast(absent[c]).alias(c) for c in absent]]
    sent = sent.select("to.part", "to.own", "place", "tie", *row(1, "doc_id", "text")).select(*columns)
    if least is not None:
        # Classes and fingerprints travel to their rows' ranges, each just ahead of its row, so each text is walked once.
        with shuffle_files_deleted(spark), temporary_tables():
            prints = scratch.save(fingerprints(rows, "place", "tie", heads=True), "prints")
            found = prints.join(near_copies(prints, least), "node").dropDuplicates(["place", "tie"])
            classes = scratch.save(found.select("place", "tie", "class_id", "print", "head"), "classes")
        scratch.drop("prints")
        sent = sent.unionByName(add_part(classes).withColumn("own", F.lit(1)).select("part", "own", "place", "tie", *row(0, "class_id", "print", "head")))
    sent = sent.repartition(n, "part").sortWithinPartitions("part", "own", "place", "tie", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks()
        part, after, after_state, known = None, "", (0, np.zeros(0, np.uint8)), None
        empty = (0, np.zeros(0, np.uint8))
        fields = ("part", "own", "place", "tie", "kind", "doc_id", "text", "class_id", "print", "head")
        for batch in batches:
            out = []
            for to, own, place, tie, kind, doc_id, text, class_id, whole, before in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if not kind:
                    known = (place, tie), class_id, unpack(whole), unpack(before)
                    continue
                if to != part:
                    part, after, after_state = to, text, None
                cut = len(text) // 3
                if known and known[0] == (place, tie) and own:
                    _, class_id, state, head = known
                else:
                    points = code_points(text)
                    head = walks.extend(empty, points[: len(text) - cut])
                    state = walks.extend(head, points[len(text) - cut :])
                if own:
                    if after_state is None:
                        after_state = walks.of(after)
                    changed = text[: len(text) - cut] + after[:cut]
                    edited = walks.extend(head, code_points(after[:cut])) if cut else state
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((doc_id, len(text), sha, to_string(state), to_string(edited), walks.likeness(state, edited), walks.likeness(state, after_state), class_id))
                after, after_state = text, state
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)

    return sent.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")


def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts, and the classes of near copies."""
    return edited_fingerprints(documents(spark, sf_dir))
