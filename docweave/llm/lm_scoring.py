"""Language-model scoring by a weighted backoff automaton (operator 8).

States are histories of up to ``order - 1`` tokens that the training texts hold.
A state has an arc for each token that follows it there, weighted with the
log-probability of the smoothed n-gram, and one failure arc to the state without
the first token, weighted with what smoothing leaves to shorter histories. The
empty history has an arc for every token. A text is read once from left to
right: at each token the state follows failure arcs until it has an arc for it,
takes that arc, and the weights of all arcs taken add up to the text's log-probability.

Smoothing shrinks a history's counts towards the shorter history with ``prior``
observations of the latter (MacKay and Peto's hierarchical model):

    P(w | h) = (c(h w) + prior * P(w | shorter h)) / (c(h) + prior),

so a failure arc weighs ``prior / (c(h) + prior)``, and
``P(w) = (c(w) + 1) / (N + V + 1)`` at the empty history.

Counts are those of all training texts (``counting``). Each block of texts gets
the part of the automaton that its own n-grams can reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import bound_batches, documents, partitions
from docweave.llm.counting import Grams, blocks_of, distinct_words, hash_bits, in_blocks, known_counts, replies, requests, unpack_rows

#: Length of the n-grams, and observations of the shorter history that count with those of a history.
ORDER, PRIOR = 3, 2.0
_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Automaton:
    """The states and arcs that the n-grams of some texts can reach.

    State 0 is the empty history; the others are the n-grams of the levels below
    the longest. ``fail`` and ``fail_weight`` have one entry a state, ``target``
    and ``weight`` one an arc. ``arcs[k]`` gives each place the arc that a state of
    ``k`` tokens has for the token there, or -1.
    """

    def __init__(self, grams: Grams, known: list[tuple[np.ndarray, np.ndarray, np.ndarray]], outcomes: float, prior: float):
        order = len(known)
        sizes = [len(counts) for counts, _, _ in known]
        first_state = np.concatenate([[1], 1 + np.cumsum(sizes[:-1])]).tolist()  # of each level
        first_arc = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        states = 1 + sum(sizes[:-1])
        self.fail, self.fail_weight = np.zeros(states, np.int32), np.zeros(states)
        self.depth = np.zeros(states, np.int8)
        self.arcs, weights, targets = [], [], []
        probability = (known[0][0] + 1.0) / outcomes
        for level, (counts, place, at) in enumerate(known):
            if level:
                history, shorter = known[level - 1][2][place - 1], known[level - 1][2][place]
                probability = (counts + prior * probability[shorter]) / (known[level - 1][0][history] + prior)
            own = first_state[level] + np.arange(sizes[level]) if level < order - 1 else np.zeros(sizes[level], np.int64)
            suffix = first_state[level - 1] + known[level - 1][2][place] if level else np.zeros(sizes[level], np.int64)
            if level < order - 1:
                self.fail[own], self.depth[own] = suffix, level + 1
                self.fail_weight[own] = np.log10(prior / (counts + prior))
            # An n-gram that no training text holds is no state; its arc, if it has one, ends where failing would.
            targets.append(np.where(counts > 0, own, suffix) if level < order - 1 else suffix)
            weights.append(np.log10(probability))
            usable = (at >= 0) & ((counts[at] > 0) | (level == 0)) if sizes[level] else np.zeros(len(at), bool)
            self.arcs.append(np.where(usable, first_arc[level] + at, -1).astype(np.int32))
        self.target, self.weight = np.concatenate(targets).astype(np.int32), np.concatenate(weights)
        self.grams, self.known, self.first_state = grams, known, first_state

    def read(self) -> np.ndarray:
        """The log10 probability of each text: one pass over its tokens that carries a state."""
        # Views give plain numbers without a copy of the automaton as Python objects.
        fail, fail_weight, depth, target, weight = map(memoryview, (self.fail, self.fail_weight, self.depth, self.target, self.weight))
        start = int(self.known[0][2][self.grams.starts[0]]) if len(self.grams.sizes) else 0
        begin = self.first_state[0] + start if len(self.known) > 1 and self.known[0][0][start] else 0
        scores = []
        for a, b in zip(self.grams.starts[:-1].tolist(), self.grams.starts[1:].tolist(), strict=True):
            state, total = begin, 0.0
            for found in zip(*[arcs[a + 1 : b].tolist() for arcs in self.arcs], strict=True):
                arc = found[depth[state]]
                while arc < 0:
                    total += fail_weight[state]
                    state = fail[state]
                    arc = found[depth[state]]
                total += weight[arc]
                state = target[arc]
            scores.append(total)
        return np.array(scores)


def score_documents(docs: DataFrame, trained: str = "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2", order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``, scored by a model of the rows that ``trained`` selects.

    Columns: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``. Tokens are the words, A-Z in lower case, and one end for each
    text. ``base_score`` sums ``log10((c + 1) / (N + V + 1))`` over the tokens,
    ``score`` is the automaton's log10 probability of the text.

    Null texts are empty: one token, the end. A row with a null doc_id has a
    null condition and is held out. Repeated rows train once each and are scored
    once each. A very long text is a block by itself, read whole. Further columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", ~F.coalesce(F.expr(trained), F.lit(False)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens, different = distinct_words(rows.where("not held_out"))
    outcomes, bits, shards = float(tokens + different + 1), hash_bits(size), blocks_of(size, partitions(spark))
    dealt = in_blocks(rows, shards)
    asked = requests(dealt, shards, order, bits, lambda table: ~table.column("held_out").to_numpy())

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _ARROW.empty_table()
        texts = unpack_rows(block.column("rows")[0].as_py())
        grams = Grams(texts.column("text").combine_chunks(), order, bits)
        known = known_counts(grams, answers, shards)
        counts = known[0][0][known[0][2]]
        token = grams.token()
        base = np.where(token, np.log10((counts + 1.0) / outcomes), 0.0)
        each = lambda values: np.add.reduceat(values, grams.starts[:-1])
        columns = [
            texts.column("doc_id"), texts.column("held_out"), grams.sizes + 1, each((token & (counts > 0)).astype(np.int64)),
            np.full(len(grams.sizes), tokens), each(base), Automaton(grams, known, outcomes, prior).read(),
        ]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], schema=_ARROW)

    return dealt.groupBy("block").cogroup(replies(asked).groupBy("block")).applyInArrow(score, _SCHEMA)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, trained on those whose crc32(doc_id) mod 7 is not 2."""
    return score_documents(documents(spark, sf_dir))
