"""Model operators: completions, embeddings, extraction and answers behind one narrow interface.

A provider maps a batch of texts to a batch of texts or vectors. The default ones
run offline and are deterministic column expressions, so queries stay in the JVM;
a remote provider plugs in as a class and runs in Arrow batches with retries.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import confidence, is_cjk, let, parse_answer, preview, sentences, words

#: Families of providers by the start of a model's name.
FAMILIES = {"gpt": "openai", "claude": "anthropic", "embedding": "embedding", "gemini": "genai"}
#: Components of the default embedding.
DIMENSION = 64


class Provider(ABC):
    """Texts to texts; an instance is sent to the executors and opens its connection there."""

    @abstractmethod
    def complete(self, prompts: list[str]) -> list[str]: ...


def family(model: str) -> str:
    """The provider family of a model name; unknown names are an error."""
    for start, name in FAMILIES.items():
        if model.startswith(start):
            return name
    raise ValueError(f"unknown model: {model}")


def completion(provider: Provider, prompt: Column, tries: int = 3, pause: float = 1.0) -> Column:
    """The provider's replies, batch by batch; a batch that fails is tried again after twice the pause, and is null in the end."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            for n in range(tries):
                try:
                    out = pd.Series(provider.complete(batch.tolist()))
                    break
                except Exception:  # noqa: BLE001
                    if n + 1 < tries:
                        time.sleep(pause * 2**n)
            yield out

    return run(prompt)


def word_places(text: Column, dimension: int = DIMENSION) -> Column:
    """The component that each word of a text counts in."""
    return F.transform(words(F.lower(text)), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dimension)


def _counted(text: Column, dimension: int, finish: Callable[[Column, Column], Column]) -> Column:
    """What ``finish`` makes of a text's count of words in each component, and of the counts' length.

    Places are sorted, each component and the one after the last once more among them, so that a count is how far
    the next component's first place is away; a word costs a sort's steps and not a walk over all components.
    """
    first = lambda x: F.array_compact(F.transform(x, lambda p, i: F.when((i == 0) | (F.get(x, i - 1) < p), i)))
    count = lambda at: F.transform(F.sequence(F.lit(1), F.lit(dimension)), lambda k: (F.get(at, k) - F.get(at, k - 1) - 1).cast("double"))
    length = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    places = F.sort_array(F.concat(word_places(text, dimension), F.sequence(F.lit(0), F.lit(dimension))))
    return let(let(let(places, first), count), lambda counts: let(length(counts), lambda n: finish(counts, n)))


def embed_one(text: Column, dimension: int = DIMENSION) -> Column:
    """The embedding of a single text: an empty array for a text without words, null among them."""
    return _counted(F.coalesce(text, F.lit("")), dimension, lambda counts, n: F.when(n > 0, F.transform(counts, lambda x: x / n)).otherwise(F.array().cast("array<double>")))


def embed(text: Column, dimension: int = DIMENSION) -> Column:
    """A hashed bag of words, one unit for each word, of length one; texts without words give zeros."""
    return _counted(F.coalesce(text, F.lit("")), dimension, lambda counts, n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def summarise(text: Column, most: int = 500) -> Column:
    """The default summary: the start of the text."""
    return preview(text, most)


def extractive_answer(question: Column, context: Column) -> Column:
    """``struct(answer, answerable, related_context, confidence)``: the first sentence of the context that shares a longer word with the question."""
    asked = F.filter(words(F.lower(question)), lambda w: (F.length(w) > 3) | is_cjk(w))
    found = F.try_element_at(F.filter(sentences(F.coalesce(context, F.lit(""))), lambda s: F.arrays_overlap(words(F.lower(s)), asked)), F.lit(1))
    reply = F.when(found.isNull(), "Answer: \n========\nAnswerable: False\n========\nRelated Context: ").otherwise(F.concat(F.lit("Answer: "), found, F.lit("\n========\nAnswerable: True\n========\nRelated Context: "), found))
    parsed = parse_answer(reply)
    return F.struct(parsed["answer"].alias("answer"), parsed["answerable"].alias("answerable"), parsed["related_context"].alias("related_context"), confidence(parsed["answer"], F.coalesce(context, F.lit("")), parsed["answerable"]).alias("confidence"))
