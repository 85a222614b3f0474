"""Information-theoretic sanitisation of personal data (operator 7).

Protected entities (e-mail addresses, IP addresses, card and phone numbers) are
found by pattern. Then the corpus says which words give them away. Entities are
taken at two levels, each value by itself and all values of a kind together. For each
word that stands within ``NEAR_WORDS`` words of an entity, co-occurrence counts
estimate the pointwise mutual information

    PMI(word; entity) = log2 P(near entity | word) / P(near entity)

and its share of the entity's information content, ``-log2 P(near entity)``. A
word that reveals ``DISCLOSURE`` of it or more is a term to generalise or remove
as well (Sanchez, Batet and Viejo, 2013, with the corpus as its own source): at
all its places in every text that holds the entity, near it or not.

Everything is DataFrame operations. Texts are shuffled once, to meet their spans;
each match carries the few words around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import WORD, Scratch, documents, whole_row

#: The same matches as the plain patterns. \G (after the last match) or the look-behind keep each run of characters from
#: being tried again at every place in it; possessive groups neither go back nor recurse.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: Words before and after an entity, up to the next entity of its kind, that count as near, however long they are.
NEAR_WORDS = 8
#: Share of an entity's information content that a word may not reveal.
DISCLOSURE = 0.95
#: Occurrences near a kind, and different texts with one, below which nothing is concluded; the same for single values.
SUPPORT, SUPPORT_TEXTS = 5, 3
VALUE_SUPPORT, VALUE_TEXTS = 2, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def _valid(kind: Column, value: Column) -> Column:
    """The checks that a match has to pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    ip = value.rlike(r"^(0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.|$)){4}$")
    twice = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    luhn = F.aggregate(twice, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", F.length(digits).between(14, 19) & luhn).otherwise(F.length(digits).between(10, 15))


def _held(rows: DataFrame) -> DataFrame:
    """Those of ``_in, id, key, text`` whose text has a match, with ``found``: each match, its place and the words near it.

    Per match: ``kind, n`` (its number among those of its kind), ``gap`` (characters since the last one), ``value, before, after``.
    """
    found = rows
    for kind, pattern in PATTERNS.items():
        found = found.withColumn(f"_v_{kind}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    cut = [F.when(F.size(f"_v_{kind}") > 0, F.split("text", pattern, -1)).alias(f"_p_{kind}") for kind, pattern in PATTERNS.items()]
    found = found.select("*", *cut).where(" or ".join(f"size(_v_{kind}) > 0" for kind in PATTERNS))
    # The nearest words, with one more that may touch the match; the text before is read backwards from the match.
    nearest = rf"^(?:[\x20\x09-\x0D]*+{WORD}+){{0,{NEAR_WORDS + 1}}}+[\x20\x09-\x0D]*+"

    def of(kind: str) -> Column:
        values, pieces = F.col(f"_v_{kind}"), F.col(f"_p_{kind}")

        def one(i: Column) -> Column:
            left, right = F.get(pieces, i), F.get(pieces, i + 1)
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("n"), F.length(left).alias("gap"), F.get(values, i).alias("value"),
                F.reverse(F.regexp_extract(F.reverse(left), nearest, 0)).alias("before"), F.regexp_extract(right, nearest, 0).alias("after"),
            )

        return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.size(values) - 1), one))

    return found.select("_in", "id", "key", F.flatten(F.array_compact(F.array(*map(of, PATTERNS)))).alias("found"))


def _matches(held: DataFrame) -> DataFrame:
    """``id, key, kind, start, end, value, before, after, copies`` of all valid matches; ``copies`` counts the rows that repeat id and text."""
    rows = held.select("id", "key", F.inline("found"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    upto = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("id", "key", "kind").orderBy("n"))
    placed = rows.withColumn("end", upto).withColumn("start", F.col("end") - F.length("value"))
    return placed.where(_valid(F.col("kind"), F.col("value")))


def _entity(kind: Column, value: Column | None = None) -> Column:
    """The number of an entity: all values of a kind, or one value of it."""
    return F.xxhash64(kind) if value is None else F.xxhash64(kind, value)


def _near_words(matches: DataFrame) -> DataFrame:
    """``key, kind, value, word, copies`` of the words near entities; words have letters and neither digits nor @."""
    words = lambda side: F.regexp_extract_all(side, F.lit(WORD), F.lit(0))
    blank = lambda x: x.rlike(r"^[\x20\x09-\x0D]") | (x == "")
    before = F.reverse(words("before"))
    # A word without a blank between it and the entity is a part of what the pattern took, not a word near it.
    before = F.when(blank(F.reverse("before")), F.slice(before, 1, NEAR_WORDS)).otherwise(F.slice(before, 2, NEAR_WORDS))
    after = F.when(blank(F.col("after")), F.slice(words("after"), 1, NEAR_WORDS)).otherwise(F.slice(words("after"), 2, NEAR_WORDS))
    out = matches.select("key", "kind", "value", "copies", F.explode(F.concat(before, after)).alias("word"))
    out = out.where(F.col("word").rlike(r"\p{L}{2}") & ~F.col("word").rlike(r"[0-9@+]"))
    return out.withColumn("word", F.translate("word", _UPPER, _LOWER))


def _words_of(text: str) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _revealing(scratch: Scratch, docs: DataFrame, near: DataFrame) -> DataFrame:
    """``word, entity, pmi, share`` of the words that reveal too much of an entity. All rows count, repeated ones too."""
    counts = docs.select(F.explode(_words_of("text")).alias("word")).groupBy(F.xxhash64("word").alias("hash")).agg(F.count("*").alias("n"))
    counts = scratch.save(counts, "counts")
    levels = F.array(
        F.struct(_entity(F.col("kind")).alias("entity"), F.lit(SUPPORT).alias("least"), F.lit(SUPPORT_TEXTS).alias("least_texts")),
        F.struct(_entity(F.col("kind"), F.col("value")).alias("entity"), F.lit(VALUE_SUPPORT).alias("least"), F.lit(VALUE_TEXTS).alias("least_texts")),
    )
    each = near.groupBy("kind", "value", "word", "key").agg(F.sum("copies").alias("n")).select("word", "key", "n", F.inline(levels))
    together = each.groupBy("entity", "word", "key", "least", "least_texts").agg(F.sum("n").alias("n"))
    together = together.groupBy("entity", "word", "least", "least_texts").agg(F.sum("n").alias("n_near"), F.count("*").alias("texts"))
    together = scratch.save(together, "together")
    per_entity = together.groupBy("entity").agg(F.sum("n_near").alias("entity_near"))
    known = together.where("n_near >= least and texts >= least_texts").join(per_entity, "entity").withColumn("hash", F.xxhash64("word"))
    known = known.join(counts, "hash").join(F.broadcast(counts.agg(F.sum("n").alias("total"))))  # one row
    content = -F.log2(F.col("entity_near") / F.col("total"))
    # A word between two entities is near both; its occurrences are still no more than they are.
    known = known.withColumn("pmi", F.log2(F.least("n_near", "n") / F.col("n")) + content).withColumn("share", F.try_divide("pmi", content))
    return known.where(F.col("share") >= DISCLOSURE).select("word", "entity", "pmi", "share")


def _terms(texts: DataFrame, matches: DataFrame, revealing: DataFrame) -> DataFrame:
    """``id, key, start, end`` of all places of revealing words in those of ``texts(id, key, text)`` that hold what they reveal."""
    held = matches.select("id", "key", F.explode(F.array(_entity(F.col("kind")), _entity(F.col("kind"), F.col("value")))).alias("entity")).distinct()
    words = texts.select("id", "key", F.explode(F.array_distinct(_words_of("text"))).alias("word")).distinct()
    said = words.join(revealing.select("word", "entity"), "word")
    said = said.alias("s").join(held.alias("h"), F.expr("s.id <=> h.id and s.key = h.key and s.entity = h.entity"), "left_semi")
    wanted = said.groupBy("id", "key").agg(F.collect_set("word").alias("wanted")).withColumnsRenamed({"id": "_id", "key": "_key"})
    # Only texts that hold such a word are cut into words with their places.
    cut = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).dropDuplicates(["id", "key"])
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"), F.transform(F.split("text", WORD, -1), F.length).alias("gap"))
    rows = cut.select("id", "key", "wanted", F.posexplode(parts).alias("n", "part")).where("part.word is not null")
    upto = F.sum(F.col("part.gap") + F.length("part.word")).over(Window.partitionBy("id", "key").orderBy("n"))
    rows = rows.withColumn("end", upto).where(F.array_contains("wanted", F.translate("part.word", _UPPER, _LOWER)))
    return rows.select("id", "key", (F.col("end") - F.length("part.word")).alias("start"), "end")


_SPANS = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,upto:bigint>>"


def _marked(docs: DataFrame, added: tuple[str, ...]) -> DataFrame:
    """``_in``, the row as a struct, and ``_spans`` with ``upto``: the end of the run of overlapping spans that a span begins, else null."""
    scratch = Scratch(docs.sparkSession, "disclosure")
    rows = docs.select(whole_row(docs, added).alias("_in"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text"))
    # Texts with a match are written once; no other text is ever shuffled.
    held = scratch.save(_held(rows), "held")
    matches = scratch.save(_matches(held), "matches")
    texts = held.select("id", "key", F.col("_in.text").cast("string").alias("text"))
    revealing = scratch.save(_revealing(scratch, rows, _near_words(matches)), "revealing")
    spans = matches.select("id", "key", "kind", "start", "end").unionByName(_terms(texts, matches, revealing).select("id", "key", F.lit("term").alias("kind"), "start", "end"))

    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = spans.select("id", "key", F.col("start").cast("long").alias("start"), number.alias("kind_no"), F.col("end").cast("long").alias("end"), "kind")
    one, base = Window.partitionBy("id", "key"), F.col("kind") != "term"
    last = F.max(F.when(base, F.col("end"))).over(one.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(base, F.col("start"))).over(one.orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    # A word that touches or overlaps what a pattern took belongs to it.
    spans = spans.withColumns({"_last": last, "_next": following}).where(base | ~(F.coalesce(F.col("_last") >= F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") <= F.col("end"), F.lit(False))))
    order = one.orderBy("start", "kind_no")
    fresh = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("_fresh", fresh).withColumn("_run", F.sum(F.col("_fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("upto", F.when(F.col("_fresh"), F.max("end").over(Window.partitionBy("id", "key", "_run"))))
    spans = spans.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end", "kind", "upto"))).cast(_SPANS).alias("_spans"))
    some = held.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("_in", "_spans")
    none = rows.where(F.col("text").isNull() | ~_any_match(F.col("text"))).select("_in", F.lit(None).cast(_SPANS).alias("_spans"))
    return some.unionByName(none).select("_in", F.coalesce("_spans", F.array().cast(_SPANS)).alias("_spans"))


def _any_match(text: Column) -> Column:
    """Whether any pattern matches, valid or not; those without the characters for one are not searched."""
    digit = text.rlike("[0-9]")
    return (F.contains(text, F.lit("@")) & text.rlike(PATTERNS["email"])) | (digit & (text.rlike(PATTERNS["ip"]) | text.rlike(PATTERNS["card"]) | text.rlike(PATTERNS["phone"])))


def _plain(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), s["kind"].alias("kind")))


def _clean(text: str, spans: str) -> Column:
    """The text with each run of overlapping spans replaced by the tag of the first."""
    tag = F.create_map(*[F.lit(x) for pair in _TAGS.items() for x in pair])
    runs = F.filter(spans, lambda s: s["upto"].isNotNull())
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["upto"])
    pieces = F.transform(runs, lambda s, i: F.concat(F.substring(F.col(text), (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), F.element_at(tag, s["kind"])))
    rest = F.substring(F.col(text), (F.array_max(F.transform(runs, lambda s: s["upto"])) + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text))


def disclosures(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``spans``, an array of ``start, kind_no, end, kind``, in order.

    Positions are code points, the end is exclusive. Kinds are those of
    ``KINDS``; ``term`` spans are revealing words, and touch no other span. Null
    texts have no spans. Rows that repeat doc_id and text get the same spans; in the
    counts they are as many as they are, but one text. A null doc_id is an id like others. Very long
    texts count whole, and so do very long words. Further columns are kept, but
    for one named spans. An empty table gives an empty result.
    """
    return _marked(docs, ("spans",)).select("_in.*", _plain("_spans").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``disclosures`` generalised to its kind's tag; of overlapping spans the first one's stands for all."""
    marked = _marked(docs, ("spans",))
    names = marked.schema["_in"].dataType.names
    return marked.select("_spans", *[F.col(f"_in.`{c}`").alias(c) for c in names]).select(*[_clean("text", "_spans").alias(c) if c == "text" else F.col(f"`{c}`") for c in names], _plain("_spans").alias("spans"))


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts by kind, the spans, and the sanitised text."""
    marked = _marked(documents(spark, sf_dir).select("doc_id", "text"), ()).select("_in.doc_id", "_in.text", F.col("_spans").alias("found"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"] != "term")
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return marked.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in PATTERNS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("found", line), ",").alias("spans"),
        F.size(base).cast("long").alias("n_base"),
        number("term").alias("n_term"),
        _clean("text", "found").alias("sanitised"),
    )
