"""Token-bounded chunking of texts: lines, headings, sections, packers, tables and split points.

Documents are rows ``doc_id, text``. What depends on the lines before is a
window over the document's lines; what folds a document's pieces into chunks is
one ordered ``aggregate`` in the row, so no shuffle happens for packing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import has_pipe_table, is_empty_heading, is_table, make_id, markdown_heading, sentences, strip, token_count, words
from docweave.operators.store import Store, bound_batches

#: Tokens that a chunk may hold.
LIMIT = 650
#: Characters of texts that a task cuts into lines and sorts, on average.
TASK_CHARS = 4 << 20


def pack(pieces: Column, limit: int, joint: str, measure=token_count, empty_first: bool = False) -> Column:
    """Pieces joined, in order, into as few strings as their measure allows one after the other.

    A piece beyond the limit stays whole, alone. With ``empty_first`` a first
    piece beyond the limit is preceded by an empty string (kept for comparison).
    """
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"))

    def step(state: Column, piece: Column) -> Column:
        joined = F.concat(state["cur"], F.lit(joint), piece)
        fits = state["cur"].isNotNull() & (measure(joined) <= limit)
        first = F.when(F.lit(empty_first) & state["cur"].isNull() & (measure(piece) > limit), F.array(F.lit(""))).otherwise(state["out"])
        return F.struct(
            F.when(fits, state["out"]).when(state["cur"].isNull(), first).otherwise(F.array_append(state["out"], state["cur"])).alias("out"),
            F.when(fits, joined).otherwise(piece).alias("cur"),
        )

    return F.aggregate(pieces, start, step, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")


def text_chunks(text: Column, limit: int = LIMIT, separator: str = "\n\n") -> Column:
    """Chunks of a text without headings: whole if it fits; else packed paragraphs, then sentences, then words."""
    pieces = F.filter(F.transform(F.split(text, separator, -1), strip), lambda p: p != "")

    def of_paragraph(p: Column) -> Column:
        return F.when(token_count(p) <= limit, F.array(p)).otherwise(F.flatten(F.transform(pack(sentences(p), limit, " "), of_sentence)))

    def of_sentence(s: Column) -> Column:
        return F.when(token_count(s) <= limit, F.array(s)).otherwise(pack(words(s), limit, " "))

    split = F.flatten(F.transform(pack(pieces, limit, separator), of_paragraph))
    return F.when(token_count(text) <= limit, F.array(text)).otherwise(split)


def _cells(row: Column) -> Column:
    """The stripped cells of a pipe row."""
    parts = F.split(row, r"\|", -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), strip)


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def small_table(heads: Column, cells: Column) -> Column:
    """A table of one row."""
    return F.concat(_row(heads), F.lit("\n"), _row(F.transform(heads, lambda _: F.lit("---"))), F.lit("\n"), _row(cells))


def cell_chunks(head: Column, cell: Column, limit: int) -> Column:
    """The paragraphs of a cell that fits no table, each under its column's name; long ones by sentences."""
    said = F.transform(F.filter(F.transform(F.split(cell, "\n\n", -1), strip), lambda p: p != ""), lambda p: F.concat(F.lit("Column: "), head, F.lit("\n\n"), p))
    return F.flatten(F.transform(said, lambda p: F.when(token_count(p) <= limit, F.array(p)).otherwise(F.flatten(F.transform(pack(sentences(p), limit, " "), lambda x: F.when(token_count(x) <= limit, F.array(x)).otherwise(pack(words(x), limit, " ")))))))


def row_chunks(header: Column, row: Column, limit: int) -> Column:
    """A row that does not fit: small tables of as many neighbouring columns as do; a column that does not is cut by ``cell_chunks``."""
    pairs = F.filter(F.arrays_zip(_cells(header).alias("head"), _cells(row).alias("cell")), lambda p: p["head"].isNotNull() & p["cell"].isNotNull())
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("heads"), none.alias("cells"))

    def done(state: Column) -> Column:
        return F.when(F.size(state["heads"]) > 0, F.array_append(state["out"], small_table(state["heads"], state["cells"]))).otherwise(state["out"])

    def step(state: Column, pair: Column) -> Column:
        heads, cells = F.array_append(state["heads"], pair["head"]), F.array_append(state["cells"], pair["cell"])
        fits = token_count(small_table(heads, cells)) <= limit
        alone = token_count(small_table(F.array(pair["head"]), F.array(pair["cell"]))) <= limit
        return F.struct(
            F.when(fits, state["out"]).when(alone, done(state)).otherwise(F.concat(done(state), cell_chunks(pair["head"], pair["cell"], limit))).alias("out"),
            F.when(fits, heads).when(alone, F.array(pair["head"])).otherwise(none).alias("heads"),
            F.when(fits, cells).when(alone, F.array(pair["cell"])).otherwise(none).alias("cells"),
        )

    return F.aggregate(pairs, start, step, done)


def table_chunks(table: Column, limit: int = LIMIT) -> Column:
    """Rows of a pipe table in parts, each with the heading row and the separator again; rows beyond the limit by columns and cells."""
    rows = F.filter(F.split(table, "\n", -1), lambda r: strip(r) != "")
    head = F.array_join(F.slice(rows, 1, 2), "\n")
    body = F.when(F.size(rows) > 2, F.slice(rows, 3, F.greatest(F.size(rows) - 2, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    whole = lambda part: F.concat(head, F.lit("\n"), part)
    measure = lambda part: token_count(whole(part))
    parts = F.transform(pack(body, limit, "\n", measure), lambda part: F.when(measure(part) <= limit, F.array(whole(part))).otherwise(row_chunks(F.get(rows, 0), part, limit)))
    return F.when(token_count(table) <= limit, F.array(table)).when(F.size(body) > 0, F.flatten(parts)).otherwise(F.array(table))


#: A line of a pipe table.
_PIPED = r"^\|.*\|$"


def table_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run, is_table, first_line, last_line, content``: runs of table lines and of other lines, in order."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines(docs).withColumn("is_table", F.col("line").rlike(_PIPED))
    fresh = F.coalesce((F.col("is_table") != F.lag("is_table").over(order)).cast("int"), F.lit(0))
    runs = marked.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return runs.groupBy("doc_id", "run").agg(F.bool_or("is_table").alias("is_table"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.array_join(body, "\n").alias("content"))


def mixed_chunks(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, chunk_id, content, token_count`` of texts with tables between prose.

    Prose is cut by ``text_chunks`` and tables by ``table_chunks``. The last piece of
    prose before a table and the table's first part become one chunk if they fit, and
    so do the last part of a table and the first piece of the prose that ends the text.
    """
    pieces = F.when(F.col("is_table"), table_chunks(F.col("content"), limit)).when(strip(F.col("content")) == "", F.array().cast("array<string>")).otherwise(text_chunks(strip(F.col("content")), limit))
    runs = table_runs(docs).withColumn("pieces", pieces)
    listed = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("run", "is_table", "pieces"))).alias("runs"))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("prose"))
    all_but_last = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))
    all_but_first = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
    joint = lambda x, y: F.concat(F.try_element_at(x, F.lit(-1)), F.lit("\n"), F.try_element_at(y, F.lit(1)))

    def joined(x: Column, y: Column, when: Column) -> Column:
        both = joint(x, y)
        return F.when(when & both.isNotNull() & (token_count(both) <= limit), F.concat(all_but_last(x), F.array(both), all_but_first(y))).otherwise(F.concat(x, y))

    def step(state: Column, run: Column) -> Column:
        return F.struct(
            F.when(run["is_table"], F.concat(state["out"], joined(state["prose"], run["pieces"], F.lit(True)))).otherwise(state["out"]).alias("out"),
            F.when(run["is_table"], none).otherwise(run["pieces"]).alias("prose"),
        )

    def end(state: Column) -> Column:
        last = F.substring_index(F.try_element_at(state["out"], F.lit(-1)), "\n", 1)
        return joined(state["out"], state["prose"], F.coalesce(last.rlike(_PIPED), F.lit(False)))

    out = listed.select("doc_id", F.posexplode(F.aggregate("runs", start, step, end)).alias("chunk_id", "content"))
    return out.withColumn("token_count", token_count(F.col("content")))


def chunks(docs: DataFrame, limit: int = LIMIT, separator: str = "\n\n") -> DataFrame:
    """``doc_id, chunk_id, content, token_count`` of each document, numbered from 0.

    Texts within the limit stay whole; longer ones that hold a table line go by ``mixed_chunks``, others by ``text_chunks``.
    """
    mixed = F.coalesce(has_pipe_table(F.col("text")) & (token_count(F.col("text")) > limit), F.lit(False))
    plain = docs.where(~mixed).select("doc_id", F.posexplode(text_chunks(F.col("text"), limit, separator)).alias("chunk_id", "content")).withColumn("token_count", token_count(F.col("content")))
    return plain.unionByName(mixed_chunks(docs.where(mixed), limit))


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def heading_paths(marked: DataFrame, depth: int = 6) -> DataFrame:
    """Rows ``doc_id, line_no, level, title`` (level null for lines that are no headings) with the path ``h1 .. h6`` in force.

    A heading ends all headings of its level and below. Level k in force is the last
    one of that level since the last heading above it.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = marked
    for k in range(1, depth + 1):
        out = out.withColumn(f"_s{k}", F.sum((F.col("level") < k).cast("int")).over(order))
    for k in range(1, depth + 1):
        within = Window.partitionBy("doc_id", f"_s{k}").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(within))
    return out.drop(*[f"_s{k}" for k in range(1, depth + 1)])


def markdown_lines(docs: DataFrame) -> DataFrame:
    """The lines of Markdown texts with ``level, title`` where they are headings; lines in code fences are not."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.ltrim("line").startswith("```")
    fenced = lines(docs).withColumn("_fences", F.sum(fence.cast("int")).over(order))
    heading = F.when((F.col("_fences") % 2 == 0) & ~fence, markdown_heading(F.col("line")))
    return fenced.withColumn("level", heading["level"]).withColumn("title", heading["title"]).drop("_fences")


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, section, level, h1 .. h6, content, token_count``: the text under each heading, without the heading itself.

    Section 0 is the text before the first heading; sections without text and
    heading are left out.
    """
    placed = heading_paths(markdown_lines(docs))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(order))
    body = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line"))))
    content = strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n"))
    paths = [F.max_by(f"h{k}", "line_no").alias(f"h{k}") for k in range(1, 7)]
    out = numbered.groupBy("doc_id", "section").agg(F.max("level").alias("level"), *paths, content.alias("content"))
    return out.where("content <> '' or level is not null").withColumn("token_count", token_count(F.col("content")))


def section_chunks(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Sections packed into chunks: a section beyond the limit is split, and neighbours under one parent heading are joined while they fit.

    Columns ``doc_id, chunk_id, parent, content, token_count``; each content
    starts with the headings in force.
    """
    parts = sections(docs).where(~is_empty_heading(F.col("content")))
    above = F.array_compact(F.array(*[F.when(F.col(f"h{k}").isNotNull(), F.concat(F.lit("#" * k + " "), F.col(f"h{k}"))) for k in range(1, 7)]))
    parts = parts.withColumn("_path", above)
    parts = parts.withColumn("parent", F.array_join(F.when(F.size("_path") > 1, F.slice("_path", 1, F.greatest(F.size("_path") - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")), "\n"))
    heading = F.coalesce(F.try_element_at("_path", F.lit(-1)), F.lit(""))
    split = parts.select("doc_id", "section", "parent", F.posexplode(text_chunks(strip(F.concat(heading, F.lit("\n"), F.col("content"))), limit)).alias("part", "piece"))
    order = Window.partitionBy("doc_id").orderBy("section", "part")
    runs = split.withColumn("_new", (F.lag("parent").over(order).isNull() | (F.lag("parent").over(order) != F.col("parent"))).cast("int"))
    runs = runs.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("section", "part", "piece"))), lambda x: x["piece"])
    packed = runs.groupBy("doc_id", "run", "parent").agg(pack(pieces, limit, "\n\n").alias("_chunks"))
    out = packed.select("doc_id", "run", "parent", F.posexplode("_chunks").alias("_n", "_c"))
    out = out.withColumn("content", strip(F.concat("parent", F.lit("\n\n"), "_c")))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "_n")) - 1
    return out.select("doc_id", place.alias("chunk_id"), "parent", "content", token_count(F.col("content")).alias("token_count"))


def header_sections(docs: DataFrame) -> DataFrame:
    """``doc_id, section, level, path, prefix, body, chars, n_lines, end, whole_chars, whole_lines, leaf, parent, parent_chars, parent_lines``: a document's sections as nested intervals.

    Section 0 is what comes before the first heading. ``prefix`` holds the headings in force, its own last, and ``body`` the other
    lines. A section's descendants are those up to ``end``, the next section of its level or above, so what they
    amount to, each with its prefix, is a difference of running sums.
    """
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = heading_paths(markdown_lines(docs)).withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(upto))
    titles = F.array(*[F.max_by(f"h{k}", "line_no") for k in range(1, 7)])
    body = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line"))))
    parts = numbered.groupBy("doc_id", "section").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"), titles.alias("_titles"), F.transform(body, lambda x: x["line"]).alias("body"))
    marked = F.transform("_titles", lambda t, i: F.when(F.coalesce(t != "", F.lit(False)), F.concat(F.repeat(F.lit("#"), i + 1), F.lit(" "), t)))
    parts = parts.withColumns({"path": F.array_compact("_titles"), "prefix": F.array_compact(marked)})
    parts = parts.withColumn("chars", F.aggregate(F.concat("prefix", "body"), F.lit(0), lambda n, x: n + F.length(x))).withColumn("n_lines", F.size("prefix") + F.size("body"))
    order = Window.partitionBy("doc_id").orderBy("section")
    before, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    everything = Window.partitionBy("doc_id")
    parts = parts.withColumns({"_chars": F.coalesce(F.sum("chars").over(before), F.lit(0)), "_lines": F.coalesce(F.sum("n_lines").over(before), F.lit(0)), "_last": F.struct((F.max("section").over(everything) + 1).alias("section"), F.sum("chars").over(everything).alias("_chars"), F.sum("n_lines").over(everything).alias("_lines"))})
    place = F.struct("section", "_chars", "_lines")
    following = [F.when(F.lit(k) <= F.col("level"), F.min(F.when(F.col("level") == k, place)).over(later)) for k in range(1, 7)]
    parts = parts.withColumn("_end", F.coalesce(F.least(*following), F.col("_last"))).withColumn("leaf", F.coalesce(F.lead("level").over(order) <= F.col("level"), F.lit(True)))
    parts = parts.withColumns({"end": F.col("_end.section"), "whole_chars": F.col("_end._chars") - F.col("_chars"), "whole_lines": F.col("_end._lines") - F.col("_lines")})
    above = [F.when(F.lit(k) < F.col("level"), F.max(F.when(F.col("level") == k, F.struct("section", "whole_chars", "whole_lines"))).over(before)) for k in range(1, 6)]
    return parts.withColumn("_parent", F.greatest(*above)).select(
        "doc_id", "section", "level", "path", "prefix", "body", "chars", "n_lines", "end", "whole_chars", "whole_lines", "leaf", F.col("_parent.section").alias("parent"), F.col("_parent.whole_chars").alias("parent_chars"), F.col("_parent.whole_lines").alias("parent_lines"),
    )


def header_chunks(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, chunk_id, path, content, token_count``: documents cut at headings, no deeper than the limit asks for.

    A document within the limit is one chunk. Of others, a section is a chunk with all its descendants if they fit together and
    its parent's do not; else its own text is one and its descendants are looked at in turn. A section
    without descendants stays whole, however long it is. Each section in a chunk comes under the full line of its headings.
    As a section never holds more than its parent does, this needs no recursion: its own sums and its parent's decide. Blank chunks are left out; null texts give none.

    Texts are written once and dealt whole, ``TASK_CHARS`` to a task: lines compress so well that partitions of a bounded size on disk are many times as large in memory.
    """
    docs = Store(docs.sparkSession, "headers").save(docs.select("doc_id", "text").where("text is not null"), "docs")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    docs = docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / TASK_CHARS)), "doc_id")
    whole = token_count(F.col("text")) <= limit
    short = docs.where(whole).select("doc_id", F.lit(0).alias("section"), F.array().cast("array<string>").alias("path"), F.col("text").alias("content"))
    found = header_sections(docs.where(~whole))
    fits = lambda chars, lines, level: F.coalesce((level > 0) & (F.floor((F.col(chars) + F.greatest(F.col(lines) - 1, F.lit(0))) / 4) <= limit), F.lit(False))
    found = found.withColumn("_fits", fits("whole_chars", "whole_lines", F.col("level"))).withColumn("_within", fits("parent_chars", "parent_lines", F.lit(1)))
    upto = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.last(F.when(~F.col("_within") & (F.col("_fits") | F.col("leaf")), F.struct("section", "end", "path")), ignorenulls=True).over(upto)
    found = found.withColumn("_in", taken).withColumn("_in", F.when(F.col("section") < F.col("_in.end"), F.col("_in")))
    # A section that is in none is a group of its own, so both kinds come from one pass over the sections.
    own, within = strip(F.array_join("body", "\n")), F.col("_in").isNotNull()
    lines_of = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(within, F.struct("section", F.concat("prefix", "body").alias("l"))))), lambda x: x["l"]))
    alone = F.when(~within & (own != ""), F.concat(F.array_join("prefix", "\n\n"), F.lit("\n\n"), own))
    chunks = found.groupBy("doc_id", F.coalesce("_in.section", "section").alias("section")).agg(
        F.first(F.coalesce("_in.path", "path")).alias("path"), F.when(F.bool_or(within), strip(F.array_join(lines_of, "\n"))).otherwise(F.first(alone)).alias("content"),
    )
    every = short.unionByName(chunks).where(strip(F.col("content")) != "")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section")) - 1
    return every.select("doc_id", place.alias("chunk_id"), "path", "content", token_count(F.col("content")).alias("token_count"))


def merge_empty_headings(parts: DataFrame) -> DataFrame:
    """Rows ``doc_id, position, content``: runs of chunks that hold only a heading go in front of the next chunk; trailing ones go."""
    order = Window.partitionBy("doc_id").orderBy("position")
    marked = parts.withColumn("_empty", is_empty_heading(F.col("content")))
    marked = marked.withColumn("_group", F.sum((~F.col("_empty")).cast("int")).over(order.rowsBetween(0, Window.unboundedFollowing)))
    body = F.transform(F.array_sort(F.collect_list(F.struct("position", "content"))), lambda x: x["content"])
    merged = marked.groupBy("doc_id", "_group").agg(F.max("position").alias("position"), F.array_join(body, "\n\n").alias("content"), F.bool_and("_empty").alias("_all"))
    return merged.where("not _all").select("doc_id", "position", "content")


def split_points(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, position, kind, priority`` of the places at which a text may be split.

    A table of contents begins at a line with "contents" and ends at the next heading, or
    at a blank line that some other line than an entry follows. In it a text may only be split
    after whole entries, which may run over several lines, and where it ends.
    """
    whole = Window.partitionBy("doc_id").orderBy("line_no")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    last_so_far = lambda event: F.coalesce(F.last(event, ignorenulls=True).over(upto), F.lit(False))
    rows = lines(docs).withColumns({"_t": strip(F.col("line")), "_after": F.sum(F.length("line") + 1).over(upto), "_last": F.max("line_no").over(Window.partitionBy("doc_id"))})
    t = F.col("_t")
    filled = F.nullif(t, F.lit(""))
    soon = lambda n: F.coalesce(F.first(filled, ignorenulls=True).over(whole.rowsBetween(1, n)), F.lit("["))
    rows = rows.withColumns({"_soon2": soon(2), "_soon3": soon(3)})
    named, heads = F.contains(F.lower("_t"), F.lit("contents")), t.startswith("#")
    leaves = (t == "") & ~F.col("_soon2").startswith("[")
    rows = rows.withColumn("_toc", last_so_far(F.when(named, True).when(heads | leaves, False)))
    begins = t.rlike(r"^\[[^\[\]]*$")
    closes = t.rlike(r"^\[[^\]]+\]\s*\[[^\]]+\]\([^)]+\)") | t.endswith(")") | F.contains(t, F.lit("]("))
    entry = F.when(named | heads | leaves, False).when(F.col("_toc") & begins, True).when(F.col("_toc") & closes, False)
    rows = rows.withColumn("_open", last_so_far(entry))
    before = F.col("_after") - F.length("line") - 1

    def point(kind: str, priority: int, position: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), position.alias("position"))

    toc, whole_entry = F.col("_toc"), ~F.col("_open")
    kind = (
        F.when(~toc & (F.col("line_no") < F.col("_last")) & (t == ""), point("paragraph_break", 100, F.col("_after")))
        .when(~toc & heads, point("header", 90, before))
        .when(toc & (t == "") & whole_entry, F.when(~F.col("_soon3").startswith("["), point("toc_end", 95, F.col("_after"))))
        .when(~toc & t.rlike(r"^([-*+]|[0-9]+\.)\s"), point("list_item", 80, before))
        .when(~toc & whole_entry & t.rlike(r"[.!?]$"), point("sentence_end", 70, F.col("_after")))
        .when(~toc & whole_entry & t.endswith(":"), point("colon_end", 60, F.col("_after")))
        .when(~toc & whole_entry, point("line_break", 30, F.col("_after")))
        .when(toc & whole_entry, point("toc_safe_break", 15, F.col("_after")))
    )
    return rows.withColumn("_p", kind).where("_p is not null").select("doc_id", "line_no", F.col("_p.position").alias("position"), F.col("_p.kind").alias("kind"), F.col("_p.priority").alias("priority"))


def best_splits(docs: DataFrame, limit: int = LIMIT, share: float = 0.75) -> DataFrame:
    """``doc_id, position, score``: where each text beyond the limit is best split, near ``share`` of it; first of equals."""
    long = docs.where(token_count(F.col("text")) > limit)
    target = F.floor(F.length("text") * int(limit * share) / token_count(F.col("text")))
    targets = long.select("doc_id", target.alias("target"))
    near = split_points(long).join(targets, "doc_id").where("position between target * 0.3 and target * 1.5")
    scored = near.withColumn("score", F.col("priority") * (1 - F.abs(F.col("position") - F.col("target")) / F.col("target")))
    best = scored.where("score > -1").groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("position")).alias("_p"))).alias("b"))
    return best.select("doc_id", (-F.col("b._p")).alias("position"), F.col("b.score").alias("score"))


#: Line ends that ``strip`` keeps but ``$`` in a pattern looks past.
_ENDS = ("\x85", "\u2028", "\u2029")
_CONTENTS = re.compile("contents", re.I | re.A)
_ENTRY_BEGINS = re.compile(r"\[[^\[\]]*\Z")
_ENTRY = re.compile(r"\[[^\]]+\]\s*\[[^\]]+\]\([^)]+\)", re.A)
_ITEM = re.compile(r"([-*+]|[0-9]+\.)\s", re.A)
_SENTENCE = re.compile(r"[.!?][\x85\u2028\u2029]?\Z")


def _stripped(text: str) -> str:
    """``strip`` of a text in Python."""
    end = text[-1:] if text.endswith(_ENDS) else ""
    return text[: len(text) - len(end)].strip(" \t\n\x0b\f\r") + end


def _points(lines: list[str], first: str, k: int, starts: list[int], begin: int, until: float) -> Iterator[tuple[int, int]]:
    """``position, priority`` of ``split_points`` for what is left of a text from ``begin`` on, up to a position; line ``k`` is the first, as far as it is left."""
    toc = unfinished = False
    soon = lambda n: next((x for x in lines[k + 1 : k + 1 + n] if x), "[")
    while k < len(lines) and (before := max(starts[k] - begin, 0)) <= until:
        t, after = lines[k] if starts[k] >= begin else first, starts[k + 1] - begin
        named, heads = _CONTENTS.search(t) is not None, t.startswith("#")
        leaves = t == "" and not soon(2).startswith("[")
        toc = named or (toc and not heads and not leaves)
        if named or heads or leaves:
            unfinished = False
        elif toc and _ENTRY_BEGINS.match(t):
            unfinished = True
        elif toc and (t.endswith(")") or "](" in t or _ENTRY.match(t)):
            unfinished = False
        if not toc and t == "" and k + 1 < len(lines):
            yield after, 100
        elif not toc and heads:
            yield before, 90
        elif toc and t == "" and not unfinished:
            if not soon(3).startswith("["):
                yield after, 95
        elif not toc and _ITEM.match(t):
            yield before, 80
        elif not unfinished:
            yield after, 15 if toc else 70 if _SENTENCE.search(t) else 60 if t.endswith(":") else 30
        k += 1


def _cuts(text: str, limit: int, shares: tuple[float, ...] = (0.75, 0.6)) -> Iterator[int]:
    """Where ``split_long`` cuts a text, in order. A cut looks at the lines near it only, so the work grows with the text."""
    begin, k, size = 0, 0, len(text)
    if size // 4 <= limit:
        return
    lines = text.split("\n")
    starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
    lines = [_stripped(x) for x in lines]

    def at_line(at: int) -> int:
        """The end of the last line before a place, or the place if there is no such line."""
        back = text.rfind("\n", begin, begin + at) - begin
        return back + 1 if back > 0 else at

    while (tokens := (size - begin) // 4) > limit:
        while starts[k + 1] <= begin:
            k += 1
        targets = [(size - begin) * int(limit * share) // tokens for share in shares]
        until, points = max(targets) * 1.5, []
        if starts[k + 1] - begin <= until:  # else no place is near
            points = list(_points(lines, _stripped(text[begin : starts[k + 1] - 1]), k, starts, begin, until))
        tried = []
        for target in targets:
            scored = [(priority * (1 - abs(at - target) / target), -at) for at, priority in points if target * 0.3 <= at <= target * 1.5 and at > 0]
            tried.append(-max(scored)[1] if scored else max(at_line(target), 1))
        tried.append(at_line((size - begin) * limit // (2 * tokens)))
        at = next((x for x in tried if x > 0 and len(_stripped(text[begin : begin + x])) // 4 <= limit), max((size - begin) // 3, 1))
        begin += at
        if begin >= size:
            return
        yield begin


def long_parts(text: Column, limit: int = LIMIT) -> Column:
    """The parts of ``split_long`` for a text, as an array; a null text is one null part."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str | None]:
            if x is None:
                return [None]
            cuts = list(_cuts(x, limit))
            return [x[a:b] for a, b in zip([0, *cuts], [*cuts, len(x)], strict=True)]

        return texts.map(one)

    return parts(text)


def split_long(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, part, content`` of texts split again and again where that is best, until the rest is within the limit.

    Each step cuts one part off the front of a text that is still too long, at
    three quarters of the limit or, where that part would be too long, at 60 %. Without
    a place to split it cuts at the last line break before that length, or there. A part that is
    still too long gives way to half the limit, and that to a third of the text. There is no bound on
    the number of parts. Places are those of ``best_splits`` for what is left. Each row is split by itself, so
    repeated or null ids do no harm.
    """
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", F.posexplode(long_parts(F.col("text"), limit)).alias("part", "content"))


def headed_sections(docs: DataFrame) -> DataFrame:
    """``doc_id, position, level, path, content, length, is_table``: sections with their heading lines, in order.

    A heading without text of its own goes with the deeper one that follows it. ``path`` holds the
    headings in force, level by level; blank sections are left out.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = heading_paths(markdown_lines(docs)).withColumn("_section", F.sum(F.col("level").isNotNull().cast("int")).over(upto))
    body = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    path = F.array(*[F.max_by(f"h{k}", "line_no") for k in range(1, 7)])
    text = F.coalesce(F.bool_or(F.col("level").isNull() & (strip(F.col("line")) != "")), F.lit(False))
    parts = placed.groupBy("doc_id", "_section").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level"), path.alias("path"), strip(F.array_join(body, "\n")).alias("content"), text.alias("_text")).where("content <> ''")
    by = Window.partitionBy("doc_id").orderBy("_section")
    follows = ~F.lag("_text").over(by) & (F.lag("level").over(by) < F.col("level"))
    parts = parts.withColumn("_run", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    contents = F.transform(F.array_sort(F.collect_list(F.struct("_section", "content"))), lambda x: x["content"])
    out = parts.groupBy("doc_id", "_run").agg(F.max_by("level", "_section").alias("level"), F.max_by("path", "_section").alias("path"), F.array_join(contents, "\n").alias("content"))
    position = (F.row_number().over(Window.partitionBy("doc_id").orderBy("_run")) - 1).cast("int")
    return out.select("doc_id", position.alias("position"), "level", F.slice("path", 1, F.greatest(F.col("level"), F.lit(0))).alias("path"), "content", token_count(F.col("content")).alias("length"), is_table(F.col("content")).alias("is_table"))


def effective_level(content: Column, level: Column) -> Column:
    """The level of the parent for a section that opens with its parent's heading, with nothing but rules between the two; else its own."""
    kept = F.filter(F.transform(F.split(content, "\n", -1), strip), lambda x: (x != "") & ~x.startswith("---") & ~x.startswith("==="))
    marks = F.transform(kept, lambda x: F.length(F.regexp_extract(x, "^(#*)", 1)))
    pairs = F.zip_with(F.slice(marks, 1, F.greatest(F.size(marks) - 1, F.lit(0))), F.slice(marks, 2, F.greatest(F.size(marks) - 1, F.lit(0))), lambda a, b: (a > 0) & (b > a) & (a == level - 1))
    return F.when((level > 1) & F.exists(pairs, lambda x: x), level - 1).otherwise(level)


def _groups(levels: list[int], paths: list[list[str]], size: list[int], limit: int) -> list[list[int]]:
    """The sections of a document that become one, by their places, as ``merge_sections`` says; ``size`` is changed."""
    children: dict[int, list[int]] = {k: [] for k in range(-1, len(levels))}
    open_nodes: list[int] = []
    for k, (level, path) in enumerate(zip(levels, paths, strict=True)):
        while open_nodes and not (levels[open_nodes[-1]] < level and path[: levels[open_nodes[-1]]] == paths[open_nodes[-1]][: levels[open_nodes[-1]]]):
            open_nodes.pop()
        children[open_nodes[-1] if open_nodes else -1].append(k)
        open_nodes.append(k)
    groups = {k: [k] for k in range(len(levels))}  # the sections that now are one with k
    for k in range(len(levels) - 1, -2, -1):  # a parent comes before its children, so these are done
        kept: list[int] = []
        for child in children[k]:
            last = kept[-1] if kept else None
            same = last is not None and not children[child] and not children[last] and levels[last] == levels[child] and paths[last][: levels[last] - 1] == paths[child][: levels[child] - 1]
            if same and size[last] + size[child] <= limit:
                groups[last] += groups.pop(child)
                size[last] += size[child]
            else:
                kept.append(child)
        children[k] = kept
        if k >= 0 and len(kept) == 1 and not children[kept[0]] and size[k] + size[kept[0]] <= limit:
            groups[k] += groups.pop(kept[0])
            size[k] += size[kept[0]]
            children[k] = []
    return [members for _, members in sorted(groups.items())]


def merge_sections(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``headed_sections`` rows merged bottom-up under the limit, with ``merged_from`` (positions) and ``merge_count``.

    Sections form a tree: a section's parent is the nearest one before it of a lower level whose
    headings its own begin with. From the leaves up, neighbouring children without children of their own become one
    section while their lengths add up to no more than the limit; a parent takes in its child if it
    has a single one, without children. Merged lengths are sums. One row holds the sections of one document.
    """

    @F.arrow_udf("array<array<int>>")
    def merged(levels: pa.Array, paths: pa.Array, lengths: pa.Array) -> pa.Array:
        documents = zip(levels.to_pylist(), paths.to_pylist(), lengths.to_pylist(), strict=True)
        return pa.array([_groups(*document, limit) for document in documents], pa.list_(pa.list_(pa.int32())))

    bound_batches(parts.sparkSession)
    row = F.struct("position", "level", "path", "content", "length", "is_table", effective_level(F.col("content"), F.col("level")).alias("_level"))
    listed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    grouped = listed.withColumn("_groups", merged("_rows._level", "_rows.path", "_rows.length"))

    def one(members: Column) -> Column:
        of = lambda field: F.transform(members, lambda k: F.get("_rows", k)[field])
        first = F.get("_rows", F.get(members, F.lit(0)))
        return F.struct(
            first["level"].alias("level"), first["path"].alias("path"), F.array_join(of("content"), "\n\n").alias("content"), F.aggregate(of("length"), F.lit(0), lambda n, x: n + x).alias("length"),
            F.exists(of("is_table"), lambda x: x).alias("is_table"), of("position").alias("merged_from"), F.size(members).alias("merge_count"),
        )

    return grouped.select("doc_id", F.posexplode(F.transform("_groups", one)).alias("position", "_m")).select("doc_id", "position", "_m.*")


def split_oversized(parts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Sections beyond the limit split by ``split_long``, but for tables, which stay whole.

    Further columns: ``split_from`` (the section's position), ``part`` ("2/3") and ``original_length`` of split ones.
    """
    bound_batches(parts.sparkSession)
    parts = Store(parts.sparkSession, "oversized").save(parts, "parts")  # read twice
    long = F.col("length").cast("int") > limit
    whole = parts.where(~long | F.col("is_table")).withColumns({"split_from": F.lit(None).cast("int"), "part": F.lit(None).cast("string"), "original_length": F.lit(None).cast("int"), "_part": F.lit(0)})
    cut = parts.where(long & ~F.col("is_table")).withColumn("_texts", F.filter(F.transform(long_parts(F.col("content"), limit), strip), lambda x: x != ""))
    # By the outer form, as a filter on what is exploded would cut all texts a second time.
    out = cut.select("*", F.posexplode_outer("_texts").alias("_k", "_text")).where("_text is not null").withColumns({"split_from": F.col("position"), "part": F.concat_ws("/", (F.col("_k") + 1).cast("string"), F.size("_texts").cast("string")), "original_length": F.col("length"), "_part": F.col("_k")})
    out = out.withColumn("content", F.col("_text")).withColumn("length", token_count(F.col("content")))
    out = whole.unionByName(out.select(*whole.columns))
    place = (F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "_part")) - 1).cast("int")
    return out.withColumn("position", place).drop("_part")


def formatted(parts: DataFrame, file_name: Column) -> DataFrame:
    """Chunks as they are handed on: ``chunk_id, embedding, lenght, metadata(H1 .. H6, file_name, position), chunk_text``.

    The name ``lenght`` and the text "None" for a vector to come are those of the format; positions count from 1.
    """
    heads = [F.try_element_at("path", F.lit(k)).alias(f"H{k}") for k in range(1, 7)]
    metadata = F.struct(*heads, file_name.alias("file_name"), (F.col("position") + 1).alias("position"))
    chunk = make_id(F.lit("chunk"), F.concat_ws("/", F.col("doc_id").cast("string"), F.col("position").cast("string")))
    return parts.select(chunk.alias("chunk_id"), F.lit("None").alias("embedding"), F.col("length").cast("string").alias("lenght"), metadata.alias("metadata"), F.col("content").alias("chunk_text"))


def document_chunks(docs: DataFrame, limit: int = LIMIT, file_name: Column | None = None) -> DataFrame:
    """Markdown documents as formatted chunks: sections, merged under the limit, split beyond it."""
    parts = split_oversized(merge_sections(headed_sections(docs), limit), limit)
    return formatted(parts, F.concat(F.col("doc_id").cast("string"), F.lit(".md")) if file_name is None else file_name)
