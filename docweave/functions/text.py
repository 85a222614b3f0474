"""Column functions over text: cleaning, splitting, detectors and parsers.

All of them are expressions that run in the JVM. Positions and lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords, in English, Vietnamese, Japanese and Chinese.
STOP_WORDS = (
    "the a an and or but in on at to for of with by what how when where why which who is are was were be been being "
    "have has had do does did will would could should may might can this that these those "
    "là của có được một các trong cho với về từ khi như để hay này đó sẽ đã và hoặc nhưng nếu thì "
    "は が を に で と の も から まで より へ や です である だ であり として について において による "
    "的 了 在 是 我 有 和 就 不 人 都 一 个 上 也 很 到 说 要 去 你 会 着 没有 看"
).split()
#: Blocks of Chinese, Japanese and Korean characters.
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambdas ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, newlines included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last dot and what follows, or nothing."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def file_type(path: Column) -> Column:
    """docx, pdf or excel by extension (case counts); anything else is an error."""
    end = extension(path)
    return (
        F.when(end.isin(".docx", ".doc"), "docx")
        .when(end == ".pdf", "pdf")
        .when(end.isin(".xlsx", ".xls"), "excel")
        .otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), end)))
    )


def is_allowed_upload(name: Column, size: Column, most: int = 100 * 1024 * 1024) -> Column:
    """Whether the lower-cased extension is one that uploads may have, and the size within the limit."""
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin("pdf", "docx", "xlsx", "txt") & (size <= most)


def content(*columns: str) -> Column:
    """The first of several text columns that is not null."""
    return F.coalesce(*map(F.col, columns))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def any_keyword(texts: list[Column], keywords: Column) -> Column:
    """Whether any text holds any keyword, ignoring case; null texts hold none."""
    return F.exists(keywords, lambda k: reduce(lambda a, b: a | b, [contains_ignoring_case(F.coalesce(t, F.lit("")), k) for t in texts]))


def cell(value: Column) -> Column:
    """A table cell for Markdown; null is empty."""
    text = F.coalesce(strip(value.cast("string")), F.lit(""))
    for old, new in (("\n", "<br>"), ("\r", ""), ("|", "&#124;"), ("*", "\\*"), ("_", "\\_")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def table_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def table_separator(n: int) -> Column:
    return F.lit("| " + " | ".join(["---"] * n) + " |")


def file_name_plain(name: Column) -> Column:
    """Only ASCII letters, digits, blanks, brackets and dashes; runs of blanks become one."""
    return strip(F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9\s()\[\]-]", "-"), r"\s+", " "))


def file_name_safe(name: Column) -> Column:
    """Without the characters that file systems reserve."""
    return strip(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "-"), r"\s+", " "))


def heading_level(text: Column, font_size: Column, bold: Column) -> Column:
    """1 to 4 for text that looks like a heading, else 0."""
    t = strip(text)
    # The patterns, limits and levels, in their order.
    return (
        F.when(F.length(t) > 150, 0)
        .when(t.rlike(r"(?i)^RFP:\s*Banking\s*Services\s*$"), 0)
        .when(t.rlike(r"^[0-9]+$"), 0)
        .when(t.rlike(r"(?i)^REQUEST FOR PROPOSAL") | t.rlike(r"(?i)^SECTION\s+[IVX0-9]+"), 1)
        .when(t.rlike(r"^[A-Z]\.?\s+[A-Z]") | t.rlike(r"^(Introduction|Questions|Submission|Award|Note)$"), 2)
        .when(t.rlike(r"^[0-9]+\.?\s+[A-Z]"), 3)
        .when((font_size >= 13) & bold & (F.length(t) < 80), 4)
        .otherwise(0)
    )


def markdown_heading(line: Column) -> Column:
    """``struct(level, title)`` of a heading line, else null; backslashes and anchors are dropped from titles."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s+(.*)", 1)
    title = F.regexp_replace(F.regexp_replace(F.regexp_extract(line, r"^(#{1,6})\s+(.*)", 2), r"\\", ""), r"\[¶\]\([^)]*\)", "")
    return F.when(marks != "", F.struct(F.length(marks).alias("level"), strip(title).alias("title")))


def has_pipe_table(text: Column) -> Column:
    return text.rlike(r"(?m)^\|.*\|$")


def is_table(text: Column) -> Column:
    """Whether text is a table: a grid, aligned pipe rows, or pipe rows with a separator line."""
    once = lambda x, then: F.get(F.transform(F.array(x), then), F.lit(0))

    def places(line: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

        def step(state: Column, part: Column) -> Column:
            at = state["at"] + F.length(part) + 1
            return F.struct(at.alias("at"), F.array_append(state["found"], at).alias("found"))

        # What stands before the first mark, between two of them, and behind the last one.
        return F.aggregate(F.split(line, r"\|", -1), start, step, lambda s: F.slice(s["found"], F.lit(1), F.size(s["found"]) - 1))

    def piped(lines: Column, rows: Column) -> Column:
        separator = F.exists(lines, lambda x: x.rlike(r"^[-| \t:]*$") & F.contains(x, F.lit("|")) & F.contains(x, F.lit("-")))
        aligned = once(places(F.get(rows, F.lit(0))), lambda first: F.exists(F.slice(rows, 2, 4), lambda x: F.size(F.array_intersect(places(x), first)) * 2 >= F.size(first)))
        return (F.size(rows) >= 2) & (separator | ((F.size(rows) >= 3) & aligned))

    def table(lines: Column) -> Column:
        grid = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-+=|][-+=| \t]*$") & x.rlike(r"[+=]"))) >= 2
        return (F.size(lines) >= 2) & (grid | once(F.filter(lines, lambda x: F.contains(x, F.lit("|"))), lambda rows: piped(lines, rows)))

    return F.coalesce(once(F.split(strip(text), "\n"), table), F.lit(False))


def is_empty_heading(text: Column) -> Column:
    """Whether a chunk holds nothing but a heading mark."""
    t = strip(text)
    return t.rlike(r"^#+\s*\{[^}]*\}\s*$") | t.rlike(r"^#+\s*$") | ((F.length(t) < 30) & F.contains(t, F.lit("#")) & (F.length(strip(F.replace(t, F.lit("#"), F.lit("")))) < 5))


def sentences(text: Column) -> Column:
    """Split where white space follows . ! or ? and a capital letter comes next."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z])", -1)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def tidy_markdown(text: Column) -> Column:
    """Repairs of converted Markdown: image marks, page marks, blank lines, doubled heading marks."""
    out = F.replace(text, F.lit("![IMAGE_DESCRIPTION]:"), F.lit("[IMAGE_DESCRIPTION]:"))
    for mark in (r"# Page \| [0-9]+", r"Page \| [0-9]+", r"===+ PAGE [0-9]+ ===+", r"--- PAGE [0-9]+ ---", r"Page [0-9]+"):
        out = F.regexp_replace(out, "(?i)" + mark, "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?m)^#\s+#\s+", "## ")
    out = F.regexp_replace(out, r"(?m)^#\s+#\s+#\s+", "### ")
    out = F.regexp_replace(out, r"(?m)^#\s+#\s+##\s+", "### ")
    out = F.regexp_replace(out, r"(?m)^(#+)\s+\1\s+", "$1$1 ")
    return strip(F.regexp_replace(out, r"\n(\[IMAGE_DESCRIPTION\]:)", "\n\n$1"))


def without_fences(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"```(json)?", ""))


def json_block(text: Column) -> Column:
    """The outermost braces of an answer and what they enclose; null without any."""
    return F.nullif(F.regexp_extract(without_fences(text), r"(?s)\{.*\}", 0), F.lit(""))


def json_block_with(text: Column, first: str, second: str) -> Column:
    """Braces that hold arrays of both keys, the first before the second, and no braces outside them; else those of ``json_block``."""
    array = r"[^{}]*\[[^\]]*\][^{}]*"
    both = F.regexp_extract(without_fences(text), rf'\{{[^{{}}]*"{first}"{array}"{second}"{array}\}}', 0)
    return F.coalesce(F.nullif(both, F.lit("")), json_block(text))


def parsed(text: Column, schema: str) -> Column:
    """JSON text by a schema; null and text that is no JSON give a struct without values instead of null."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.lit("{}"), schema))


def parse_answer(text: Column) -> Column:
    """``struct(answer, answerable, related_context)`` of a reply in three parts; other replies are answers as they are."""
    parts = F.split(text, "========", -1)
    part = lambda k, label: strip(F.replace(F.get(parts, F.lit(k)), F.lit(label), F.lit("")))
    whole = F.size(parts) >= 3
    return F.struct(
        F.when(whole, part(0, "Answer:")).otherwise(strip(text)).alias("answer"),
        F.when(whole, F.lower(part(1, "Answerable:")).isin("true", "yes", "có", "đúng")).otherwise(strip(text) != "").alias("answerable"),
        F.when(whole, part(2, "Related Context:")).otherwise("").alias("related_context"),
    )


def marked_chunks(text: Column) -> Column:
    """The parts between chunk marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)===CHUNK START===(.*?)===CHUNK END==="), F.lit(1)), strip)


def is_cjk(word: Column) -> Column:
    return word.rlike(CJK)


def keywords(text: Column, most: int = 10) -> Column:
    """Up to ``most`` different keywords, in alphabetical order."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    letters = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", ""))

    def wanted(w: Column) -> Column:
        # Cheap tests first: most words are decided before a pattern is tried.
        share = letters(w) / F.length(w)
        return (F.length(w) <= 20) & ~w.isin(STOP_WORDS) & ((F.length(w) >= 2) | is_cjk(w)) & ~w.rlike(r"^\p{N}+$") & (share >= F.when(F.length(w) <= 5, 0.6).otherwise(0.4))

    return F.slice(F.array_sort(F.filter(found, wanted)), 1, most)


def token_count(text: Column) -> Column:
    """An estimate of tokens that needs no vocabulary: a quarter of the characters."""
    return F.floor(F.length(text) / 4).cast("int")


def words_for_tokens(tokens: Column) -> Column:
    return (tokens * 0.75).cast("int")


def confidence(answer: Column, context: Column, answerable: Column) -> Column:
    return F.when(answerable, F.least(F.lit(0.9), F.length(context) / 1000 * 0.5 + F.length(answer) / 500 * 0.4)).otherwise(0.0)


def make_id(kind: Column, key: Column) -> Column:
    """An id that the same key always gets; 128 bits, so that no two keys share one at any size."""
    return F.concat(F.lower(kind), F.lit("_"), F.substring(F.sha2(key, 256), 1, 32))


def column_list(value: Column) -> Column:
    return F.transform(F.split(value, ","), strip)


def describe(kind: Column, name: Column, properties: Column) -> Column:
    """A sentence about a node without description, from its kind and map of properties."""
    get = lambda key: F.try_element_at(properties, F.lit(key))
    filled = lambda c: c.isNotNull() & (c != "")
    pairs = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: ~k.isin("entity_type", "name") & filled(v))))
    listed = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    table = F.coalesce(get("table_name"), get("name"), name)
    relation = F.coalesce(get("relationship_type"), F.lit("relationship"))
    # The sentences' wording, the misspelling of the last but one included.
    return (
        F.when(kind == "Table", F.when(filled(get("columns")), F.format_string("Table '%s' containing columns: %s", table, get("columns"))).otherwise(F.format_string("Table entity named '%s'", table)))
        .when(kind == "Item", F.format_string("An %s record named '%s'", F.coalesce(get("item_type"), F.lit("item")), name))
        .when(
            kind == "Relationship",
            F.when(filled(get("source")) & filled(get("target")), F.format_string("A %s relationship connecting %s to %s", relation, get("source"), get("target"))).otherwise(F.format_string("A %s relationship connecting entitites", relation)),
        )
        .when(F.size(pairs) > 0, F.format_string("A %s entity named '%s' with %s", kind, name, listed))
        .otherwise(F.format_string("A %s entity named '%s'", kind, name))
    )


def prefixed(properties: Column, prefix: str = "prop:") -> Column:
    return F.transform_keys(properties, lambda k, _: F.concat(F.lit(prefix), k))


def merged(base: Column, over: Column) -> Column:
    """Both maps; where both have a key, ``over`` decides."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def cell_address(row: Column, column: Column) -> Column:
    """A spreadsheet address of a one-based row and column, such as B7 or AA3."""
    c = column - 1
    one, two, three = c < 26, c < 26 + 26 * 26, F.lit(True)
    letter = lambda n: F.char((n % 26) + 65)
    d, e = (c - 26), (c - 26 - 676)
    name = F.when(one, letter(c)).when(two, F.concat(letter(F.floor(d / 26)), letter(d))).when(three, F.concat(letter(F.floor(e / 676)), letter(F.floor(e / 26)), letter(e)))
    return F.concat(name, row.cast("string"))


def row_and_column(address: Column) -> Column:
    """``struct(row, column)``, one-based, of an address such as B7 or AA3; null for anything else."""
    letters, digits = F.regexp_extract(address, "^([A-Z]{1,3})([0-9]+)$", 1), F.regexp_extract(address, "^([A-Z]{1,3})([0-9]+)$", 2)
    number = F.aggregate(F.split(letters, ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)
    return F.when(letters != "", F.struct(digits.cast("int").alias("row"), number.alias("column")))


def fill(template: str, **values: Column) -> Column:
    """A template's ``{name}`` places filled with columns; nulls fill with nothing."""
    parts, rest = [], template
    while rest:
        places = [(rest.index("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not places:
            break
        at, name = min(places)
        parts += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))


def kilobytes(size: Column) -> Column:
    """With one decimal: the nearest to the number as it is in binary, of two the even one, as C and Python print it."""
    return F.concat(F.call_function("format_number", size / 1024.0, F.lit("0.0")), F.lit(" KB"))


def preview(text: Column, most: int = 500) -> Column:
    """The text, or its start and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def iso_stamp(stamp: Column) -> Column:
    """A time as ISO text with microseconds."""
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso(text: Column) -> Column:
    """A time from ISO text, with or without fractions; null for anything else."""
    return F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")))


def local_time(stamp: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    return F.date_format(F.from_utc_timestamp(stamp, zone), "yyyy-MM-dd HH:mm:ss")


def first_label(response: Column, labels: Column, compat: bool = False) -> Column:
    """The first label that holds the response or that it holds, ignoring case; else ``Unknown``.

    With ``compat`` the responses "unknown" and "" select the first label.
    """
    said = F.lower(strip(response))
    fits = lambda x: F.contains(said, F.lower(x)) | F.contains(F.lower(x), said)
    usual = F.filter(labels, lambda x: fits(x) & (F.lit(compat) | ((said != "") & (said != "unknown"))) | (F.lit(compat) & (said == "unknown")))
    return F.coalesce(F.try_element_at(usual, F.lit(1)), F.lit("Unknown"))
