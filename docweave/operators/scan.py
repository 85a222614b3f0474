"""Page layout from marks: lines, blocks, tables and images of scanned pages.

Everything is windows over the marks of a page and joins on path and page, so a
corpus is split by page. ``marks`` are the rows of ``docweave.sources.pdf``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.layout import distinct_images, outside_tables
from docweave.operators.retrieval import budget_context

_PAGE = ("path", "page")
#: Parts of a line's height: baselines that differ less are one line, larger gaps part words, and still larger ones parts of a line.
SAME_LINE, WORD_GAP, PART_GAP = 0.4, 0.2, 1.2
#: Distance up to which lines and edges count as one, in points.
NEAR = 3.0


def _islands(df: DataFrame, keys: list[str], start: str, end: str, gap: float | Column, name: str) -> DataFrame:
    """With ``name``: the number of each row's group of intervals that lie within ``gap`` of one another."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col(start) > reach + gap)).cast("int")
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def line_parts(marks: DataFrame) -> DataFrame:
    """``path, page, line, part, x0, y0, x1, y1, size, font, seq, content``: what stands in one line without a wide gap, in words.

    ``line`` numbers the lines of a page from the top, ``part`` those of a line from the left.
    """
    runs = marks.where("kind = 'text'").withColumn("_base", F.round(F.col("y1") - 0.2 * F.col("size"), 2))
    by_base = Window.partitionBy(*_PAGE).orderBy("_base", "x0")
    fresh = F.coalesce(F.col("_base") - F.lag("_base").over(by_base) > SAME_LINE * F.col("size"), F.lit(True)).cast("int")
    lined = runs.withColumn("_fresh", fresh).withColumn("line", F.sum("_fresh").over(by_base.rowsBetween(Window.unboundedPreceding, 0)))
    by_x = Window.partitionBy(*_PAGE, "line").orderBy("x0", "seq")
    gap = F.col("x0") - F.max("x1").over(by_x.rowsBetween(Window.unboundedPreceding, -1))
    parted = lined.withColumn("_gap", gap).withColumn("part", F.sum((F.coalesce(F.col("_gap"), F.lit(0.0)) > PART_GAP * F.col("size")).cast("int")).over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    word = F.concat(F.when(F.col("_gap") > WORD_GAP * F.col("size"), " ").otherwise(""), F.col("content"))
    pieces = F.array_sort(F.collect_list(F.struct("x0", "seq", word.alias("w"))))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(pieces, lambda p: p["w"]), ""), r"\s+", " "))
    first = lambda c: F.min_by(c, F.struct("x0", "seq"))
    return parted.groupBy(*_PAGE, "line", "part").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), first("size").alias("size"), first("font").alias("font"), F.min("seq").alias("seq"), text.alias("content"))


def text_blocks(parts: DataFrame) -> DataFrame:
    """``path, page, x0, y0, x1, y1, size, font, seq, kind, content``: parts of one column, font size and close lines together.

    Columns are runs of widths that do not meet; a block ends where a line's gap is left free or the size of the letters changes.
    """
    columns = _islands(parts, [*_PAGE], "x0", "x1", NEAR, "column")
    order = Window.partitionBy(*_PAGE, "column").orderBy("line", "part")
    far = (F.col("y0") - F.lag("y1").over(order) > 0.6 * F.col("size")) | (F.abs(F.col("size") - F.lag("size").over(order)) > 0.5) | (F.col("line") == F.lag("line").over(order))
    fresh = F.coalesce(far, F.lit(True)).cast("int")
    blocked = columns.withColumn("_fresh", fresh).withColumn("block", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part", "content"))), lambda p: p["content"]), "\n")
    first = lambda c: F.min_by(c, F.struct("line", "part"))
    boxes = blocked.groupBy(*_PAGE, "column", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), first("size").alias("size"), first("font").alias("font"), F.min("seq").alias("seq"), text.alias("content"))
    return boxes.select(*_PAGE, "x0", "y0", "x1", "y1", "size", "font", "seq", F.lit("text").alias("kind"), "content")


def _edges(rules: DataFrame, along: str) -> DataFrame:
    """``path, page, region, k, at``: the distinct places of a region's rules, numbered; ones within ``NEAR`` are one."""
    keys = [*_PAGE, "region"]
    placed = rules.select(*keys, F.col(along).alias("at"), F.col(along).alias("_end"))
    return _islands(placed, keys, "at", "_end", NEAR, "_k").groupBy(*keys, "_k").agg(F.avg("at").alias("at")).select(*keys, (F.col("_k") - 1).alias("k"), "at")


def ruled_tables(marks: DataFrame, parts: DataFrame) -> DataFrame:
    """``path, page, x0, y0, x1, y1, rows``: tables that ruling lines draw, with the texts in their cells.

    Rules that touch make a region, by sweeping over their heights, then their widths, then the heights again. Its
    vertical and horizontal rules cut it into cells. Where the rule between two cells is not drawn they are one: the text
    stands in the first, and the others are null. Empty cells are blank.
    """
    keys = [*_PAGE, "region"]
    rules = marks.where("kind = 'rule'").select(*_PAGE, "x0", "y0", "x1", "y1", (F.col("x1") - F.col("x0") < F.col("y1") - F.col("y0")).alias("upright"))
    swept = _islands(rules, [*_PAGE], "y0", "y1", NEAR, "_a")
    swept = _islands(swept, [*_PAGE, "_a"], "x0", "x1", NEAR, "_b")
    swept = _islands(swept, [*_PAGE, "_a", "_b"], "y0", "y1", NEAR, "_c").withColumn("region", F.concat_ws(".", "_a", "_b", "_c")).drop("_a", "_b", "_c")
    upright, level = swept.where("upright"), swept.where("not upright")

    def spans(edges: DataFrame, k: str, low: str, high: str) -> DataFrame:
        by = Window.partitionBy(*keys).orderBy("k")
        return edges.select(*keys, F.col("k").alias(k), F.col("at").alias(low), F.lead("at").over(by).alias(high)).where(F.col(high).isNotNull())

    across, down = spans(_edges(upright, "x0"), "i", "left", "right"), spans(_edges(level, "y0"), "j", "top", "bottom")
    cells = across.join(down, keys)

    def drawn(lines: DataFrame, at: str, place: str, low: str, high: str, first: str, last: str, name: str) -> DataFrame:
        """The cells with a rule at ``place`` that covers their middle."""
        r = lines.select(*keys, F.col(at).alias("_at"), F.col(low).alias("_low"), F.col(high).alias("_high"))
        mid = (F.col(first) + F.col(last)) / 2
        return cells.join(r, keys).where((F.abs(F.col("_at") - F.col(place)) <= NEAR) & F.col("_low").__le__(mid) & F.col("_high").__ge__(mid)).select(*keys, "i", "j").distinct().withColumn(name, F.lit(True))

    begun = cells.join(drawn(upright, "x0", "left", "y0", "y1", "top", "bottom", "_l"), [*keys, "i", "j"], "left").join(drawn(level, "y0", "top", "x0", "x1", "left", "right", "_t"), [*keys, "i", "j"], "left")
    begun = begun.withColumn("ai", F.coalesce(F.last(F.when(F.col("_l"), F.col("i")), True).over(Window.partitionBy(*keys, "j").orderBy("i")), F.lit(0)))
    begun = begun.withColumn("aj", F.coalesce(F.last(F.when(F.col("_t"), F.col("j")), True).over(Window.partitionBy(*keys, "i").orderBy("j")), F.lit(0)))
    p = parts.select(*_PAGE, ((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("y0") + F.col("y1")) / 2).alias("_y"), "line", "part", "content")
    inside = begun.join(p, [*_PAGE]).where("_x >= left and _x < right and _y >= top and _y < bottom")
    said = inside.groupBy(*keys, F.col("ai").alias("i"), F.col("aj").alias("j")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part", "content"))), lambda x: x["content"]), " ").alias("said"))
    filled = begun.join(said, [*keys, "i", "j"], "left")
    value = F.when((F.col("ai") == F.col("i")) & (F.col("aj") == F.col("j")), F.coalesce("said", F.lit("")))
    lines = filled.groupBy(*keys, "j").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("_c"), F.min("left").alias("x0"), F.max("right").alias("x1"), F.min("top").alias("y0"), F.max("bottom").alias("y1"))
    tables = lines.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("j", F.transform("_c", lambda c: c["v"]).alias("r")))).alias("_r"))
    return tables.select(*_PAGE, "x0", "y0", "x1", "y1", F.transform("_r", lambda r: r["r"]).alias("rows")).where((F.size("rows") > 1) | (F.size(F.get("rows", 0)) > 1))


def aligned_tables(parts: DataFrame, least: int = 3) -> DataFrame:
    """``path, page, x0, y0, x1, y1, rows``: runs of at least ``least`` close lines with as many parts each, which begin or end below one another."""
    by = Window.partitionBy(*_PAGE).orderBy("line")
    lists = F.array_sort(F.collect_list(F.struct("part", "x0", "x1", "content")))
    lines = parts.groupBy(*_PAGE, "line").agg(lists.alias("cells"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"))
    lines = lines.withColumn("_above", F.lag("cells").over(by)).withColumn("_end", F.lag("y1").over(by))
    below = F.forall(F.arrays_zip(F.col("cells").alias("a"), F.col("_above").alias("b")), lambda z: F.least(F.abs(z["a"]["x0"] - z["b"]["x0"]), F.abs(z["a"]["x1"] - z["b"]["x1"])) <= NEAR)
    goes_on = (F.size("cells") > 1) & (F.size("cells") == F.size("_above")) & (F.col("y0") - F.col("_end") <= 1.5 * F.col("size")) & below
    runs = lines.withColumn("_run", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = F.array_sort(F.collect_list(F.struct("line", F.transform("cells", lambda c: c["content"]).alias("r"))))
    tables = runs.groupBy(*_PAGE, "_run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), rows.alias("_r"))
    return tables.where(F.size("_r") >= least).select(*_PAGE, "x0", "y0", "x1", "y1", F.transform("_r", lambda r: r["r"]).alias("rows"))


def page_tables(marks: DataFrame) -> DataFrame:
    """All tables of pages: the ruled ones, and aligned ones outside of them."""
    parts = line_parts(marks)
    ruled = ruled_tables(marks, parts)
    return ruled.unionByName(aligned_tables(outside_tables(parts, ruled)))


def page_images(marks: DataFrame, budget: int = 200) -> DataFrame:
    """``path, page, seq, x0, y0, x1, y1, image, format, pixels, context_before, context_after`` of the different images of pages.

    Images that repeat an earlier one of nearly the same size and place on their page are left out. The contexts are the
    nearest texts of the file before and after the middle of the image, up to ``budget`` characters on each side.
    """
    size = {"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0"), "y": (F.col("y0") + F.col("y1")) / 2}
    images = distinct_images(marks.where("kind = 'image'").withColumns(size))
    texts = text_blocks(line_parts(marks)).select(*_PAGE, F.col("y0").alias("y"), "seq", F.col("content").alias("text"))
    every = texts.unionByName(images.select(*_PAGE, "y", "seq", F.lit("￼").alias("text")))
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("page", "y", "seq")))
    context = budget_context(placed, "path", "place", "text", budget).join(placed.where("text = '￼'").select("path", "place", "page", "seq"), ["path", "place"])
    plain = lambda c: F.trim(F.replace(F.col(c), F.lit("￼"), F.lit(""))).alias(c)
    found = images.select(*_PAGE, "seq", "x0", "y0", "x1", "y1", "image", "format", F.col("content").alias("pixels"))
    return found.join(context.select(*_PAGE, "seq", plain("context_before"), plain("context_after")), [*_PAGE, "seq"])


def page_elements(marks: DataFrame) -> DataFrame:
    """``path, page, seq, x0, y0, x1, y1, kind, content, error``: text blocks and images of pages, as ``layout_order`` takes them, and files with errors."""
    columns = [*_PAGE, "seq", "x0", "y0", "x1", "y1", "kind", "content"]
    images = marks.where("kind = 'image'").select(*[c for c in columns if c != "content"], F.lit("").alias("content"))
    found = text_blocks(line_parts(marks)).select(*columns).unionByName(images.select(*columns)).withColumn("error", F.lit(None).cast("string"))
    return found.unionByName(marks.where("error is not null").select(*columns, "error"))
