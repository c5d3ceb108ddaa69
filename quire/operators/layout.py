"""Lines, tables, headings and contents out of positioned text items.

Items are (doc_id, page, item_idx, str, x, y, width, height, font_size, font_name, has_eol); y grows upwards. All work is keyed
by page, or by document for heading styles. Blank and null strings are left out; repeated rows are items of their
own; items without a place (null x or y) are left out; empty tables give no rows. Columns not named here are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quire.functions.folds import fold_rows

PAGE = ["doc_id", "page"]
# Words of header cells and marks of bold fonts.
HEADER_WORDS = r"(?i)\A(?:no\.?|#|id|sr\.?\s*no\.?|s\.?\s*no\.?|name|description|item|product|service|date|time|datetime|timestamp|amount|price|cost|total|value|qty|quantity|rate|status|type|category|class)\z"
BOLD = r"(?i)bold|heavy|black"
ROW_TOLERANCE, COLUMN_STEP, LINE_TOLERANCE, BLOCK_TOLERANCE = 5.0, 10, 3.0, 2.0
MAX_LEVEL = 6


def _placed(items: DataFrame) -> DataFrame:
    return items.where((F.length(F.trim("str")) > 0) & F.col("x").isNotNull() & F.col("y").isNotNull())


def number_rows(items: DataFrame, tolerance: float) -> DataFrame:
    """The rows of (doc_id, page, y, ...) with row: 0-based from the top; a row holds what is within tolerance of its first y."""

    def start():
        row, anchor = -1, None

        def step(y: float) -> tuple[int]:
            nonlocal row, anchor
            if anchor is None or abs(y - anchor) > tolerance:
                row, anchor = row + 1, y
            return (row,)

        return step

    return fold_rows(items, PAGE, [F.desc("y")], ["y"], "row int", start)


def group_rows(items: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """doc_id, page, row, place, str, x, y, width, height: items by row, place counting from the left."""
    rows = number_rows(_placed(items).select(*PAGE, "item_idx", "str", "x", "y", "width", "height"), tolerance)
    w = Window.partitionBy(*PAGE).orderBy("row", "x", F.desc("y"), "item_idx", "str")
    place = F.row_number().over(w) - F.min("n").over(Window.partitionBy(*PAGE, "row"))
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("place", place)
    return rows.select(*PAGE, "row", F.col("place").cast("int").alias("place"), "str", "x", "y", "width", "height")


def items_to_lines(items: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """doc_id, page, line_no, text, x, y, width, height: lines from the top; an item that ends a line ends it for what stands right of it too.

    A gap wider than 2 and a fifth of the item's height becomes a space. line_no counts from 1.
    """
    rows = number_rows(_placed(items).select(*PAGE, "item_idx", F.trim("str").alias("str"), "x", "y", "width", "height", "has_eol"), tolerance)
    w = Window.partitionBy(*PAGE).orderBy("row", "x", F.desc("y"), "item_idx", "str")
    new = (F.lag("row").over(w).eqNullSafe(F.col("row")) & ~F.coalesce(F.lag("has_eol").over(w), F.lit(False))) == F.lit(False)
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("new", new)
    rows = rows.withColumn("line_no", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    part = F.concat(F.when(~F.col("new") & (gap > F.greatest(F.lit(2.0), F.col("height") * 0.2)), " ").otherwise(""), "str")
    lines = rows.withColumn("part", part).groupBy(*PAGE, "line_no").agg(
        _in_order("n", "part", "").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("top")
    )
    return lines.select(*PAGE, "line_no", "text", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("top") - F.col("y")).alias("height"))


def _in_order(order: str, text: str, between: str) -> Column:
    """Texts of a group, joined by their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), between)


def detect_columns(rows: DataFrame) -> DataFrame:
    """doc_id, page, starts: x, rounded to tens, where at least two items and three in ten of the rows begin; from the left."""
    at = (F.floor(F.col("x") / COLUMN_STEP + 0.5) * COLUMN_STEP).cast("int")
    counts = rows.groupBy(*PAGE, at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("last"))
    pages = counts.groupBy(*PAGE).agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("at", "n"))).alias("ats"))
    often = F.filter("ats", lambda a: a["n"] >= F.greatest(F.lit(2), F.floor((F.col("last") + 1) * 0.3)))
    return pages.select(*PAGE, F.transform(often, lambda a: a["at"]).alias("starts")).where(F.size("starts") > 0)


def assign_cells(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """doc_id, page, row, cells: each item goes to the nearest column start, the left one of equals; empty where there is none."""
    away = F.transform("starts", lambda c, i: F.struct(F.abs(F.col("x") - c).alias("d"), i.alias("i")))
    placed = rows.join(columns, PAGE).withColumn("col", F.array_min(away)["i"])
    cells = placed.groupBy(*PAGE, "row", "col").agg(_in_order("place", "str", " ").alias("text"), F.any_value(F.size("starts")).alias("n"))
    lines = cells.groupBy(*PAGE, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"), F.any_value("n").alias("n"))
    return lines.select(*PAGE, "row", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))).alias("cells"))


def _last(x: float) -> tuple[bool, float]:
    """A key that puts NaN after all numbers, and equal to each other, as Spark does."""
    return x != x, x if x == x else 0.0


def _grid(items: list[tuple], tolerance: float) -> tuple | None:
    """starts, cells by row and the box of a page's items (y falling, x, item_idx, str, at, right, top), by the rules of number_rows, detect_columns and assign_cells."""
    row, anchor, lines = -1, None, []
    for item in items:
        if anchor is None or abs(item[0] - anchor) > tolerance:
            row, anchor = row + 1, item[0]
            lines.append([])
        lines[row].append(item)
    often = max(2, math.floor((row + 1) * 0.3))
    starts = sorted(at for at, n in Counter(i[4] for i in items).items() if n >= often)
    if not starts:
        return None
    rows, places = [], {}
    # Numbers alone are in order as they are, at less cost.
    plain = all(x == x for i in items for x in (i[0], i[1], i[5], i[6]))
    order = (lambda i: (i[1], -i[0], i[2] is not None, i[2], i[3])) if plain else (lambda i: (_last(i[1]), _last(-i[0]), i[2] is not None, i[2], i[3]))
    for line in lines:
        cells = defaultdict(list)
        for y, x, index, text, *_ in sorted(line, key=order):
            # Most items begin where others do.
            if (col := places.get(x)) is None:
                col = places[x] = min(((abs(x - c), i) for i, c in enumerate(starts)), default=None)[1]
            cells[col].append(text)
        rows.append([" ".join(cells[i]) if i in cells else "" for i in range(len(starts))])
    held = [[i[k] for i in items if i[k] is not None] for k in (1, 0, 5, 6)]
    return starts, rows, *[f(v, key=None if plain else _last) if v else None for f, v in zip((min, min, max, max), held)]


def page_grids(items: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """doc_id, page, starts, rows (the cells of each row, from the top), x, y, right, top of the pages with columns: group_rows, detect_columns and assign_cells in one pass.

    Items are shuffled once, by page, and stream through a task in order of their height; it holds the items of one page.
    """
    at = (F.floor(F.col("x") / COLUMN_STEP + 0.5) * COLUMN_STEP).cast("int")
    read = _placed(items).select(*PAGE, F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "item_idx", "str", at.alias("at"), (F.col("x") + F.col("width")).cast("double").alias("right"), (F.col("y") + F.col("height")).cast("double").alias("top"))
    dealt = read.repartition(*PAGE).sortWithinPartitions(*PAGE, F.desc("y"))
    adds = _parse_datatype_string("starts array<int>, rows array<array<string>>, x double, y double, right double, top double")
    out = StructType([*read.schema.fields[:2], *adds.fields])
    form = to_arrow_schema(out)

    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (i for b in batches for i in zip(*[c.to_pylist() for c in b.columns]))
        held = []
        for key, page in groupby(items, lambda i: i[:2]):
            if grid := _grid([i[2:] for i in page], tolerance):
                held.append((*key, *grid))
            if len(held) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), form)], schema=form)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), form)], schema=form)

    return dealt.mapInArrow(gridded, out)


def page_cells(grids: DataFrame) -> DataFrame:
    """doc_id, page, row, cells of page_grids: what assign_cells gives for the same items."""
    return grids.select(*PAGE, F.posexplode("rows").alias("row", "cells"))


def table_confidence(rows: Column, n_columns: Column) -> Column:
    """0.4 x share of rows with the most common number of filled cells + 0.2 each for 3 rows and 3 columns + 0.2 x filled share; 0 under two of either."""
    filled = F.transform(rows, lambda r: F.size(F.filter(r, lambda c: F.length(F.trim(c)) > 0)))
    total = F.aggregate(filled, F.lit(0), lambda a, n: a + n)
    most = F.array_max(F.transform(F.sequence(F.lit(0), n_columns), lambda k: F.size(F.filter(filled, lambda n: n == k))))
    n = F.size(rows)
    score = most / n * 0.4 + F.when(n >= 3, 0.2).otherwise(0.0) + F.when(n_columns >= 3, 0.2).otherwise(0.0) + total / (n * n_columns) * 0.2
    return F.when((n < 2) | (n_columns < 2), 0.0).otherwise(F.least(F.lit(1.0), score))


def is_header(cells: Column) -> Column:
    """Whether a first row is a header: a known word in a cell, or short cells on average and no number."""
    known = F.exists(cells, lambda c: F.trim(c).rlike(HEADER_WORDS))
    short = F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) / F.size(cells) < 20
    return known | (short & ~F.exists(cells, lambda c: F.trim(c).rlike(r"\A[0-9]+([.,][0-9]+)?\z")))


def extract_tables(items: DataFrame, min_rows: int = 2, min_columns: int = 2, min_confidence: float = 0.5, pages: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, page, table_idx, rows, header_rows, row_count, column_count, confidence, x, y, width, height.

    A page is one candidate for a table and passes by its rows, columns and confidence.
    """
    items = items if pages is None else items.where(F.col("page").isin(*pages))
    tables = page_grids(items)
    tables = tables.withColumn("column_count", F.size(F.get("rows", F.lit(0)))).withColumn("row_count", F.size("rows"))
    tables = tables.where((F.col("row_count") >= min_rows) & (F.col("column_count") >= min_columns)).withColumn("confidence", table_confidence(F.col("rows"), F.col("column_count"))).where(F.col("confidence") >= min_confidence)
    header = F.when(is_header(F.get("rows", F.lit(0))), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return tables.select(*PAGE, F.lit(0).alias("table_idx"), "rows", header.alias("header_rows"), "row_count", "column_count", "confidence", "x", "y", (F.col("right") - F.col("x")).alias("width"), (F.col("top") - F.col("y")).alias("height"))


def table_counts(tables: DataFrame) -> DataFrame:
    """doc_id, page, tables: by page, by document (page null) and in all (both null)."""
    return tables.rollup(*PAGE).agg(F.count(F.lit(1)).alias("tables"))


def table_cells(tables: DataFrame) -> DataFrame:
    """doc_id, page, table_idx, row, col, value: a row for each cell."""
    rows = tables.select(*PAGE, "table_idx", F.posexplode("rows").alias("row", "cells"))
    return rows.select(*PAGE, "table_idx", "row", F.posexplode("cells").alias("col", "value"))


def edit_cells(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """The cells with the edits (doc_id, page, table_idx, row, col, seq, value) applied, the last of a cell; edits of no cell do nothing."""
    key = [*PAGE, "table_idx", "row", "col"]
    last = edits.groupBy(*key).agg(F.max_by("value", "seq").alias("new"), F.lit(True).alias("edited"))
    return cells.join(last, key, "left").select(*key, F.when(F.col("edited"), F.col("new")).otherwise(F.col("value")).alias("value"))


def heading_blocks(items: DataFrame) -> DataFrame:
    """doc_id, page, block, text, font_size, bold, x, y, width: runs of items whose y differs from the item before by at most 2, in item order."""
    w = Window.partitionBy(*PAGE).orderBy("item_idx")
    rows = _placed(items).select(*PAGE, "item_idx", "str", "x", "y", "width", "font_name", F.coalesce(F.nullif(F.abs("font_size"), F.lit(0.0)), F.lit(12.0)).alias("size"))
    new = F.coalesce(F.abs(F.col("y") - F.lag("y").over(w)) > BLOCK_TOLERANCE, F.lit(True))
    rows = rows.withColumn("new", new.cast("int")).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    first = F.min_by(F.struct("size", "font_name", "x"), "item_idx")
    blocks = rows.groupBy(*PAGE, "block").agg(F.trim(_in_order("item_idx", "str", "")).alias("text"), first.alias("f"), F.max_by("y", "item_idx").alias("y"), F.sum("width").alias("width"))
    return blocks.select(*PAGE, "block", "text", F.col("f.size").alias("font_size"), F.coalesce(F.col("f.font_name").rlike(BOLD), F.lit(False)).alias("bold"), F.col("f.x").alias("x"), "y", "width")


def _size(c: str = "font_size") -> Column:
    return F.floor(F.col(c) + 0.5).cast("int")


def heading_styles(blocks: DataFrame) -> DataFrame:
    """doc_id, size, level, bold, blocks: heading sizes of a document, largest first, six at most.

    The most common size (of equals the one seen first) is the body's; larger ones are headings, and no larger ones if
    at least half of their blocks are bold and there are two.
    """
    sizes = blocks.groupBy("doc_id", _size().alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bold").alias("n_bold"), F.min(F.struct("page", "block")).alias("seen"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", (-F.col("seen.page")).alias("p"), (-F.col("seen.block")).alias("b"))).alias("body"))
    # The sizes of a document are few.
    kept = sizes.join(body, "doc_id").where("size > body or (n_bold >= n / 2 and n >= 2)")
    level = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    return kept.withColumn("level", level).where(F.col("level") <= MAX_LEVEL).select("doc_id", "size", "level", (F.col("n_bold") > F.col("n") / 2).alias("bold"), F.col("n").alias("blocks"))


def extract_headings(blocks: DataFrame, min_font_size: float = 12.0, max_levels: int = 3) -> DataFrame:
    """doc_id, seq (0-based by page and block), title, page, level, font_size, x, y, width of blocks in a heading style; short texts and numbers are none."""
    styles = heading_styles(blocks).where(F.col("level") <= max_levels).select("doc_id", "size", "level")
    found = blocks.where((F.col("font_size") >= min_font_size) & (F.length("text") >= 3) & ~F.col("text").rlike(r"\A[0-9]+\z")).withColumn("size", _size())
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")) - 1
    return found.join(styles, ["doc_id", "size"]).select("doc_id", seq.alias("seq"), F.col("text").alias("title"), "page", "level", "font_size", "x", "y", "width")


def toc_hierarchy(entries: DataFrame) -> DataFrame:
    """The entries (doc_id, seq, level, ...) with parent_seq: the nearest earlier entry of a smaller level, null at the top.

    In order of seq the result is the flattened tree: every entry follows its parent. Levels run from 1 to 6.
    """
    before = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("seq")), ignorenulls=True).over(before) for k in range(1, MAX_LEVEL)]
    rows = entries.withColumn("_last", F.array(*last))
    return rows.withColumn("parent_seq", F.array_max(F.slice("_last", F.lit(1), F.greatest(F.least(F.col("level"), F.lit(MAX_LEVEL)) - 1, F.lit(0))))).drop("_last")


def toc_page_layout(entries: DataFrame, page_height: float = 792.0, margin: float = 50.0, font_size: float = 12.0, line_spacing: float = 1.5, title_size: float = 24.0) -> DataFrame:
    """doc_id, seq, title, level (held to 1..6), toc_pages, shown_page: pages that the contents take in front move every page number on."""
    lines = int((page_height - 2 * margin - 2 * title_size) // (font_size * line_spacing))
    if lines < 1:
        raise ValueError("a page holds no line")
    pages = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("doc_id")) / lines).cast("int")
    return entries.select("doc_id", "seq", "title", F.greatest(F.lit(1), F.least(F.lit(MAX_LEVEL), F.col("level"))).alias("level"), pages.alias("toc_pages"), (F.col("page") + pages).alias("shown_page"))
